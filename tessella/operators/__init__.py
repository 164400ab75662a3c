"""Graph and edge-list operators."""
