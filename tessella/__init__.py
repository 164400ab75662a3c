"""Graph analytics and edge-list processing as PySpark DataFrame programs."""
