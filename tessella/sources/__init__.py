"""Readers and writers of graph file formats."""
