"""Readers of sequence files, profile databases and training tables."""
