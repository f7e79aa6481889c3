"""Whole runs: traffic files in, reports out."""
