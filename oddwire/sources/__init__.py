"""Readers for traffic and feature tables, writers for every result."""
