"""Readers and the tables derived from stored data."""
