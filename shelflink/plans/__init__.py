"""Whole jobs: linking and reporting."""
