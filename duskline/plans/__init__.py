"""Whole jobs: files in, result tables out."""
