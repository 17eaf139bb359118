"""Quillmill functions."""
