"""Quillmill sources."""
