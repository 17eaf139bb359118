"""Quillmill streaming."""
