"""Quillmill operators."""
