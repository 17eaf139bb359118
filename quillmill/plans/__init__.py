"""Quillmill plans."""
