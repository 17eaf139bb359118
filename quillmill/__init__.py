"""Quillmill: document-localisation analytics and corpus preparation on Spark."""
