"""Operators for building training-text corpora (documents, pages, benchmark tables)."""
