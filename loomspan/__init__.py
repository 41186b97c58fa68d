"""Corpus analytics on PySpark: code-corpus indexing, retrieval and corpus operators."""
