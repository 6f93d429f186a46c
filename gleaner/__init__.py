"""Retrieval and document analytics as ordinary PySpark DataFrame jobs."""
