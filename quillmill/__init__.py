"""Quillmill: a PySpark library for scholar-reputation analytics and corpus preparation."""
