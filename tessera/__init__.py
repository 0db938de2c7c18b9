"""Spark-first full-text search: build relational index tables, answer ranked queries."""
