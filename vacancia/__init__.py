"""Postings analytics as Spark DataFrame operators."""
