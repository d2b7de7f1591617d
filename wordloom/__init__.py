"""Corpus wording analytics expressed as Spark DataFrame jobs."""
