"""Retrieval and document analytics expressed as Spark plans."""
