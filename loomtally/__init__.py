"""Corpus preparation and coding-cost analytics expressed as Spark plans."""

__version__ = "0.1.0"
