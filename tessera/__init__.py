"""Tessera: a typed, validated statement layer on Spark, with a table store and migrations."""

__version__ = "0.1.0"
