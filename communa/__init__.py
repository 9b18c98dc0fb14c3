"""Communa: community detection and corpus processing as Spark DataFrame operators."""

__version__ = "0.1.0"
