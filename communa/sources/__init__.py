"""Readers that turn files and rows into edge and community DataFrames, and writers of results."""
