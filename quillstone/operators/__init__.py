"""Operators over DataFrames: graph, retrieval, curation, stores and parsing."""
