"""Batch retrieval: a table of queries against a table of documents."""
