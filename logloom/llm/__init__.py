"""Corpus preparation operators for large text collections."""
