"""Corpus operators for training-data pipelines (deduplication, filters,
classifiers, mixing, token files).  Nothing else in the library imports this."""
