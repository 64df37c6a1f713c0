"""Curation of media datasets and training corpora on Spark."""
