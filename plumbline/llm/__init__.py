"""Operators for training-data pipelines: deduplication, filters, classifiers, scans and mixing."""
