"""Operators for training-data pipelines: joins, search, classifiers, scans, sharding, mixing, deduplication."""
