"""Operators for training-data pipelines: texts, tokens, duplicates, licences, archives."""
