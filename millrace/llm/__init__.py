"""Operators for training-data pipelines: language, duplicates, secrets, quality, mixing, packing, token files, vectors."""
