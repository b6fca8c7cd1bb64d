"""Operators of a training-data pipeline: encoding, search, deduplication, filters, mixing and archives."""
