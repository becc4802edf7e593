"""Operators of a training-data pipeline: cleaning, deduplication, packing, scoring, mixing."""
