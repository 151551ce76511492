"""Operators for large training corpora: scans, deduplication, mixing, sharding."""
