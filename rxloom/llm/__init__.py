"""Operators for preparing training corpora: packing, filters, near-duplicates, archives, sharding and models."""
