"""Operators that prepare training data: scoring, archives, mixing, extraction, sharding, fingerprints, search, packing.

Nothing outside this folder imports it; the package works without it.
"""
