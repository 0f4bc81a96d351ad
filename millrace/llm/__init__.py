"""Training-data operators: scoring, deduplication, filtering, sharding, mixing, search, tokenizing.

Nothing else in the library imports this subpackage.
"""
