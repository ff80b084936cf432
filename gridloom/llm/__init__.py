"""Training-data operators: scoring, packing, near-duplicates, archives, retrieval.

Nothing else in the library imports this subpackage.
"""
