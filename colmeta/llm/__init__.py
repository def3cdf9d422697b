"""Training-data operators: extraction, scoring, deduplication, mixing, packing.

Nothing outside this subpackage imports it.
"""
