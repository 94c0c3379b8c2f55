"""Training-data operators: dedup, packing, mixing, formatting, scoring, search.

Nothing else in the library imports this subpackage.
"""
