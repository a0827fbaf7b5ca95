"""Training-data operators: packing, mixing, deduplication, classifiers, archives, search, token counts.

Nothing outside this subpackage imports it.
"""
