"""Training-data operators: packing, filtering, deduplication, tokenising, media.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
