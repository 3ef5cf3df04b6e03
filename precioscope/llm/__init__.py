"""Training-data operators: quality, packing, personal data, media, dedup, archives, search, mixing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
