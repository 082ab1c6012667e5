"""Operators for corpora of training text: search, near copies, encoding, counting, cleaning, packing, files."""
