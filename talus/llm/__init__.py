"""Operators that prepare training data: linking, mapping, ranking, tokenizing, packing and text quality."""
