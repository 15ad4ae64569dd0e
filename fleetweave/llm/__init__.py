"""Operators for training data: golden records, pair consolidation, linkage without keys, tokens, packing, splitting.

Nothing outside this subpackage imports it.
"""
