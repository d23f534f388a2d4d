"""Corpus operators for training data: quality, archives, tokens, joins, dedup, mixing, language, search, secrets, PII.

Nothing outside this subpackage imports it.
"""
