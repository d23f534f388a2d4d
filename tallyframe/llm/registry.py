"""The subpackage's queries and their oracle SQL."""

from __future__ import annotations

from tallyframe.llm import exact_dedup, hamming_search, importance, lang_id, mixing, ngram_join, pii, quality, secrets, sentencepiece_codec, spelling, substring_dedup, warc

MODULES = (exact_dedup, hamming_search, importance, lang_id, mixing, ngram_join, pii, quality, secrets, sentencepiece_codec, spelling, substring_dedup, warc)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
