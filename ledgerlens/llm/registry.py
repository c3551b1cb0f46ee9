"""All queries of the corpus operators, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from ledgerlens.llm import chat_views, decontaminate, exact_dedup, language_id, masked_lm, mixing, near_dedup, token_counts, toxicity, warc

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (chat_views, decontaminate, exact_dedup, language_id, masked_lm, mixing, near_dedup, token_counts, toxicity, warc):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
