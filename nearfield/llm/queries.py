"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from nearfield.llm import conversation_repair, lm_scoring, ngram_join, pivot_search, seed_decontamination, sentencepiece_codec, shuffle_shards, source_divergence, substring_dedup, token_counts, token_files, toxicity, url_templates

_MODULES = (sentencepiece_codec, substring_dedup, token_counts, toxicity, token_files, ngram_join, pivot_search, url_templates, shuffle_shards, seed_decontamination, conversation_repair, source_divergence, lm_scoring)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
