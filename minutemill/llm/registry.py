"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from minutemill.llm import (
    bpe, fill_middle, hamming, jaccard, language, licenses, line_dedup, merkle, orc_ids, packing, pitman_yor, quality,
    suffix_dedup,
)

MODULES = (
    pitman_yor, bpe, language, quality, licenses, hamming, jaccard, packing, orc_ids, suffix_dedup, fill_middle, line_dedup,
    merkle,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
