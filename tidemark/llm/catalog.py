"""The registered queries of the llm operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

# imported here, so that a missing library shows where this module is imported
from tidemark.llm import contamination, jaccard, neardup, packing, periodic_runs, records, secrets, sentence_pieces, token_counts, toxicity, urls, vector_codes, warc

MODULES = (token_counts, urls, records, contamination, secrets, packing, neardup, toxicity, warc, jaccard, vector_codes, sentence_pieces, periodic_runs)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
