"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from factloom.llm import chat, collocations, decontaminate, language, minhash, packing, pagetext, repair, secrets, sharding, substrings, topk, toxicity  # noqa: F401  (importing registers their queries)
from factloom.llm.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
