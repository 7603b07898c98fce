"""The queries of this subpackage and, where SQL can express them, their equivalents in SQL."""

from __future__ import annotations

from millrace.llm import ann, divergence, langid, lm, minhash, mix, neardup_vectors, pack, search, shard, substrings, toxicity, urls

_MODULES = (lm, substrings, toxicity, ann, mix, minhash, urls, neardup_vectors, pack, shard, langid, divergence, search)


def queries():
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL}
