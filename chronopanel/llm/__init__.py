"""Operators for preparing training text at scale.

Nothing outside this package imports it. Every operator takes a DataFrame and the names of
its id and text columns, uses no other column unless it says so, and returns a DataFrame.
"""

from chronopanel.llm import (  # noqa: F401  (registration)
    alignment,
    decontamination,
    kd_shards,
    license_scan,
    line_dedup,
    minhash,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    repeats,
    spelling,
    warc,
)
from chronopanel.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
