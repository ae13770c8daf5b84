"""Operators that prepare training corpora. Nothing else in the library imports this subpackage.

Every module holds one operator with a general interface and, at its end, the query that runs it over a whole table.
"""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with their tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = (
    "mixing", "chat", "token_counts", "hyperminhash", "warc", "toxicity", "decontamination", "line_dedup", "neighbours", "repeats",
    "alignment", "periods", "sharding",
)


def load():
    """All queries of the subpackage and their SQL, as two dictionaries."""
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tickerloom.llm.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
