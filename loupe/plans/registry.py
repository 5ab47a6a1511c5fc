"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None).

Each query module registers its builders with ``@query``; importing
``all_queries`` loads every module.  Builders take ``(spark, sf_dir)`` and
return a DataFrame over the whole driver tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = ["q_summary", "q_merge", "q_scalars", "q_pages", "q_views", "q_stored"]


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise


def all_queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLE)
