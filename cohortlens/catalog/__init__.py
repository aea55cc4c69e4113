"""Registered queries, each with the equivalent SQL where SQL can express it."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MODULES = ["evaluation", "ranking", "cohorts", "statistics", "distributions", "arrays", "sets", "audits", "rules", "scalars", "io",
           "incremental", "modelling"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"cohortlens.catalog.{module}")
