"""Registered queries: every operator run over the given tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

RunQuery = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: RunQuery
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[RunQuery], RunQuery]:
    """Register a query under the inventory id and a descriptive name."""

    def wrap(run: RunQuery) -> RunQuery:
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = Entry(name, lambda spark, sf_dir: run(tune(spark), sf_dir), sql)
        return run

    return wrap


def entries() -> dict[str, Entry]:
    """All registered queries, in registration order."""
    load_all()
    return dict(_ENTRIES)


def load_all() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
