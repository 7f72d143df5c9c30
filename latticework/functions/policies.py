"""Collision policies: what entries of one cell become. New ones can be registered as aggregate expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .pieces import dealt

#: Up to so many cells, every task's part is small after its own aggregation; beyond, entries are dealt out before they are merged.
FEW_CELLS = 1 << 20

_POLICIES: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "max": lambda: F.max("value"),
    "min": lambda: F.min("value"),
    "last": lambda: F.max_by("value", "seq"),
}


def register_policy(name: str, make: Callable[[], Column]) -> None:
    """``make()`` gives an aggregate over the columns value and, if the entries have one, seq."""
    _POLICIES[name] = make


def aggregate(policy: str) -> Column:
    if policy not in _POLICIES:
        raise InvalidArgument(f"unknown collision policy {policy!r}; known: {', '.join(sorted(_POLICIES))}")
    return _POLICIES[policy]()


def merge_entries(df: DataFrame, policy: str = "sum", keys: tuple[str, ...] = ("row", "col"), cells: int | None = None, spread: float = 1.0) -> DataFrame:
    """One entry per cell; sums that cancel stay as explicit zeros. Where there are few ``cells``, partial aggregation runs before the shuffle. Where
    there may be many, it would hold nearly all of a task's entries: the entries themselves are shuffled, to tasks by their size."""
    if policy == "last" and "seq" not in df.columns:
        raise InvalidArgument("policy 'last' needs the entries' order in a column seq")
    make = aggregate(policy)
    if cells is None or cells > FEW_CELLS:
        df = dealt(df, *keys, spread=spread)
    return df.groupBy(*keys).agg(make.alias("value"))
