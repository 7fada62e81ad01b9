"""The confidence lattice: ranks, weights, floor, promotion.  Its tables differ by layer and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tables of the layers.
QUERY_RANK = {"review": 0, "low": 1, "medium": 2, "high": 3}
WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4, "review": 0.1}
PROMOTED = {"review": "low", "low": "medium", "medium": "high", "high": "high"}


def _case(value: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def query_rank(value: Column) -> Column:
    """Rank for filters and order; a missing confidence ranks as low."""
    return _case(value, QUERY_RANK, 1)


def build_rank(value: Column) -> Column:
    """Rank for merges; a missing confidence ranks below all."""
    return _case(value, QUERY_RANK, -1)


def weight(value: Column) -> Column:
    return _case(value, WEIGHT, 0.5)


def from_rank(rank: Column) -> Column:
    return _case(rank, {v: k for k, v in QUERY_RANK.items()}, None)


def promoted(value: Column) -> Column:
    return F.coalesce(_case(value, PROMOTED, None), value)


def combined(a: Column, b: Column) -> Column:
    """One verdict from the snippet check and the line-shape check (null where that did not run)."""
    return F.when(a != "confirmed", a).when(b == "disconfirmed", "mixed").otherwise("confirmed")


def calibrated(before: Column, verdict: Column) -> Column:
    return F.when(verdict == "confirmed", promoted(before)).when(verdict == "disconfirmed", "review").otherwise(before)
