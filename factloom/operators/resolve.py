"""Lookups by free text, latest decisions and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds by priority.
KIND_RANK = {"Component": 0, "Provider": 1, "Resource": 2, "API": 3, "System": 4, "Domain": 5, "Group": 6}


def kind_rank(kind):
    out = F.lit(9)
    for name, rank in KIND_RANK.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def fuzzy(entities: DataFrame, needle: str) -> DataFrame:
    """(ref, tier): the best entity for a text: exact ref, exact name, part of a name, exact alias; no row for ''."""
    want = needle.strip().lower()
    name = F.lower(F.col("name"))
    tier = F.when((F.col("ref") == needle) & F.lit(":" in needle), 1).when(name == want, 2).when(name.contains(want), 3).when(F.exists("aliases", lambda a: F.lower(a) == want), 4)
    key = F.struct("tier", kind_rank(F.col("kind")).alias("k"), F.when(F.col("tier") == 3, F.length("name")).otherwise(0).alias("n"), "pos")
    if not want:
        return entities.limit(0).select("ref", F.lit(0).alias("tier"))
    scored = entities.withColumn("tier", tier).where("tier is not null")
    return scored.agg(F.min_by(F.struct("ref", "tier"), key).alias("b")).where("b is not null").select("b.*")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`, as one aggregation."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def facets(entities: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of every non-empty value, in one scan and one shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return entities.select(F.inline(pairs)).where("value <> '' and value <> 'unknown'").groupBy("facet", "value").agg(F.count("*").alias("n"))
