"""Merging facts: entities by reference, relations by (src, type, dst), and rewiring of edges.

Each merge is one aggregation, so partial results are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence


def first_of(value: Column, order: Column) -> Column:
    """The first value, in `order`, that is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), order))


def highest(value: Column) -> Column:
    """The highest confidence of a group; null where none is given."""
    return confidence.from_rank(F.max(confidence.build_rank(value)))


def floor(value: Column) -> Column:
    """The least confidence given in a group; medium where none is."""
    return F.coalesce(confidence.from_rank(F.min(F.when(value.isin(*confidence.QUERY_RANK), confidence.build_rank(value)))), F.lit("medium"))


def merge_relations(facts: DataFrame) -> DataFrame:
    """One row per (src, type, dst): evidence distinct by (path, line), the highest confidence, the first protocol by `ord`."""
    return facts.groupBy("src", "type", "dst").agg(
        F.count_distinct("path", "line").alias("n_evidence"),
        F.min(F.struct("path", "line")).alias("evidence"),
        highest(F.col("confidence")).alias("confidence"),
        first_of(F.col("protocol"), F.col("ord")).alias("protocol"),
    )


def merge_entities(facts: DataFrame) -> DataFrame:
    """One row per ref: first non-empty name, owner and description by `ord`, sorted distinct tags, highest confidence."""
    return facts.groupBy("ref").agg(
        *(first_of(F.col(c), F.col("ord")).alias(c) for c in ("kind", "name", "owner", "description")),
        F.array_sort(F.collect_set("tag")).alias("tags"),
        highest(F.col("confidence")).alias("confidence"),
        F.count("*").alias("n_facts"),
    )


def remap(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends replaced by `names` (old, new), self-loops dropped and equal ones merged by the floor."""
    ends = relations
    for end in ("src", "dst"):
        side = names.select(F.col("old").alias(end), F.col("new").alias("_new"))
        ends = ends.join(side, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return ends.where("src <> dst").groupBy("src", "type", "dst").agg(F.sum("n_evidence").alias("n_evidence"), floor(F.col("confidence")).alias("confidence"))


def require_evidence(relations: DataFrame) -> DataFrame:
    """Relations without those of high confidence that no evidence supports."""
    return relations.where(~((F.coalesce(F.col("confidence"), F.lit("")) == "high") & (F.col("n_evidence") == 0)))


def without_dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    refs = entities.select("ref").distinct()
    return relations.join(refs.withColumnRenamed("ref", "src"), "src", "left_semi").join(refs.withColumnRenamed("ref", "dst"), "dst", "left_semi")


def alias_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, kind, ref): for each key and kind the entity with the highest priority, ties by ref."""
    best = F.max_by(F.struct("ref"), F.struct("priority", (-F.col("pos")).alias("p"))).getField("ref")
    return aliases.where("key <> ''").join(entities.select("ref", "kind", "pos"), "ref").groupBy("key", "kind").agg(best.alias("ref"))


def resolve(wanted: DataFrame, index: DataFrame, kinds: list[str]) -> DataFrame:
    """`wanted` (key) with the ref of the first kind in `kinds` that has it; null where none has."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    ranked = index.withColumn("rank", rank).where("rank > 0").groupBy("key").agg(F.min_by("ref", "rank").alias("resolved"))
    return wanted.join(ranked, "key", "left")


def merge_candidates(external: DataFrame, real: DataFrame) -> DataFrame:
    """(ref, n_matches, into): external entities and the one real entity that shares a key; into is null where several do."""
    hits = external.select("ref", "key").distinct().join(real.select(F.col("ref").alias("into"), "key").distinct(), "key")
    found = hits.groupBy("ref").agg(F.count_distinct("into").alias("n_matches"), F.min("into").alias("into"))
    return found.withColumn("into", F.when(F.col("n_matches") == 1, F.col("into")))
