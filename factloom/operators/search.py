"""Hybrid search: lexical and vector lists, fused by weighted reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import confidence, text
from factloom.operators import graph

K = 60
# Entries of an entity that are looked at, kinds that are searched, words of a query that name nothing.
ATTRIBUTES, GLOSSARY = 30, 40
KINDS = ("Component", "API", "Resource", "Provider")
GENERIC_TERMS = (
    "service", "services", "component", "components", "system", "systems", "api", "apis", "resource", "resources", "provider", "providers",
    "which", "what", "where", "does", "from", "into", "with", "uses",
)
WEIGHTS = {"vector": 1.0, "lexical": 0.6, "metadata": 0.6}


def lexical(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(ref, score): sum of the idf of the terms that a haystack contains, positive ones alone.  Two scans, no join by substring."""
    if not terms:
        return docs.select("ref", F.lit(0.0).alias("score")).limit(0)
    hits = docs.select("ref", *(F.col("haystack").contains(t).cast("int").alias(f"t{k}") for k, t in enumerate(terms)))
    counts = hits.agg(F.count("*").alias("n"), *(F.sum(f"t{k}").alias(f"d{k}") for k in range(len(terms))))
    idf = lambda k: F.log((F.col("n") - F.coalesce(f"d{k}", F.lit(0)) + 0.5) / (F.coalesce(f"d{k}", F.lit(0)) + 0.5) + 1.0)
    score = reduce(lambda a, b: a + b, (F.col(f"t{k}") * idf(k) for k in range(len(terms))))
    return hits.crossJoin(F.broadcast(counts)).select("ref", F.round(score, 9).alias("score")).where("score > 0")


def dense(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(ref, score): positive cosine similarities with the query vector."""
    score = text.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query))))
    return vectors.select("ref", F.round(score, 9).alias("score")).where("score > 0")


def candidates(entities: DataFrame) -> DataFrame:
    """The entities of kinds that are searched."""
    return entities.where(F.col("kind").isin(*KINDS))


def metadata(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(ref, score): how many of the first `attributes` and `glossary` entries (arrays of texts) hold a term, where some do."""
    if not terms:
        return docs.select("ref", F.lit(0.0).alias("score")).limit(0)
    told = lambda entry: reduce(lambda x, y: x | y, (F.lower(entry).contains(t) for t in terms))
    hits = lambda name, most: F.size(F.filter(F.slice(F.coalesce(name, F.array().cast("array<string>")), 1, most), told))
    return docs.select("ref", (hits("attributes", ATTRIBUTES) + hits("glossary", GLOSSARY)).cast("double").alias("score")).where("score > 0")


def exact_boost(names: Column | str, terms: list[str]) -> Column:
    """1 where a term that isn't generic is one of an entity's names (an array), as written in lower case or squashed; else 0."""
    wanted = [t.lower() for t in terms if t and t.lower() not in GENERIC_TERMS]
    if not wanted:
        return F.lit(0.0)
    low = F.transform(names, lambda n: F.lower(F.coalesce(n, F.lit(""))))
    known = F.array_union(low, F.transform(low, text.squashed))
    return F.when(F.arrays_overlap(known, F.array(*map(F.lit, wanted))), 1.0).otherwise(0.0)


def ranked(scored: DataFrame) -> DataFrame:
    """(ref, rank): the exact rank of every row, from 0, best first, ties by ref.

    Rows are spread by range, so a task sorts its own range alone; the sizes of the ranges (one row each) give the offsets.
    The ranges are checkpointed, as a second sampling could draw them otherwise.
    """
    spark = scored.sparkSession
    spread = scored.select("ref", "score").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("score"), F.asc("ref"))
    held = graph.cut(spread.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "ref"))
    return held.withColumn("own", own).join(F.broadcast(offsets), "part").select("ref", (F.col("offset") + F.col("own") - 1).alias("rank"))


def top(scored: DataFrame, n: int | None = None) -> DataFrame:
    """(ref, rank) of all rows, or of the n best alone.  With n, the limit comes first, so only n rows are ranked in one task."""
    if n is None:
        return ranked(scored)
    best = scored.orderBy(F.desc("score"), "ref").limit(n)
    return best.select("ref", (F.row_number().over(Window.orderBy(F.desc("score"), "ref")) - 1).alias("rank"))


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """(ref, score): sum of weight / (K + rank + 1) over the lists; without vectors the lexical list has full weight."""
    weights = WEIGHTS if "vector" in lists else WEIGHTS | {"lexical": 1.0}
    parts = [ranked.select("ref", (F.lit(weights[name]) / (F.col("rank") + (K + 1))).alias("part")) for name, ranked in lists.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("ref").agg(F.sum("part").alias("score"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 8, deep: int | None = None, least: str | None = None) -> DataFrame:
    """(ref, score, confidence): fused lists weighted by confidence, an exact name first of all, best first.

    Whole lists are fused; `deep` cuts each to its best rows for an approximate but cheaper answer.  `docs` has ref,
    haystack and confidence; `attributes` and `glossary` give a third list, `names` the boost.  `least` is the least confidence.
    """
    terms = text.search_terms(query)
    lists = {"lexical": top(lexical(docs, terms), deep), "vector": top(dense(vectors, vector), deep)}
    if {"attributes", "glossary"} <= set(docs.columns):
        lists["metadata"] = top(metadata(docs, terms), deep)
    boost = exact_boost("names", terms) if "names" in docs.columns else F.lit(0.0)
    kept = docs if least is None else docs.where(confidence.query_rank(F.col("confidence")) >= confidence.QUERY_RANK[least])
    found = fuse(lists).join(kept.select("ref", "confidence", boost.alias("boost")), "ref")
    score = F.round(F.col("score") * confidence.weight(F.col("confidence")) + F.col("boost"), 6)
    return found.select("ref", score.alias("score"), "confidence").orderBy(F.desc("score"), "ref").limit(limit)


def _times(words, term: str):
    return F.size(F.filter(words, lambda w: w == term))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(ref, score): BM25 over words of the haystack."""
    words = F.filter(F.split(F.col("haystack"), "[^a-z0-9]+"), lambda w: w != "")
    rows = docs.select("ref", F.size(words).alias("n"), *(_times(words, t).alias(f"f{k}") for k, t in enumerate(terms)))
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(terms))))
    part = lambda k: F.log((F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5) + 1.0) * F.col(f"f{k}") * (k1 + 1) / (F.col(f"f{k}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    score = reduce(lambda x, y: x + y, map(part, range(len(terms))))
    return rows.crossJoin(F.broadcast(stats)).select("ref", F.round(score, 6).alias("score")).where("score > 0")
