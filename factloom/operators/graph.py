"""Graph queries: neighbours, traces and bounded overviews, level by level.

A level is one equi-join of the frontier with the edges; the driver only counts the
new frontier.  Each level's table is cut from its lineage by a reliable checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import confidence

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where none is set and all run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return folder or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="graph-"))


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """A table that several levels read, written once as Parquet: a checkpoint takes several times the room."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def usable(relations: DataFrame, types: list[str] | None = None, least: str | None = None) -> DataFrame:
    out = relations.where(F.col("type").isin(*types)) if types else relations
    return out.where(confidence.query_rank(F.col("confidence")) >= confidence.QUERY_RANK[least]) if least else out


def neighbors(relations: DataFrame, start: DataFrame, direction: str = "out", depth: int = 1, types: list[str] | None = None, least: str | None = None) -> DataFrame:
    """(src, type, dst, way, depth): edges met when each node is expanded once, up to `depth` levels; edges to known nodes are given too."""
    edges = kept(usable(relations, types, least).select("src", "type", "dst"))
    ways = []
    if direction in ("out", "both"):
        ways.append(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "type", "dst", F.lit("out").alias("way")))
    if direction in ("in", "both"):
        ways.append(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "type", "dst", F.lit("in").alias("way")))
    steps = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    seen = frontier = cut(start.select(F.col("ref").alias("at")).distinct())
    found = None
    for level in range(1, max(depth, 1) + 1):
        met = cut(frontier.join(steps, "at").withColumn("depth", F.lit(level)))
        found = met if found is None else found.unionByName(met)
        if level < depth:
            frontier = cut(met.select(F.col("to").alias("at")).distinct().join(seen, "at", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return found.select("src", "type", "dst", "way", "depth")


def ego(relations: DataFrame, center: DataFrame, depth: int = 1, least: str | None = None) -> DataFrame:
    """(ref, degree, is_center) of the nodes around `center`, by edges in either direction counted once each."""
    edges = neighbors(relations, center, "both", depth, None, least).select("src", "type", "dst").distinct()
    ends = edges.select(F.col("src").alias("ref")).unionByName(edges.select(F.col("dst").alias("ref"))).groupBy("ref").agg(F.count("*").alias("degree"))
    mark = center.select("ref", F.lit(True).alias("is_center")).distinct()
    return ends.join(mark, "ref", "full").select("ref", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("is_center", F.lit(False)).alias("is_center"))


def trace(relations: DataFrame, start: DataFrame, hops: int = 3, types: list[str] | None = None, fanout: int = 12, end: list[str] | None = None, least: str | None = None) -> DataFrame:
    """(path, type, depth): branch-aware paths without cycles; at most `fanout` edges per node and type, by dst; a path stops at an end."""
    edges = usable(relations, types, least)
    by = Window.partitionBy("src", "type").orderBy("dst")
    edges = kept(edges.select("src", "type", "dst").distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= fanout).drop("n"))
    frontier = start.select(F.array("ref").alias("path"), F.col("ref").alias("src"))
    found = None
    for level in range(1, hops + 1):
        met = frontier.join(edges, "src").where(~F.array_contains("path", F.col("dst")))
        met = cut(met.select(F.array_append("path", F.col("dst")).alias("path"), "type", "dst").withColumn("depth", F.lit(level)))
        found = met if found is None else found.unionByName(met)
        going = met if not end else met.where(~F.col("dst").isin(*end))
        frontier = going.select("path", F.col("dst").alias("src"))
        if level < hops and frontier.isEmpty():
            break
    return found.select(F.array_join("path", ">").alias("path"), "type", "depth")


def degrees(relations: DataFrame) -> DataFrame:
    ends = relations.select(F.explode(F.array("src", "dst")).alias("ref"))
    return ends.groupBy("ref").agg(F.count("*").alias("degree"))


def balanced_top(nodes: DataFrame, limit: int, kinds: int) -> DataFrame:
    """The `limit` best nodes with an equal share for each kind, filled up in global order of (-score, ref)."""
    order = [F.desc("score"), F.asc("ref")]
    share = limit // max(kinds, 1)
    own = Window.partitionBy("kind").orderBy(*order)
    # only the first `limit` of a kind can be taken, which bounds what the last step sorts
    first = nodes.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= limit)
    return first.orderBy(F.when(F.col("rn") <= share, 0).otherwise(1), *order).limit(limit).drop("rn")
