"""Traces with branches and asynchronous hops, level by level.

A level is what one step of all branches meets: edges of each branch's end in the order of the
types asked for, and behind a produced message its consumers.  Steps and branch numbers run
through a level in path order, so it is spread by range over that order; each range is numbered
by itself, and the sizes of the ranges before it (a row each) are added.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import resolve
from factloom.operators.graph import cut, kept, usable

# Types of resources that carry messages, and the types of edges that a trace follows, in order.
MESSAGE_TYPES = ("virtual-topic", "topic", "queue", "consumer-queue", "stream")
FLOW_TYPES = ("communicatesWith", "consumesApi", "consumesMessage", "producesMessage", "dependsOn", "readsResource", "writesResource")
#: Hops from which no further level is begun.
MOST_HOPS = 5000
#: Parts of a hub's edges that are cut to the first ones each, before those are compared.
SALTS = 32


class Trace(NamedTuple):
    """`hops`: step, branch, depth, src, dst, type, n_evidence, confidence, is_async; `terminals`: ref."""

    hops: DataFrame
    terminals: DataFrame


def first_edges(edges: DataFrame, types: list[str], fanout: int) -> DataFrame:
    """The first `fanout` edges of each node and type by dst, with `i`, their place among the node's by order of the types."""
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    least = lambda *by: F.row_number().over(Window.partitionBy("src", "type", *by).orderBy("dst"))
    salted = edges.where(F.col("type").isin(*types)).withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)))
    firsts = salted.withColumn("n", least("salt")).where(F.col("n") <= fanout).withColumn("n", least()).where(F.col("n") <= fanout)
    return firsts.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy(rank, "dst")) - 1).drop("salt", "n")


def numbered(level: DataFrame, step: int, seq: int) -> DataFrame:
    """The rows of a level with `step` and `s`, how many rows up to here took a branch number, both going on from what is given, and `s` of the last row that was not asynchronous."""
    keys = ["at", "i", "is_async", "dst"]
    spread = level.repartitionByRange(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    held = cut(spread.withColumn("part", F.spark_partition_id()))
    so_far = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    takes = (F.col("is_async") | (F.col("i") > 0)).cast("long")
    held = held.withColumns({"step": F.row_number().over(Window.partitionBy("part").orderBy(*keys)), "s": F.sum(takes).over(so_far)})
    held = held.withColumn("main", F.max(F.when(~F.col("is_async"), F.col("s"))).over(so_far))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("part").agg(F.max("step").alias("n"), F.max("s").alias("took"), F.max("main").alias("last"))
    parts = parts.select("part", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("took").over(before), F.lit(0)).alias("took"))
    parts = parts.select("part", "n", "took", F.max(F.col("last") + F.col("took")).over(before).alias("last"))
    out = held.join(F.broadcast(parts), "part")
    main = F.coalesce(F.col("main") + F.col("took"), F.col("last")) + seq
    return out.select(*level.columns, (F.col("step") + F.col("n") + step).alias("step"), (F.col("s") + F.col("took") + seq).alias("s"), main.alias("main"))


def _met(live: DataFrame, edges: DataFrame, nodes: DataFrame, types: list[str], fanout: int, ends: Column, follow_async: bool) -> tuple[DataFrame, DataFrame]:
    """(rows of a level, nodes where nothing goes on): each live branch with each of its first edges, and the consumers behind messages."""
    near = first_edges(edges.join(live.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), types, fanout)
    going = live.join(near, F.col("node") == F.col("src"), "left")
    stuck = going.where("src is null").select(F.col("node").alias("ref"))
    main = going.where("src is not null").where(~F.array_contains("path", F.col("dst")))
    main = main.join(nodes.select(F.col("ref").alias("dst"), "kind", F.col("type").alias("form")), "dst", "left")
    main = main.withColumn("ended", F.coalesce(ends, F.lit(False))).withColumn("path", F.array_append("path", F.col("dst")))
    shape = ["at", "branch", "depth", "i", "src", "dst", "type", "n_evidence", "confidence", "path", "ended", "is_async"]
    rows = main.withColumns({"depth": F.col("depth") + 1, "is_async": F.lit(False)}).select(*shape)
    if not follow_async:
        return rows, stuck
    carried = (F.col("type") == "producesMessage") & (F.col("kind") == "Resource") & F.col("form").isin(*MESSAGE_TYPES) & ~F.col("ended")
    sent = main.where(carried).select("at", "branch", "depth", "i", "path", F.col("dst").alias("sent"))
    heard = edges.where("type = 'consumesMessage'").select(F.col("dst").alias("sent"), F.col("src").alias("dst"), "n_evidence", "confidence")
    found = sent.join(heard, "sent").where(~F.array_contains("path", F.col("dst"))).withColumn("path", F.array_append("path", F.col("dst")))
    found = found.withColumns({"depth": F.col("depth") + 2, "src": F.col("sent"), "type": F.lit("consumesMessage"), "ended": F.lit(False), "is_async": F.lit(True)})
    return rows.unionByName(found.select(*shape)), stuck


def trace(
    relations: DataFrame, nodes: DataFrame, start: str, end: str | None = None, hops: int = 6, types: list[str] | None = None,
    follow_async: bool = True, fanout: int = 12, least: str | None = None, most: int = MOST_HOPS,
) -> Trace:
    """All branches from `start` along edges (src, type, dst, n_evidence, confidence) between `nodes` (ref, kind, type).

    A branch goes on by at most `fanout` edges a type, in the order of `types`, ends at `end` (a ref, or "kind:X") or at depth
    `hops`, and never comes to a node twice.  The first edge of a node continues its branch, others open one with a number
    that runs through the trace.  Behind a message produced on a resource that carries messages all consumers follow, two
    levels deeper.  No level is begun once there are `most` hops.  A start without edges is its own terminal.
    """
    types = list(types or FLOW_TYPES)
    edges = kept(usable(relations, None, least).select("src", "type", "dst", "n_evidence", "confidence").where(F.col("type").isin(*types, "consumesMessage")))
    if not end:
        ends = F.lit(False)
    elif end.startswith("kind:"):
        ends = F.col("kind") == end.split(":", 1)[1]
    else:
        ends = F.col("dst") == end
    frontier = relations.sparkSession.createDataFrame([(0, "0", 0, start, [start])], "at long, branch string, depth int, node string, path array<string>")
    found, terminals, step, seq = [], [], 0, 0
    while True:
        terminals.append(frontier.where(F.col("depth") >= hops).select(F.col("node").alias("ref")))
        level, stuck = _met(frontier.where(F.col("depth") < hops), edges, nodes, types, fanout, ends, follow_async)
        rows = numbered(level, step, seq)
        opened = F.when(F.col("i") == 0, F.col("branch")).otherwise(F.concat_ws(".", "branch", F.col("main").cast("string")))
        branch = F.when(F.col("is_async"), F.concat(opened, F.lit(".async"), F.col("s").cast("string"))).otherwise(opened)
        met = cut(rows.withColumn("branch", branch))
        found.append(met.select("step", "branch", "depth", "src", "dst", "type", "n_evidence", "confidence", "is_async"))
        terminals += [stuck, met.where("ended").select(F.col("dst").alias("ref"))]
        last = met.agg(F.max("step").alias("step"), F.max("s").alias("s")).first()
        if last.step is None:
            break
        step, seq = last.step, last.s
        frontier = met.where("not ended").select(F.col("step").alias("at"), "branch", "depth", F.col("dst").alias("node"), "path")
        if step >= most:
            break
    every, ends_at = found[0], terminals[0]
    for more in found[1:]:
        every = every.unionByName(more)
    for more in terminals[1:]:
        ends_at = ends_at.unionByName(more)
    return Trace(every, ends_at.distinct())


def resolved(entities: DataFrame, wanted: str, found: DataFrame | None = None) -> str | None:
    """The ref that a text stands for: the best entity by name or alias, else the first of what a search has found (ref, score); None without either."""
    best = resolve.fuzzy(entities, wanted).select("ref").first()
    if best is None and found is not None:
        best = found.orderBy(F.desc("score"), "ref").select("ref").first()
    return best.ref if best else None


def resolved_end(entities: DataFrame, wanted: str | None) -> str | None:
    """A text without a colon stands for the best entity by name or alias; other ends, and texts that nothing answers to, stay as they are."""
    if not wanted or ":" in wanted:
        return wanted
    return resolved(entities, wanted) or wanted
