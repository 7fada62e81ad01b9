"""Connected components over long node ids by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of `edges` (a, b); label is the smallest node id reachable.

    Each round takes the least label of a node's neighbours and then the label of
    that label, so a chain of n nodes ends after about log2(n) rounds.  Labels and
    edges stay distributed; a round's table is written to the shared folder and the
    one before is deleted.  Nulls and self-links are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        least = labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = (
            least.join(jump, "label", "left")
            .select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
            .join(labels.withColumnRenamed("label", "was"), "node")
        )
        after = materialise(moved, "labels")
        changed = after.where("label < was").limit(1).count()
        discard(labels)
        labels = after.select("node", "label")
        if not changed:
            discard(both)
            return labels
