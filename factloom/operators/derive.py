"""Derivation rules: relations that follow from other relations by equi-joins on shared ends.

A resource that very many components use would pair them all; `limit`-free callers can pass `shared`
endpoints that are known to be generic (brokers, common stores) in `ignore`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence


def _flow(left: DataFrame, right: DataFrame, via: str, mechanism: str) -> DataFrame:
    def side(rows: DataFrame, end: str, s: str) -> DataFrame:
        """A row for each end and endpoint, so that a pair meets once on an endpoint and no endpoints have to be told apart after the join."""
        return rows.groupBy(F.col("src").alias(end), via).agg(
            F.min(confidence.build_rank(F.col("confidence"))).alias(f"{s}_rank"), F.sum("n_evidence").alias(f"{s}_sum"), F.count("n_evidence").alias(f"{s}_n")
        )

    flows = side(left, "src", "l").join(side(right, "dst", "r"), via).where("src <> dst")
    return flows.groupBy("src", "dst").agg(
        F.count("*").alias("n_via"),
        F.sum(F.col("l_sum") * F.col("r_n") + F.col("r_sum") * F.col("l_n")).alias("n_evidence"),
        confidence.from_rank(F.min(F.least("l_rank", "r_rank"))).alias("confidence"),
    ).withColumn("mechanism", F.lit(mechanism))


def api_calls(relations: DataFrame) -> DataFrame:
    """Component -> component where one consumes an API that the other provides."""
    used = relations.withColumnRenamed("dst", "via")
    return _flow(used.where("type = 'consumesApi'"), used.where("type = 'providesApi'"), "via", "api")


def messages(relations: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """Producer -> consumer over a shared queue or topic; generic endpoints (`ignore`: dst) rendezvous with nothing."""
    used = relations if ignore is None else relations.join(ignore, "dst", "left_anti")
    used = used.withColumnRenamed("dst", "via")
    return _flow(used.where("type = 'producesMessage'"), used.where("type = 'consumesMessage'"), "via", "message")


def shared_resources(relations: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """Writer -> reader over a shared resource; of low confidence, as both may use it without one another."""
    used = relations if ignore is None else relations.join(ignore, "dst", "left_anti")
    used = used.withColumnRenamed("dst", "via")
    return _flow(used.where("type = 'writesResource'"), used.where("type = 'readsResource'"), "via", "shared_resource").withColumn("confidence", F.lit("low"))


def merge_flows(*flows: DataFrame) -> DataFrame:
    """Flows of several rules as one communicatesWith relation per pair: sorted mechanisms, the floor of their confidence."""
    every = flows[0]
    for more in flows[1:]:
        every = every.unionByName(more)
    return every.groupBy("src", "dst").agg(
        F.array_join(F.array_sort(F.collect_set("mechanism")), ",").alias("mechanisms"),
        F.sum("n_evidence").alias("n_evidence"),
        confidence.from_rank(F.min(confidence.build_rank(F.col("confidence")))).alias("confidence"),
    )


def collapse_fragments(apis: DataFrame, least: int = 4, operations: int = 2) -> DataFrame:
    """(provider, n_apis, n_operations) of providers whose APIs are many and tiny: each becomes one API."""
    return apis.groupBy("provider").agg(F.count("*").alias("n_apis"), F.sum("n_operations").alias("n_operations"), F.max("n_operations").alias("most")).where(
        (F.col("n_apis") >= least) & (F.col("most") <= operations)
    ).drop("most")
