"""Writers: tables of the graph, logs, exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_graph(entities: DataFrame, relations: DataFrame, folder: str) -> None:
    """Entities once per ref, and relations by type without those whose ends are unknown."""
    from factloom.operators.merge import without_dangling

    entities.dropDuplicates(["ref"]).write.mode("overwrite").parquet(f"{folder}/entities")
    without_dangling(relations, entities).write.mode("overwrite").partitionBy("type").parquet(f"{folder}/relations")


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object per line, keys sorted."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def quarantine(rows: DataFrame, valid, good: str, bad: str) -> None:
    """Rows go to one of two tables by a predicate; null is invalid."""
    fine = F.coalesce(valid, F.lit(False))
    rows.where(fine).write.mode("overwrite").parquet(good)
    rows.where(~fine).write.mode("overwrite").parquet(bad)


def lineage_events(relations: DataFrame, now: str) -> DataFrame:
    """(job, event): one JSON run event per component that reads or writes a resource."""
    rows = relations.where("type in ('readsResource', 'writesResource')")
    names = lambda kind: F.transform(F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("dst")))), lambda x: F.struct(F.lit("catalog").alias("namespace"), x.alias("name")))
    grouped = rows.groupBy("src").agg(names("readsResource").alias("inputs"), names("writesResource").alias("outputs"))
    event = F.to_json(F.struct(F.lit("COMPLETE").alias("eventType"), F.lit(now).alias("eventTime"), F.struct(F.lit("catalog").alias("namespace"), F.col("src").alias("name")).alias("job"), "inputs", "outputs"))
    return grouped.select(F.col("src").alias("job"), event.alias("event"))


def system_pages(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(system, component, at, line): Markdown lines of each owner's components with all they read and write, in the order (system, component, at).

    One row per line, so a page of any length is spread over tasks; line 0 names the component.
    """
    owned = entities.where("kind = 'Component'").select("ref", "name", F.col("owner").alias("system"))
    edges = relations.select("src", "type", "dst").distinct().join(owned.withColumnRenamed("ref", "src"), "src")
    at = F.row_number().over(Window.partitionBy("system", "name", "src").orderBy("type", "dst"))
    lines = edges.select("system", F.col("name").alias("component"), at.alias("at"), F.concat(F.lit("  - "), "type", F.lit(" "), "dst").alias("line"))
    return owned.select("system", F.col("name").alias("component"), F.lit(0).alias("at"), F.concat(F.lit("- "), "name").alias("line")).unionByName(lines)
