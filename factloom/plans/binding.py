"""The driver tables read as a catalog: entities, relation facts, documents, citations, events.

Each function has an SQL twin in CTES for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a partition of the facts, on average.
PART_ROWS = 100_000
PRIORITY = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'review' END"
EDGE = "CASE WHEN l_returnflag = 'R' THEN 'producesMessage' WHEN l_returnflag = 'A' THEN 'consumesMessage' WHEN l_linestatus = 'O' THEN 'writesResource' ELSE 'readsResource' END"
BALANCE = "CASE WHEN s_acctbal < 0 THEN 'review' WHEN s_acctbal > 5000 THEN 'high' WHEN s_acctbal > 2000 THEN 'medium' ELSE 'low' END"
_COLUMNS = ("ref", "kind", "name", "owner", "tag", "confidence", "pos")
_ENTITIES = {
    "supplier": ("concat('component:', s_suppkey)", "'Component'", "s_name", "concat('nation-', s_nationkey)", "''", BALANCE, "s_suppkey"),
    "part": ("concat('resource:', p_partkey)", "'Resource'", "p_name", "p_brand", "p_type", "'medium'", "200000000000 + p_partkey"),
    "customer": ("concat('provider:', c_custkey)", "'Provider'", "c_name", "c_mktsegment", "''", "'high'", "100000000000 + c_custkey"),
    "nation": ("concat('system:', n_nationkey)", "'System'", "n_name", "'unknown'", "''", "CAST(NULL AS string)", "400000000000 + n_nationkey"),
    "region": ("concat('domain:', r_regionkey)", "'Domain'", "r_name", "'unknown'", "''", "CAST(NULL AS string)", "500000000000 + r_regionkey"),
}
_FACT = {
    "src": "concat('component:', l_suppkey)", "type": EDGE, "dst": "concat('resource:', l_partkey)", "path": "l_orderkey", "line": "l_linenumber",
    "confidence": PRIORITY, "protocol": "CASE WHEN l_linestatus = 'O' THEN 'http' ELSE '' END", "ord": "l_orderkey * 10 + l_linenumber",
}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts, customers, nations and regions as entities: (ref, kind, name, owner, tag, confidence, pos)."""
    out = None
    for name, parts in _ENTITIES.items():
        rows = table(spark, sf_dir, name).select(*(F.expr(x).alias(c) for x, c in zip(parts, _COLUMNS, strict=True))).withColumn("pos", F.col("pos").cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relation facts from a supplier to a part.

    They are dealt out by relation before anything is merged, into parts of about PART_ROWS: nearly all of a relation's
    evidence differs, so merging it where it is read holds a task's whole share of the input.  Line items meet their orders
    in as many parts, once those are more than a shuffle's: the join sorts its share as well.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = lines.count() // PART_ROWS + 1
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey"))
    return joined.select(*(F.expr(x).alias(c) for c, x in _FACT.items())).repartition(parts, "src", "type", "dst")


def depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dependsOn from customers to suppliers: (src, dst, path, confidence)."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return joined.select(F.expr("concat('provider:', o_custkey)").alias("src"), F.expr("concat('component:', l_suppkey)").alias("dst"), F.col("l_orderkey").alias("path"), F.expr(PRIORITY).alias("confidence"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, haystack, confidence): documents as searchable entities, confidence from their quality label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'review' END").alias("confidence"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("haystack"))
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("ref"), "haystack", "confidence")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, ord, ts, event, cost): a log whose runs are users."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), "ts", F.col("event_type").alias("event"), F.col("value").alias("cost"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact, path, line, snippet, confidence): line items as facts that cite a line of a document, in truth or not."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "snippet"))
    rows = lines.where("length(trim(snippet)) > 0")
    return rows.select(
        F.expr("path * 100000 + at").alias("fact"), F.col("path").cast("string").alias("path"), F.expr("CASE WHEN at % 2 = 0 THEN at + 1 ELSE at + 4 END").alias("line"),
        F.expr("CASE WHEN at % 5 = 1 THEN concat(snippet, ' entirely otherwise worded') WHEN at % 5 = 2 THEN 'nothing of this kind' ELSE snippet END").alias("snippet"),
        F.expr("CASE WHEN at % 4 = 0 THEN 'low' WHEN at % 4 = 1 THEN 'medium' ELSE 'high' END").alias("confidence"),
    )


CTES = {
    "entities": " UNION ALL ".join("SELECT " + ", ".join(f"{x} AS {c}" for x, c in zip(parts, _COLUMNS, strict=True)) + f" FROM {name}" for name, parts in _ENTITIES.items()),
    "facts": "SELECT " + ", ".join(f"{x} AS {c}" for c, x in _FACT.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "relations": """SELECT src, type, dst, count(DISTINCT {'p': path, 'l': line}) AS n_evidence, min(path * 10 + line) AS first_evidence,
        CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence,
        min_by(protocol, ord) FILTER (WHERE protocol <> '') AS protocol FROM facts GROUP BY src, type, dst""",
    "docs": "SELECT d.doc_id AS ref, lower(text) AS haystack, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'review' END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "log": "SELECT user_id AS run, event_id AS ord, ts, event_type AS event, value AS cost FROM events",
    "cited": """SELECT path * 100000 + k AS fact, path, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k + 4 END AS line,
        CASE WHEN k % 5 = 1 THEN snippet || ' entirely otherwise worded' WHEN k % 5 = 2 THEN 'nothing of this kind' ELSE snippet END AS snippet,
        CASE WHEN k % 4 = 0 THEN 'low' WHEN k % 4 = 1 THEN 'medium' ELSE 'high' END AS confidence
        FROM (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS snippet, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)
        WHERE length(trim(snippet)) > 0""",
    "lines": r"""SELECT path, line, text FROM (SELECT doc_id AS path, unnest(string_split(regexp_replace(text, '\r?\n$', ''), chr(10))) AS text,
        unnest(range(1, 1 + len(string_split(regexp_replace(text, '\r?\n$', ''), chr(10))))) AS line FROM documents WHERE text <> '')""",
}


def with_ctes(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " " + sql
