"""Traces over the driver tables: customers depend on suppliers, which produce, consume, write and read parts as resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import merge, trace
from factloom.plans.binding import depends, documents, entities, facts, table, with_ctes
from factloom.plans.registry import query

_FORM = "CASE p_size % 4 WHEN 0 THEN 'topic' WHEN 1 THEN 'queue' WHEN 2 THEN 'virtual-topic' ELSE 'database' END"
_TYPES = ("dependsOn", "producesMessage", "writesResource", "readsResource")
_CALLS = """SELECT concat('provider:', o_custkey) AS src, 'dependsOn' AS type, concat('component:', l_suppkey) AS dst, count(*) AS n_evidence,
    min(CASE WHEN l_quantity < 25 THEN 'high' ELSE 'low' END) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
_EDGES = f"SELECT src, type, dst, n_evidence, confidence FROM relations UNION ALL ({_CALLS})"
_NODES = f"SELECT e.ref, e.kind, {_FORM} AS type FROM entities e LEFT JOIN part p ON e.ref = concat('resource:', p_partkey)"
_RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    calls = rows.groupBy(F.expr("concat('provider:', o_custkey)").alias("src"), F.lit("dependsOn").alias("type"), F.expr("concat('component:', l_suppkey)").alias("dst"))
    calls = calls.agg(F.count("*").alias("n_evidence"), F.min(F.expr("CASE WHEN l_quantity < 25 THEN 'high' ELSE 'low' END")).alias("confidence"))
    return merge.merge_relations(facts(spark, sf_dir)).select("src", "type", "dst", "n_evidence", "confidence").unionByName(calls)


def nodes(spark, sf_dir):
    forms = table(spark, sf_dir, "part").select(F.expr("concat('resource:', p_partkey)").alias("ref"), F.expr(_FORM).alias("type"))
    return entities(spark, sf_dir).select("ref", "kind").join(forms, "ref", "left")


def _walk(start: str, ended: str, hops: int = 6, fanout: int = 12, types: tuple = _TYPES, least: int | None = None, most: int = 5000, follow: bool = True) -> str:
    """A recursion over levels: the rows of a level see the steps and branch numbers that the levels before have used."""
    ranks = ", ".join(f"('{t}', {k})" for k, t in enumerate(types))
    sure = "" if least is None else f"WHERE {_RANK} >= {least}"
    heard = f"CASE WHEN {follow} AND f.type = 'producesMessage' AND v.kind = 'Resource' AND v.type IN ('topic', 'queue', 'virtual-topic') AND NOT ({ended}) THEN list_filter(h.cs, lambda x: NOT list_contains(list_append(w.path, f.dst), x.c)) ELSE [] END"
    return with_ctes(f""", kinds(type, k) AS (VALUES {ranks}), every AS ({_EDGES}), edges AS (SELECT * FROM every {sure}), nodes AS ({_NODES}),
    fan AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, dst) - 1 AS i FROM (SELECT e.*, k, row_number() OVER (PARTITION BY src, type ORDER BY dst) AS n FROM edges e JOIN kinds USING (type)) WHERE n <= {fanout}),
    hearers AS (SELECT dst AS sent, list({{'c': src, 'n': n_evidence, 'f': confidence}} ORDER BY src) AS cs FROM edges WHERE type = 'consumesMessage' GROUP BY dst),
    walk AS (SELECT 0::BIGINT AS step, 0::BIGINT AS seq, 0 AS lvl, '0' AS branch, 0 AS depth, '' AS src, ({start}) AS dst, '' AS type, 0::BIGINT AS n_evidence, '' AS confidence, false AS is_async, false AS ended, [({start})] AS path
    UNION ALL SELECT step, seq, lvl, CASE WHEN j = 0 THEN opened ELSE concat(opened, '.async', seq) END, CASE WHEN j = 0 THEN depth + 1 ELSE depth + 2 END, CASE WHEN j = 0 THEN node ELSE dst END, CASE WHEN j = 0 THEN dst ELSE cs[j].c END,
        CASE WHEN j = 0 THEN type ELSE 'consumesMessage' END, CASE WHEN j = 0 THEN n_evidence ELSE cs[j].n END, CASE WHEN j = 0 THEN confidence ELSE cs[j].f END, j > 0, j = 0 AND ended,
        CASE WHEN j = 0 THEN list_append(path, dst) ELSE list_append(list_append(path, dst), cs[j].c) END
        FROM (SELECT *, CASE WHEN i = 0 THEN branch ELSE concat(branch, '.', seq - j) END AS opened FROM
            (SELECT * EXCLUDE (steps, seqs), steps + row_number() OVER (ORDER BY pos, i, j) AS step, (seqs + sum(CASE WHEN i > 0 OR j > 0 THEN 1 ELSE 0 END) OVER (ORDER BY pos, i, j ROWS UNBOUNDED PRECEDING))::BIGINT AS seq FROM
                (SELECT *, unnest(range(0, len(cs) + 1)) AS j FROM
                    (SELECT w.steps, w.seqs, w.lvl + 1 AS lvl, w.step AS pos, w.branch, w.depth, w.dst AS node, w.path, f.dst, f.type, f.i, f.n_evidence, f.confidence, ({ended}) AS ended, coalesce({heard}, []) AS cs
                    FROM (SELECT *, max(step) OVER () AS steps, max(seq) OVER () AS seqs FROM walk) w JOIN fan f ON f.src = w.dst LEFT JOIN nodes v ON v.ref = f.dst LEFT JOIN hearers h ON h.sent = f.dst
                    WHERE NOT w.ended AND w.depth < {hops} AND w.steps < {most} AND NOT list_contains(w.path, f.dst)))))) """, "facts", "relations", "entities").replace("WITH ", "WITH RECURSIVE ", 1).replace(") , kinds", "), kinds", 1)  # fmt: skip


_HOPS = " SELECT step, branch, depth, src, dst, type, n_evidence, confidence, is_async FROM walk WHERE lvl > 0"
_TERMINALS = """, levels AS (SELECT lvl, max(max(step)) OVER (ORDER BY lvl) AS steps FROM walk GROUP BY lvl)
    SELECT DISTINCT w.dst AS ref FROM walk w JOIN levels USING (lvl) WHERE w.ended OR (w.dst NOT IN (SELECT src FROM fan) AND steps < {0}) OR (w.depth >= {1} AND steps < {0})"""


@query("trace_hops", _walk("'provider:1'", "false") + _HOPS)
def trace_hops(spark, sf_dir):
    """The defaults: six hops, twelve edges a type, consumers behind messages."""
    return trace.trace(edges(spark, sf_dir), nodes(spark, sf_dir), "provider:1", types=_TYPES).hops


@query("trace_terminals", _walk("'component:1'", "v.kind = 'Component'", fanout=40) + _TERMINALS.format(5000, 6))
def trace_terminals(spark, sf_dir):
    return trace.trace(edges(spark, sf_dir), nodes(spark, sf_dir), "component:1", "kind:Component", fanout=40, types=_TYPES).terminals


_NAMED = "SELECT ref FROM entities WHERE lower(name) = 'supplier#000000002'"
_ENDED = "SELECT ref FROM entities WHERE contains(lower(name), 'or#00000001') ORDER BY CASE kind WHEN 'Component' THEN 0 WHEN 'Provider' THEN 1 WHEN 'Resource' THEN 2 ELSE 3 END, length(name), pos LIMIT 1"


@query("trace_resolved", _walk(_NAMED, f"f.dst IS NOT DISTINCT FROM ({_ENDED})", hops=4, fanout=5, types=("writesResource", "producesMessage"), least=1, most=300) + _HOPS)
def trace_resolved(spark, sf_dir):
    """Start and end by name; types in the caller's order; a bound on confidence; no level begun beyond 300 hops."""
    known = entities(spark, sf_dir).withColumn("aliases", F.array("owner"))
    start, end = trace.resolved(known, "Supplier#000000002"), trace.resolved_end(known, "or#00000001")
    return trace.trace(edges(spark, sf_dir), nodes(spark, sf_dir), start, end, hops=4, fanout=5, types=["writesResource", "producesMessage"], least="low", most=300).hops
