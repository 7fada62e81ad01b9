"""Merges that keep evidence, over the driver tables: line items as facts on edges of suppliers and groups of parts, parts as facts on brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import evidence
from factloom.plans.binding import EDGE, PRIORITY, table
from factloom.plans.registry import query

_EDGE = {"src": "concat('Component:', l_suppkey)", "type": EDGE, "dst": "concat('Resource:', l_partkey % 40)", "ord": "l_orderkey * 10 + l_linenumber", "confidence": PRIORITY}
_CITED = (("concat('f', l_orderkey % 97, '.py')", "l_linenumber", "concat('order ', l_orderkey)"), ("'README.md'", "CAST(l_quantity AS INT)", "concat('read ', l_orderkey)"))
_PROPERTIES = {"aliases": ("l_returnflag", "concat('a', l_orderkey % 13)"), "transports": ("CASE l_linestatus WHEN 'O' THEN 'http' ELSE 'queue' END",), "operation": ("concat('op', l_orderkey)",)}
_TEXTS = {"kind": "CASE WHEN p_size > 25 THEN 'Resource' END", "title": "CASE WHEN p_size % 4 = 0 THEN p_type ELSE '' END", "description": "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END"}
_LISTS = {"tags": ("lower(p_type)", "concat('size-', p_size % 5)"), "aliases": ("p_name",), "source_repos": ("concat('acme/', p_size)",)}
_ITEMS = {"attributes": ("attribute", "concat('size ', p_size)", "meaning", "p_name"), "glossary": ("term", "p_type", "definition", "concat(p_name, ' part')")}
_SURE = "CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 30 THEN 'medium' WHEN p_size < 45 THEN 'review' END"


def _cites(*cited) -> str:
    return "array(" + ", ".join(f"named_struct('path', {p}, 'line', {n}, 'snippet', {s})" for p, n, s in cited) + ")"


def _shown(rows, *more):
    place = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["path"], e["line"], e["snippet"])), "; ")
    return rows.select(*more, "n_evidence", place.alias("evidence"), "evidence_file", "confidence")


_PLACES = """one AS (SELECT {0}, path, line, arg_min(snippet, (ord, k)) AS snippet, min((ord, k)) AS seat FROM cited GROUP BY {0}, path, line),
proof AS (SELECT {0}, count(*) AS n_evidence, array_to_string(list(concat_ws(':', path, line, snippet) ORDER BY seat)[1:8], '; ') AS evidence, arg_min(path, seat) AS evidence_file FROM one GROUP BY {0})"""
_RANK = "CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'review' THEN 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' WHEN 0 THEN 'review' END AS confidence"


@query("relation_evidence", f"""WITH facts AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _EDGE.items())}, {', '.join(f'[{", ".join(v)}] AS {n}' for n, v in _PROPERTIES.items())},
    [{', '.join(f"{{'path': {p}, 'line': {n}, 'snippet': {s}}}" for p, n, s in _CITED)}] AS cites, l_linenumber > 1 AS told FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cited AS (SELECT src, type, dst, ord, k, cites[k].path AS path, cites[k].line AS line, cites[k].snippet AS snippet FROM facts, unnest([1, 2]) t(k)), {_PLACES.format('src, type, dst')},
sure AS (SELECT src, type, dst, {_RANK} FROM facts GROUP BY src, type, dst),
props AS (SELECT src, type, dst, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') AS aliases, array_to_string(list_sort(list_distinct(flatten(list(transports)))), ',') AS transports, arg_min(operation[1], ord) AS operation FROM facts WHERE told GROUP BY src, type, dst)
SELECT src, type, dst, aliases, transports, operation, n_evidence, evidence, evidence_file, confidence FROM sure JOIN proof USING (src, type, dst) LEFT JOIN props USING (src, type, dst)""")
def relation_evidence(spark, sf_dir):
    properties = "map(" + ", ".join(f"'{n}', array({', '.join(v)})" for n, v in _PROPERTIES.items()) + ")"
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = evidence.parts(spark, lines.count())
    facts = lines.repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), F.expr("l_orderkey = o_orderkey")).select(
        *(F.expr(x).alias(c) for c, x in _EDGE.items()), F.expr(_cites(*_CITED)).alias("evidence"), F.expr(f"CASE WHEN l_linenumber > 1 THEN {properties} END").alias("properties"))
    of = lambda n: F.array_join(F.col("properties")[n], ",").alias(n)
    return _shown(evidence.merge_relations(facts), "src", "type", "dst", *map(of, _PROPERTIES))


_REF = "concat('Resource:', p_brand)"
_CITE = ("concat('p', p_size, '.md')", "CAST(p_partkey % 7 AS INT)", "p_name")


@query("entity_evidence", f"""WITH facts AS (SELECT {_REF} AS ref, p_partkey AS ord, {', '.join(f'{x} AS {c}' for c, x in _TEXTS.items())}, {', '.join(f'[{", ".join(v)}] AS {n}' for n, v in _LISTS.items())},
    {', '.join(f'{key} AS {c}_key, {value} AS {c}_value' for c, (_, key, _, value) in _ITEMS.items())}, {_SURE} AS confidence, {', '.join(f'{x} AS {c}' for x, c in zip(_CITE, ('path', 'line', 'snippet'), strict=True))} FROM part),
cited AS (SELECT ref, ord, 0 AS k, path, line, snippet FROM facts), {_PLACES.format('ref')},
merged AS (SELECT ref, {', '.join(f"arg_min({c}, ord) FILTER (WHERE {c} <> '') AS {c}" for c in _TEXTS)}, {', '.join(f"array_to_string(list_sort(list_distinct(flatten(list({n})))), ',') AS {n}" for n in _LISTS)}, {_RANK} FROM facts GROUP BY ref),
{', '.join(f"{c} AS (SELECT ref, string_agg(concat(x, '=', v), '; ' ORDER BY o) AS {c} FROM (SELECT ref, {c}_key AS x, arg_min({c}_value, ord) AS v, min(ord) AS o FROM facts GROUP BY ref, {c}_key) GROUP BY ref)" for c in _ITEMS)}
SELECT ref, {', '.join((*_TEXTS, *_LISTS, *_ITEMS))}, n_evidence, evidence, evidence_file, confidence FROM merged JOIN proof USING (ref) JOIN attributes USING (ref) JOIN glossary USING (ref)""")
def entity_evidence(spark, sf_dir):
    items = {c: f"array(named_struct('{key}', {k}, '{value}', {v}))" for c, (key, k, value, v) in _ITEMS.items()}
    lists = {c: f"array({', '.join(v)})" for c, v in _LISTS.items()}
    every = {"ref": _REF, "ord": "p_partkey", **_TEXTS, **lists, **items, "confidence": _SURE, "evidence": _cites(_CITE)}
    merged = evidence.merge_entities(table(spark, sf_dir, "part").select(*(F.expr(x).alias(c) for c, x in every.items())))
    joined = [F.array_join(c, ",").alias(c) for c in _LISTS]
    told = [F.array_join(F.transform(c, _pair(*_ITEMS[c][::2])), "; ").alias(c) for c in _ITEMS]
    return _shown(merged, "ref", *_TEXTS, *joined, *told)


def _pair(key: str, value: str):
    return lambda i: F.concat(i[key], F.lit("="), i[value])
