"""Static API enrichment over the driver tables: parts as APIs of fifty repositories, line items as specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import enrich
from factloom.plans.binding import table
from factloom.plans.registry import query

_WORDS = "p_brand, '{0}', CAST(floor(p_retailprice) AS BIGINT) % 97"
_REPO, _NAME = "concat('acme/', p_size)", "concat(" + _WORDS.format(" ") + ", CASE WHEN p_partkey % 2 = 0 THEN ' REST API' ELSE ' Service' END)"
_SPEC = "concat('openapi ', " + _WORDS.format("-") + ", ' contract')"
_ORD, _RULE = "l_orderkey * 10 + l_linenumber", "CASE l_returnflag WHEN 'R' THEN 'openapi' WHEN 'A' THEN 'graphql' ELSE 'protobuf' END"
_CALLS = (("'GET'", "concat('/o', l_orderkey % 11)", "''"), ("'POST'", "''", "concat('op', l_linenumber)"))
_OWN = (("'GET'", "'/o3'", "'third'"), ("'POST'", "''", "'op2'"))
_CITE, _OWN_CITE = ("concat('spec', l_suppkey % 5, '.yaml')", "l_linenumber", "'paths:'"), ("'spec1.yaml'", "2", "'paths:'")
_OPERATION, _PLACE = ("method", "path", "name"), ("path", "line", "snippet")


def _spark(names, *rows) -> str:
    return "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {x}" for n, x in zip(names, row, strict=True)) + ")" for row in rows) + ")"


def _duck(names, *rows) -> str:
    return "[" + ", ".join("{" + ", ".join(f"'{n}': {x}" for n, x in zip(names, row, strict=True)) + "}" for row in rows) + "]"


def apis(spark, sf_dir):
    made = "CASE WHEN p_size % 2 = 0 THEN array('openapi') END"
    return table(spark, sf_dir, "part").select(F.expr(_REPO).alias("repo"), F.col("p_partkey").alias("pos"), F.expr(_NAME).alias("name"), F.expr(_spark(_OPERATION, *_OWN)).alias("operations"), F.expr(_spark(_PLACE, _OWN_CITE)).alias("evidence"), F.expr(made).alias("emitted_by"))


def specs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return rows.select(F.expr(_REPO).alias("repo"), F.expr(_ORD).alias("ord"), F.expr(_SPEC).alias("name"), F.expr(_RULE).alias("rule"), F.expr(_spark(_OPERATION, *_CALLS)).alias("operations"), F.expr(_spark(_PLACE, _CITE)).alias("evidence"))


_KEYED = "array_to_string(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w NOT IN ('rest', 'api', 'service', 'openapi', 'contract')), '')"
_CTES = f"""WITH apis AS (SELECT {_REPO} AS repo, p_partkey AS pos, {_NAME} AS name, {_KEYED.format(_NAME)} AS key, CASE WHEN p_size % 2 = 0 THEN ['openapi'] ELSE [] END AS emitted_by FROM part),
specs AS (SELECT {_REPO} AS repo, {_ORD} AS ord, {_KEYED.format(_SPEC)} AS key, {_RULE} AS rule, {_duck(_OPERATION, *_CALLS)} AS operations, {_duck(_PLACE, _CITE)} AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey),
targets AS (SELECT repo, key, min(pos) AS pos FROM apis GROUP BY repo, key HAVING count(*) = 1),
met AS (SELECT s.*, pos FROM specs s JOIN targets USING (repo, key)),
ops AS (SELECT pos, repo, min((ord, k)) AS seat, m, p FROM (SELECT pos, repo, ord, k, operations[k].method AS m, CASE WHEN operations[k].path <> '' THEN operations[k].path ELSE operations[k].name END AS p FROM met, unnest([1, 2]) t(k))
    WHERE (m, p) NOT IN (VALUES ('GET', '/o3'), ('POST', 'op2')) GROUP BY pos, repo, m, p)"""


@query("enriched_apis", f"""{_CTES},
cites AS (SELECT pos, min(ord) AS seat, e FROM (SELECT pos, ord, concat(evidence[1].path, ':', evidence[1].line) AS e FROM met) WHERE e <> 'spec1.yaml:2' GROUP BY pos, e),
made AS (SELECT pos, min(ord) AS seat, rule FROM met JOIN apis USING (pos) WHERE NOT list_contains(emitted_by, rule) GROUP BY pos, rule)
SELECT repo, pos, name, concat('GET /o3, POST op2', (SELECT string_agg(concat(', ', m, ' ', p), '' ORDER BY seat, m, p) FROM ops o WHERE o.pos = a.pos)) AS operations,
    concat('spec1.yaml:2', (SELECT string_agg(concat(', ', e), '' ORDER BY seat, e) FROM cites c WHERE c.pos = a.pos)) AS evidence,
    coalesce(array_to_string(list_concat(emitted_by, (SELECT list(rule ORDER BY seat, rule) FROM made d WHERE d.pos = a.pos)), ','), '') AS emitted_by FROM apis a""")
def enriched_apis(spark, sf_dir):
    shown = lambda c, f: F.array_join(F.transform(c, f), ", ").alias(c)
    found = enrich.enriched(apis(spark, sf_dir), specs(spark, sf_dir))
    call = lambda o: F.concat(o["method"], F.lit(" "), F.coalesce(F.nullif(o["path"], F.lit("")), o["name"]))
    return found.select("repo", "pos", "name", shown("operations", call), shown("evidence", lambda e: F.concat_ws(":", e["path"], e["line"])), F.coalesce(F.array_join("emitted_by", ","), F.lit("")).alias("emitted_by"))


@query("api_enrichment", f"""{_CTES} SELECT repo, facts, coalesce(merged_apis, 0) AS merged_apis, coalesce(operations_added, 0) AS operations_added FROM (SELECT repo, count(*) AS facts FROM specs GROUP BY repo)
    LEFT JOIN (SELECT repo, count(DISTINCT (pos, seat[1])) AS merged_apis, count(*) AS operations_added FROM ops GROUP BY repo) USING (repo)""")
def api_enrichment(spark, sf_dir):
    return enrich.enrichment(apis(spark, sf_dir), specs(spark, sf_dir))
