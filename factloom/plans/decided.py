"""People's decisions over the driver tables: orders as decisions on their customers, of every action."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import decisions, passes
from factloom.plans.binding import table
from factloom.plans.registry import query

_ACTION = """CASE o_orderkey % 14 WHEN 0 THEN 'mark_external' WHEN 1 THEN 'link' WHEN 2 THEN 'merge' WHEN 3 THEN 'merge' WHEN 4 THEN 'merge' WHEN 5 THEN 'skip' WHEN 6 THEN 'set_tagline' WHEN 7 THEN 'set_owner'
    WHEN 8 THEN 'set_lifecycle' WHEN 9 THEN 'add_alias' WHEN 10 THEN 'remove_alias' WHEN 11 THEN 'add_dependency' WHEN 12 THEN 'remove_dependency' ELSE 'archive' END"""
_LOG = {
    "ord": "CAST(o_orderdate AS date)", "entity": "concat('provider:', o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1000000000 ELSE 0 END)", "action": _ACTION,
    "value": """CASE o_orderkey % 14 WHEN 8 THEN CASE o_custkey % 3 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'retired' ELSE ' experimental ' END WHEN 9 THEN concat('c', o_custkey % 30)
        WHEN 10 THEN CASE WHEN o_custkey % 2 = 0 THEN concat('customer#', lpad(CAST(o_custkey AS string), 9, '0')) ELSE 'none' END ELSE CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE o_orderpriority END END""",
    "target": "CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('component:', o_orderkey % 50 + 1) END",
    "relation_type": "CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'dependsOn' ELSE 'consumesApi' END",
    "into": "concat('provider:', CASE o_custkey % 5 WHEN 0 THEN o_custkey + 1 WHEN 1 THEN o_custkey - 1 ELSE o_custkey % 97 + 1 END)",
    "repo": "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('org/repo-', o_custkey) END", "category": "CASE WHEN o_custkey % 2 = 0 THEN 'saas' END", "reason": "''",
}
_OWN = {
    "ref": "concat('provider:', c_custkey)", "name": "c_name", "description": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END", "tagline": "c_mktsegment", "owner": "concat('nation-', c_nationkey)",
    "lifecycle": "'production'", "category": "CAST(NULL AS string)", "external": "c_acctbal < 0", "source_location": "CAST(NULL AS string)", "n_evidence": "CAST(1 AS bigint)",
}
_CALLS = ("concat('provider:', o_custkey)", "'dependsOn'", "concat('component:', l_suppkey)")
_BACK = ("concat('component:', l_suppkey)", "'consumesApi'", "concat('provider:', o_custkey)")
_TALKS = ("concat('provider:', o_custkey)", "'communicatesWith'", "concat('provider:', o_custkey % 97 + 1)")
_SURE = "min(CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'medium' END)"


def entities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("*", *(F.expr(x).alias(c) for c, x in _OWN.items()))
    aliases = F.array(F.lower("c_name"), F.concat(F.lit("c"), "c_nationkey"))
    return rows.select(*_OWN, F.array().cast("array<string>").alias("source_repos"), aliases.alias("aliases"), F.array("c_mktsegment").alias("tags"))


def relations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    out = None
    for rows, ends in ((lines, _CALLS), (lines.where("l_returnflag = 'R'"), _BACK), (orders.where("o_orderstatus = 'F'"), _TALKS)):
        found = rows.groupBy(*(F.expr(x).alias(c) for c, x in zip(("src", "type", "dst"), ends, strict=True))).agg(F.count("*").alias("n_evidence"), F.expr(_SURE).alias("confidence"))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("source", F.lit("code"))


def log(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*(F.expr(x).alias(c) for c, x in _LOG.items()))


def decided(spark, sf_dir) -> decisions.Decided:
    return decisions.decide(entities(spark, sf_dir), relations(spark, sf_dir), log(spark, sf_dir))


def _edge(parts: tuple, source: str) -> str:
    return f"SELECT {parts[0]} AS src, {parts[1]} AS type, {parts[2]} AS dst, count(*) AS n_evidence, {_SURE} AS confidence, 'code' AS source FROM {source} GROUP BY ALL"


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_BASE = f"""WITH RECURSIVE log AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _LOG.items())} FROM orders),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ord DESC, action DESC, value DESC, target DESC, relation_type DESC, "into" DESC, repo DESC, category DESC NULLS LAST, reason DESC) = 1),
entities AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _OWN.items())}, []::VARCHAR[] AS source_repos, [lower(c_name), concat('c', c_nationkey)] AS aliases, [c_mktsegment] AS tags FROM customer),
edges AS ({_edge(_CALLS, _LINES)} UNION ALL ({_edge(_BACK, _LINES + " WHERE l_returnflag = 'R'")}) UNION ALL ({_edge(_TALKS, "orders WHERE o_orderstatus = 'F'")})),
told AS (SELECT l.*, CASE WHEN e.ref IS NULL AND action NOT IN ('merge', 'add_dependency', 'remove_dependency') THEN 'missing' WHEN action = 'archive' THEN 'unknown'
    WHEN action IN ('set_tagline', 'set_owner', 'add_alias', 'remove_alias') AND trim(value) = '' THEN 'invalid' WHEN action = 'set_lifecycle' AND trim(value) NOT IN ('production', 'experimental', 'deprecated') THEN 'invalid'
    WHEN action = 'add_alias' AND list_contains(aliases, trim(value)) THEN 'unchanged' WHEN action = 'remove_alias' AND NOT list_contains(aliases, trim(value)) THEN 'unchanged'
    WHEN action = 'merge' AND l."into" = entity THEN 'invalid' WHEN action = 'merge' AND e.ref IS NULL THEN 'done' WHEN action = 'merge' AND l."into" NOT IN (SELECT ref FROM entities) THEN 'invalid'
    WHEN action IN ('add_dependency', 'remove_dependency') AND target = '' THEN 'invalid' ELSE 'applied' END AS outcome FROM last l LEFT JOIN entities e ON e.ref = l.entity)"""
_ENDS = f"""{_BASE}, done AS (SELECT * FROM told WHERE outcome = 'applied'), pairs AS (SELECT entity AS old, "into" AS new, ord FROM done WHERE action = 'merge'),
ways AS (SELECT old, new AS to_, [old] AS seen FROM pairs UNION ALL SELECT w.old, p.new, list_append(seen, w.to_) FROM ways w JOIN pairs p ON p.old = w.to_ WHERE NOT list_contains(seen, w.to_)),
void AS (SELECT w.old FROM (SELECT old, unnest(seen) AS member FROM ways WHERE to_ = old) w JOIN pairs p ON p.old = w.member GROUP BY w.old HAVING min({{'o': p.ord, 'k': p.old}}).k = w.old),
chains AS (SELECT old, new AS to_ FROM pairs WHERE old NOT IN (SELECT old FROM void) UNION ALL SELECT c.old, p.new FROM chains c JOIN pairs p ON p.old = c.to_ WHERE p.old NOT IN (SELECT old FROM void)),
ends AS (SELECT old, to_ AS new FROM chains WHERE to_ NOT IN (SELECT old FROM pairs WHERE old NOT IN (SELECT old FROM void))),
own AS (SELECT e.* REPLACE (CASE action WHEN 'mark_external' THEN true WHEN 'link' THEN false ELSE external END AS external, CASE WHEN action = 'mark_external' THEN coalesce(d.category, 'other') ELSE e.category END AS category,
    CASE WHEN action = 'link' AND repo <> '' THEN [repo] ELSE source_repos END AS source_repos, CASE WHEN action = 'link' AND repo <> '' THEN concat('url:https://github.com/', repo, '/') ELSE source_location END AS source_location,
    CASE WHEN action = 'set_tagline' THEN trim(value) ELSE tagline END AS tagline, CASE WHEN action = 'set_owner' THEN trim(value) ELSE owner END AS owner, CASE WHEN action = 'set_lifecycle' THEN trim(value) ELSE lifecycle END AS lifecycle,
    CASE action WHEN 'add_alias' THEN list_sort(list_distinct(list_append(aliases, trim(value)))) WHEN 'remove_alias' THEN list_filter(aliases, lambda a: a <> trim(value)) ELSE aliases END AS aliases) FROM entities e LEFT JOIN done d ON d.entity = e.ref),
folded AS (SELECT n.new AS ref, list_distinct(flatten(list(list_append(aliases, name)))) AS a, list_distinct(flatten(list(tags))) AS t, sum(n_evidence) AS n, min_by(description, o.ref) FILTER (WHERE description <> '') AS d FROM own o JOIN ends n ON n.old = o.ref GROUP BY n.new)"""


@query("decision_outcomes", f"{_BASE} SELECT entity, action, outcome FROM told")
def decision_outcomes(spark, sf_dir):
    return decisions.outcomes(decisions.last_decisions(log(spark, sf_dir)), entities(spark, sf_dir)).select("entity", "action", "outcome")


@query("decided_entities", f"""{_ENDS} SELECT o.ref, name, CASE WHEN description = '' THEN coalesce(d, description) ELSE description END AS description, tagline, owner, lifecycle, category, external, source_location, array_to_string(source_repos, ',') AS source_repos,
    array_to_string(CASE WHEN f.ref IS NULL THEN aliases ELSE list_sort(list_distinct(list_concat(aliases, a))) END, ',') AS aliases, array_to_string(CASE WHEN f.ref IS NULL THEN tags ELSE list_sort(list_distinct(list_concat(tags, t))) END, ',') AS tags,
    (n_evidence + coalesce(n, 0))::BIGINT AS n_evidence FROM own o LEFT JOIN folded f USING (ref) WHERE o.ref NOT IN (SELECT old FROM ends)""")
def decided_entities(spark, sf_dir):
    return decided(spark, sf_dir).entities.withColumns({c: F.array_join(c, ",") for c in ("source_repos", "aliases", "tags")})


@query("decided_relations", f"""{_ENDS}, moved AS (SELECT e.src AS s, e.type, e.dst AS d, coalesce(a.new, e.src) AS src, coalesce(b.new, e.dst) AS dst, n_evidence, confidence FROM edges e LEFT JOIN ends a ON a.old = e.src LEFT JOIN ends b ON b.old = e.dst),
    merged AS (SELECT src, type, dst, sum(n_evidence)::BIGINT AS n_evidence, first(confidence ORDER BY s, d) AS confidence, 'code' AS source FROM moved WHERE src <> dst GROUP BY src, type, dst),
    kept AS (SELECT * FROM merged m WHERE NOT EXISTS (SELECT 1 FROM done g WHERE g.action = 'remove_dependency' AND g.entity = m.src AND g.target = m.dst AND g.relation_type IN ('', m.type)))
    SELECT * FROM kept UNION ALL SELECT DISTINCT entity, CASE relation_type WHEN '' THEN 'dependsOn' ELSE relation_type END AS t, target, 0, 'review', 'triage' FROM done g WHERE action = 'add_dependency'
        AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.src = g.entity AND k.dst = g.target AND k.type = CASE g.relation_type WHEN '' THEN 'dependsOn' ELSE g.relation_type END)""")
def decided_relations(spark, sf_dir):
    return decided(spark, sf_dir).relations


def _twins(spark, sf_dir):
    """Customers whose number 3 divides are sourced and named shop-1, shop-2, ...; others are called acme-shop and that."""
    rows = table(spark, sf_dir, "customer").selectExpr("concat('provider:', c_custkey) AS ref", "c_custkey AS k", "CAST(NULL AS array<string>) AS aliases", "c_custkey AS pos")
    name = F.expr("CASE WHEN k % 3 = 0 THEN concat('shop', k div 3, 'x') WHEN k % 3 = 1 THEN concat('acme-shop', (k + 2) div 3, 'x') ELSE concat('b-acme-shop', (k + 1) div 3, 'x') END")
    sources = F.expr("CASE WHEN k % 3 = 0 THEN array('r') ELSE CAST(array() AS array<string>) END")
    return passes.suffix_twins(rows.select("ref", name.alias("name"), "aliases", (F.col("k") % 3 != 0).alias("external"), sources.alias("source_repos"), "pos"))


_SHOPS = """, twins AS (SELECT concat('provider:', c_custkey) AS old, concat('provider:', c_custkey + 3 - c_custkey % 3) AS new FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey + 3 - c_custkey % 3 IN (SELECT c_custkey FROM customer))"""


@query("merged_twins", f"""{_BASE}{_SHOPS}, moved AS (SELECT e.* REPLACE (coalesce(a.new, e.src) AS src, coalesce(b.new, e.dst) AS dst) FROM edges e LEFT JOIN twins a ON a.old = e.src LEFT JOIN twins b ON b.old = e.dst)
    SELECT src, type, dst, sum(n_evidence)::BIGINT AS n_evidence, min(confidence) AS confidence FROM moved WHERE src <> dst GROUP BY src, type, dst""")
def merged_twins(spark, sf_dir):
    """Placeholders by the endings of their names folded into what they stand for, edges and all; 'high' comes before 'medium' in the SQL's order of letters."""
    return decisions.merge_pairs(entities(spark, sf_dir), relations(spark, sf_dir), _twins(spark, sf_dir))[1].drop("source")
