"""Missing repositories over the driver tables: suppliers as components, pages as APIs, orders as resources; customers and hosts as an organisation's repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import discover
from factloom.plans.binding import table
from factloom.plans.registry import query

ROLES = ["worker", "Sync Service"]
_HOST = "regexp_extract(url, '^https?://([^/]*)', 1)"
_SHAPE = ("pos", "ref", "kind", "name", "external", "source_repos", "aliases", "operations", "subscribes_to", "datasource_url", "env_keys")


def entities(spark, sf_dir):
    none, no_ops, text = "CAST(NULL AS array<string>)", "CAST(NULL AS array<struct<path:string,name:string>>)", "CAST(NULL AS string)"
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS pos", "concat('component:', s_suppkey) AS ref", "'Component' AS kind", "concat('Customer ', lpad(CAST(s_suppkey AS string), 9, '0'), ' API') AS name", "s_acctbal < 0 AS external",
        "CASE WHEN s_acctbal < 4000 THEN CAST(array() AS array<string>) ELSE array('r') END AS source_repos", "array(concat('https://customer', lpad(CAST(s_suppkey AS string), 9, '0'), '.acme.io:80/x'))",
        no_ops, text, text, none)
    pages = table(spark, sf_dir, "pages").selectExpr("1000000000 + page_id", "concat('api:', page_id)", "'API'", "concat('page ', page_id)", "false", none, none, f"array(named_struct('path', url, 'name', {_HOST}))", text, text, none)
    orders = table(spark, sf_dir, "orders").selectExpr(
        "2000000000 + o_orderkey", "concat('resource:', o_orderkey)", "'Resource'", "concat('Consumer.app', o_orderkey % 7, '.VirtualTopic.customer', lpad(CAST(o_custkey AS string), 9, '0'), '.events.v1')", "false", none, none, no_ops,
        "CASE WHEN o_orderstatus = 'O' THEN concat('consumer:billing:customer', lpad(CAST(o_custkey + 1 AS string), 9, '0')) END", text, "array(concat('CUSTOMER', lpad(CAST(o_custkey + 2 AS string), 9, '0'), '_QUEUE'), 'example')")
    return suppliers.toDF(*_SHAPE).unionByName(pages.toDF(*_SHAPE)).unionByName(orders.toDF(*_SHAPE))


def repos(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.expr("concat('acme/Customer-', lpad(CAST(c_custkey AS string), 9, '0'), CASE WHEN c_acctbal < 0 THEN '-worker' WHEN c_acctbal < 2000 THEN 'syncservice' ELSE '-service' END) AS repo"), F.col("c_custkey").alias("pos"))
    hosts = table(spark, sf_dir, "pages").select(F.expr(f"concat('acme/', split({_HOST}, '[.]')[0], '-api') AS repo"), (F.lit(1000000000) + F.col("page_id")).alias("pos"))
    extra = spark.createDataFrame([("acme/example-gateway", 5)], "repo string, pos long")
    return customers.unionByName(hosts).unionByName(extra)


def cloned(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.expr("concat('acme/Customer-', lpad(CAST(c_custkey AS string), 9, '0'), '-service') AS repo"))


_SQUASH = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"
_KEY = "regexp_replace(" + _SQUASH + r", '^(.{{3,}}?)(?:serviceapi|apiservice|service|api|backend|frontend|client|gateway)+$', '\1')"
_LABELS = f"""labels AS (SELECT pos, n, label, via, origin, roles FROM (
    SELECT s_suppkey AS pos, unnest([0, 1]) AS n, unnest([name, concat('https://customer', lpad(s_suppkey::VARCHAR, 9, '0'), '.acme.io:80/x')]) AS label, name AS via, 'component_identity' AS origin, false AS roles
        FROM (SELECT *, concat('Customer ', lpad(s_suppkey::VARCHAR, 9, '0'), ' API') AS name FROM supplier WHERE s_acctbal < 4000)
    UNION ALL SELECT 1000000000 + page_id, unnest([0, 1, 2]), unnest([concat('page ', page_id), url, {_HOST}]), concat('api:', page_id), 'communication_endpoint', false FROM pages
    UNION ALL SELECT 2000000000 + o_orderkey, unnest([0, 1, 3, 4]), unnest([concat('Consumer.app', o_orderkey % 7, '.VirtualTopic.customer', lpad(o_custkey::VARCHAR, 9, '0'), '.events.v1'),
        CASE WHEN o_orderstatus = 'O' THEN concat('consumer:billing:customer', lpad((o_custkey + 1)::VARCHAR, 9, '0')) END, concat('CUSTOMER', lpad((o_custkey + 2)::VARCHAR, 9, '0'), '_QUEUE'), 'example']), concat('resource:', o_orderkey), 'communication_endpoint', true FROM orders)
    WHERE coalesce(label, '') <> '')"""
_STOP = ", ".join(f"'{w}'" for w in discover.ENDPOINT_STOP)
_WORDS = f"""words AS (SELECT *, list_filter(CASE WHEN list_position(parts, 'virtualtopic') > 0 THEN parts[list_position(parts, 'virtualtopic') + 1:] WHEN parts[1] = 'consumer' AND len(parts) > 2 THEN parts[3:] ELSE parts END,
    lambda p: length(p) >= 3 AND p NOT IN ({_STOP}) AND NOT regexp_full_match(p, '[0-9]+')) AS ws
    FROM (SELECT *, list_filter(regexp_split_to_array(regexp_extract(regexp_replace(lower(trim(label)), '^https?://', ''), '^([^?#]*)', 1), '[^a-z0-9]+'), lambda p: p <> '') AS parts FROM labels))"""
_KEYS = f"""keys AS (SELECT pos, n, unnest(range(0, 7)) AS k, unnest([{_KEY.format('label')}, {_KEY.format("regexp_extract(regexp_replace(lower(label), '^https?://', ''), '^([^/:.]*)', 1)")}, {_KEY.format('ws[1]')}, {_KEY.format('ws[2]')}, {_KEY.format('ws[3]')},
    CASE WHEN roles AND len(ws) > 0 THEN {_KEY.format('ws[1]')} || 'worker' END, CASE WHEN roles AND len(ws) > 0 THEN {_KEY.format('ws[1]')} || 'sync' END]) AS key,
    unnest(['canonical', 'host', 'endpoint_namespace', 'endpoint_namespace', 'endpoint_namespace', 'endpoint_namespace_role', 'endpoint_namespace_role']) AS source FROM words)"""
_REPOS = f"""repos AS (SELECT concat('acme/Customer-', lpad(c_custkey::VARCHAR, 9, '0'), CASE WHEN c_acctbal < 0 THEN '-worker' WHEN c_acctbal < 2000 THEN 'syncservice' ELSE '-service' END) AS repo, c_custkey AS pos FROM customer
    UNION ALL SELECT concat('acme/', split_part({_HOST}, '.', 1), '-api'), 1000000000 + page_id FROM pages UNION ALL SELECT 'acme/example-gateway', 5),
index AS (SELECT key, first(repo ORDER BY pos, repo) AS repo FROM (SELECT repo, pos, {_KEY.format("split_part(repo, '/', 2)")} AS key FROM repos) WHERE key <> '' GROUP BY key),
cloned AS (SELECT concat('acme/Customer-', lpad(c_custkey::VARCHAR, 9, '0'), '-service') AS repo FROM customer WHERE c_acctbal > 8000)"""
_SQL = f"""WITH RECURSIVE {_LABELS}, {_WORDS}, {_KEYS}, {_REPOS},
found AS (SELECT pos, n, repo, min({{'k': k, 'key': key, 'source': source}}) AS b FROM keys JOIN index USING (key) WHERE key <> '' AND repo NOT IN (SELECT repo FROM cloned) GROUP BY pos, n, repo),
prefs AS (SELECT *, row_number() OVER (PARTITION BY pos, n ORDER BY b.k) AS rank FROM found),
rounds AS (SELECT 0 AS r, pos, n, 1::BIGINT AS rank FROM prefs WHERE rank = 1
    UNION ALL SELECT r + 1, pos, n, CASE WHEN lost THEN rank + 1 ELSE rank END FROM (SELECT *, bool_or(lost) OVER () AS go FROM
        (SELECT r.*, row_number() OVER (PARTITION BY repo ORDER BY r.pos, r.n) > 1 AS lost FROM rounds r JOIN prefs p ON p.pos = r.pos AND p.n = r.n AND p.rank = r.rank)) WHERE go)
SELECT repo, label, via, origin, b.key AS key, b.source AS source FROM (SELECT * FROM rounds WHERE r = (SELECT max(r) FROM rounds)) JOIN prefs USING (pos, n, rank) JOIN labels USING (pos, n)"""


@query("missing_repos", _SQL)
def missing_repos(spark, sf_dir):
    return discover.missing(discover.hints(entities(spark, sf_dir)), repos(spark, sf_dir), cloned(spark, sf_dir), ROLES)
