"""Queries of the catalog passes, run records and evaluation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import graph, passes, reports
from factloom.plans.binding import depends, entities, table, with_ctes
from factloom.plans.catalog import _CANON, _TAG
from factloom.plans.graphs import relations
from factloom.plans.registry import query

_RANK = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_SURE = "CASE {} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence"
_NO = "CAST(array() AS array<string>)"


@query("alias_keys", f"""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter([{_CANON.format('n')}, CASE WHEN length({_CANON.format('m')}) >= 5 THEN {_CANON.format('m')} END, 'payshop'], lambda k: k NOT IN ('', 'test', 'gateway', 'search')))), ',') AS keys
    FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Test' WHEN 1 THEN 'oms' ELSE c_name || ' Service' END AS n, CASE c_custkey % 3 WHEN 0 THEN 'cart' WHEN 1 THEN c_mktsegment || ' api' ELSE 'Gateway' END AS m FROM customer)""")
def alias_keys(spark, sf_dir):
    name = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'Test' WHEN 1 THEN 'oms' ELSE concat(c_name, ' Service') END")
    alias = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'cart' WHEN 1 THEN concat(c_mktsegment, ' api') ELSE 'Gateway' END")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(passes.alias_keys(name, F.array(alias, F.lit("PayShop"), F.lit(None).cast("string"))), ",").alias("keys"))


@query("broker_edges", with_ctes(f"""SELECT src, type, dst, {_SURE.format('max(c)')} FROM (
    SELECT src, type, b.dst, least(2, {_RANK.format('confidence')}) AS c FROM relations JOIN b ON relations.dst = b.ref WHERE type IN ('producesMessage', 'consumesMessage')
    UNION ALL SELECT ref, 'dependsOn', dst, 2 FROM b) GROUP BY src, type, dst""", "facts", "relations").replace(
    " SELECT src, type, dst, CASE max", ", b AS (SELECT concat('resource:', p_partkey) AS ref, CASE p_size % 4 WHEN 0 THEN 'resource:kafka' ELSE 'resource:nats' END AS dst FROM part WHERE p_size % 4 < 2) SELECT src, type, dst, CASE max", 1))
def broker_edges(spark, sf_dir):
    made = F.expr("CASE p_size % 4 WHEN 0 THEN 'Apache Kafka' WHEN 1 THEN 'NA-TS' ELSE '' END")
    resources = table(spark, sf_dir, "part").select(F.expr("concat('resource:', p_partkey)").alias("ref"), F.lit("").alias("name"), made.alias("technology"))
    return passes.broker_edges(relations(spark, sf_dir), resources)


def _dependencies(spark, sf_dir, kind):
    """dependsOn as relations (src, type, dst, n_evidence, confidence), one per pair and confidence."""
    rows = depends(spark, sf_dir).groupBy("src", "dst", "confidence").agg(F.count("*").alias("n_evidence"))
    return rows.select("src", F.lit(kind).alias("type"), "dst", "n_evidence", "confidence")


_DEPENDS = "SELECT concat('provider:', o_custkey) AS src, l_suppkey AS k, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("demoted_stores", f"""SELECT src, type, dst, sum(n)::BIGINT AS n_evidence, {_SURE.format('max(c)')} FROM (
    SELECT src, 'dependsOn' AS type, concat(CASE WHEN k % 5 = 0 AND k % 10 <> 0 AND k % 15 <> 0 THEN 'resource:' ELSE 'component:' END, k) AS dst, 1 AS n, CASE WHEN k % 5 = 0 AND k % 10 <> 0 AND k % 15 <> 0 THEN least(c, 1) ELSE c END AS c FROM ({_DEPENDS})
    UNION ALL SELECT concat('component:', s_suppkey), 'providesApi', concat('api:', s_suppkey), 1, 3 FROM supplier WHERE s_suppkey % 10 = 0
    UNION ALL SELECT concat('system:', s_nationkey), 'partOf', concat('component:', s_suppkey), 1, 3 FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 15 <> 0)
    UNION ALL SELECT concat('component:', s_suppkey), 'ownedBy', concat('group:', s_nationkey), 1, 3 FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 15 <> 0)) GROUP BY src, type, dst""")
def demoted_stores(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    edge = lambda src, kind, dst, where="true": rows.where(where).select(F.expr(src).alias("src"), F.lit(kind).alias("type"), F.expr(dst).alias("dst"), F.lit(1).cast("long").alias("n_evidence"), F.lit("high").alias("confidence"))
    own = "concat('component:', s_suppkey)"
    edges = _dependencies(spark, sf_dir, "dependsOn").unionByName(edge(own, "providesApi", "concat('api:', s_suppkey)", "s_suppkey % 10 = 0"))
    edges = edges.unionByName(edge("concat('system:', s_nationkey)", "partOf", own)).unionByName(edge(own, "ownedBy", "concat('group:', s_nationkey)"))
    components = rows.select(F.expr(own).alias("ref"), F.col("s_name").alias("name"), F.expr("CASE WHEN s_suppkey % 20 = 5 THEN 'A MySQL image' ELSE '' END").alias("description"), F.lit("service").alias("type"),
                             F.expr(f"CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 20 <> 5 THEN array('DB') ELSE {_NO} END").alias("tags"))
    resources = rows.select(F.expr("concat('resource:', s_suppkey)").alias("ref"), F.expr("CASE WHEN s_suppkey % 15 = 0 THEN concat('other ', s_suppkey) ELSE s_name END").alias("name"), F.lit("").alias("host"),
                            F.expr(_NO).alias("aliases"), F.lit("low").alias("confidence"), F.col("s_suppkey").alias("pos"))
    return passes.demote_stores(edges, passes.stores(components, resources, edges))


@query("folded_providers", with_ctes(f"""SELECT src, type, dst, sum(n)::BIGINT AS n_evidence, {_SURE.format('max(c)')} FROM (
    SELECT src, CASE WHEN t.old IS NULL THEN 'consumesApi' ELSE 'dependsOn' END AS type, coalesce(t.new, concat('component:', k)) AS dst, 1 AS n, CASE WHEN t.old IS NULL THEN c ELSE 0 END AS c FROM ({_DEPENDS}) d LEFT JOIN t ON t.old = concat('component:', d.k)
    UNION ALL SELECT src, type, dst, n_evidence, {_RANK.format('confidence')} FROM relations ANTI JOIN t ON t.old = relations.src) GROUP BY src, type, dst""", "facts", "relations").replace(
    " SELECT src, type, dst, sum(n)", ", t AS (SELECT concat('component:', s_suppkey) AS old, concat('provider:', c_custkey) AS new FROM supplier JOIN customer ON c_custkey = s_suppkey * 10 WHERE s_suppkey % 3 = 0) SELECT src, type, dst, sum(n)", 1))
def folded_providers(spark, sf_dir):
    components = table(spark, sf_dir, "supplier").select(F.expr("concat('component:', s_suppkey)").alias("ref"), F.col("s_name").alias("name"), F.expr("array(concat('cust-', s_suppkey * 10))").alias("aliases"),
                                                         F.expr("s_suppkey % 3 = 0").alias("external"), F.expr(_NO).alias("source_repos"))
    providers = table(spark, sf_dir, "customer").select(F.expr("concat('provider:', c_custkey)").alias("ref"), F.col("c_name").alias("name"), F.expr("array(concat('Cust ', c_custkey))").alias("aliases"), F.col("c_custkey").alias("pos"))
    edges = _dependencies(spark, sf_dir, "consumesApi").unionByName(relations(spark, sf_dir).select("src", "type", "dst", "n_evidence", "confidence"))
    return passes.fold_providers(edges, passes.provider_twins(components, providers))


@query("suffix_twins", "SELECT concat('external:', s_suppkey) AS old, concat('component:', s_nationkey) AS new FROM supplier WHERE s_suppkey % 5 <> 0")
def suffix_twins(spark, sf_dir):
    sourced = table(spark, sf_dir, "nation").selectExpr("concat('component:', n_nationkey) AS ref", "concat('Core', n_nationkey) AS name", f"{_NO} AS aliases", "false AS external", "array('r') AS source_repos", "CAST(n_nationkey AS long) AS pos")
    name = "CASE WHEN s_suppkey % 5 = 0 THEN concat('lone', s_suppkey) WHEN s_suppkey % 2 = 0 THEN concat('acme-x-core', s_nationkey) ELSE concat('zeta', s_suppkey) END"
    lone = table(spark, sf_dir, "supplier").selectExpr("concat('external:', s_suppkey) AS ref", f"{name} AS name", f"CASE WHEN s_suppkey % 5 = 0 THEN {_NO} ELSE array(concat('core', s_nationkey)) END AS aliases",
                                                       "true AS external", f"{_NO} AS source_repos", "1000 + s_suppkey AS pos")
    return passes.suffix_twins(sourced.unionByName(lone))


_FACTS = "SELECT l_orderkey AS doc, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx, concat('line ', l_linenumber) AS fact, l_suppkey AS k FROM lineitem"


@query("corrected_facts", f"SELECT doc, category, (row_number() OVER (PARTITION BY doc, category ORDER BY idx) - 1)::INT AS index, CASE WHEN k % 7 = 1 THEN concat('fixed ', k) ELSE fact END AS fact FROM ({_FACTS}) WHERE k % 7 <> 0")
def corrected_facts(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lines")
    facts = spark.sql(_FACTS.replace("lineitem", "_lines")).withColumnRenamed("idx", "index")
    asked = facts.select("doc", "category", "index", F.expr("CASE k % 7 WHEN 0 THEN 'drop' WHEN 1 THEN 'fix' ELSE 'keep' END").alias("action"), F.expr("concat('fixed ', k)").alias("fact"), F.lit(2).alias("ord"))
    more = asked.withColumns({"ord": F.lit(1), "fact": F.lit("early")}).unionByName(asked.withColumns({"index": F.lit(99), "action": F.lit("drop")}))
    return passes.correct(facts.drop("k"), asked.unionByName(more))


@query("run_summaries", r"""SELECT run, ended - to_milliseconds(secs * 1000) AS started_at, ended AS finished_at, status, cost, CASE WHEN status = 'ok' THEN 0 END AS code FROM (SELECT concat('extraction-acme-app-', o_orderkey) AS run,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS ended, greatest(o_orderkey % 5000 - 10, 0) AS secs, CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'validation_errors' ELSE 'ok' END AS status, o_totalprice AS cost FROM orders)""")
def run_summaries(spark, sf_dir):
    records = table(spark, sf_dir, "orders").selectExpr(
        "concat('Acme/App__', o_orderkey, '/') AS repo", "CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE CAST(o_orderdate AS string) END AS extracted_at", "CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE '' END AS status",
        "CASE WHEN o_orderkey % 3 = 1 THEN 2 END AS n_errors", "o_totalprice AS cost", "CAST(o_orderkey % 5000 - 10 AS double) AS seconds",
    )
    return reports.run_summaries(records)


@query("run_metrics", """SELECT c_custkey AS repo, CASE WHEN seen >= began THEN CASE WHEN c_custkey % 2 = 0 THEN 'failed' ELSE 'ok' END END AS status, CASE WHEN seen >= began THEN cost END AS cost
    FROM (SELECT c_custkey, TIMESTAMP '1995-01-01' + to_days((c_custkey % 900)::INT) AS began FROM customer) LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def run_metrics(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS repo", "timestampadd(DAY, CAST(c_custkey % 900 AS int), TIMESTAMP '1995-01-01') AS started_at")
    records = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.max("o_orderdate").alias("extracted_at"), F.round(F.sum("o_totalprice"), 2).alias("cost"))
    return reports.run_metrics(runs, records.withColumn("status", F.when(F.col("repo") % 2 == 0, "failed").otherwise(""))).select("repo", "status", "cost")


@query("run_states", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'abandoned' WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'ok' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 30.5 WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN greatest(epoch(TIMESTAMP '1996-01-01' - o_orderdate), 0) ELSE 12.0 END::DOUBLE AS seconds FROM orders""")
def run_states(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 == 0, "running").otherwise("ok")
    later = lambda ms: F.timestamp_millis(F.unix_millis("o_orderdate") + ms)
    ended = F.when(F.col("o_orderkey") % 5 == 0, later(30_460))
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    seen, seconds = reports.observed(status, F.col("o_orderkey") % 2 == 1, F.col("o_orderdate"), ended, later(12_000), F.lit("1996-01-01 00:00:00").cast("timestamp"))
    return rows.select("o_orderkey", seen.alias("status"), seconds.alias("seconds"))


@query("eval_changes", "SELECT o_orderkey AS question, CASE WHEN o_orderkey % 3 = 0 THEN 'now passes' ELSE 'regressed' END AS change FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0) <> (o_orderkey % 2 = 0)")
def eval_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "question")
    return reports.changes(rows.selectExpr("question", "question % 3 = 0 AS passed"), rows.where("question % 5 <> 0").selectExpr("question", "question % 2 = 0 AS passed"))


@query("category_means", "SELECT l_returnflag AS category, round(avg((l_linestatus = 'O')::INT), 6) AS pass_rate, round(avg(CASE WHEN l_linenumber > 2 THEN l_discount END), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY l_returnflag")
def category_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS category", "l_linestatus = 'O' AS passed", "CASE WHEN l_linenumber > 2 THEN l_discount END AS discount", "l_tax AS tax")
    return reports.category_means(rows, "discount", "tax")


@query("compared_counts", "SELECT t.repo, t.n, b.n AS n_before FROM (SELECT s_nationkey AS repo, count(*) AS n FROM supplier GROUP BY s_nationkey) t LEFT JOIN (SELECT c_nationkey AS repo, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey) b USING (repo)")
def compared_counts(spark, sf_dir):
    treated = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("repo")).agg(F.count("*").alias("n"))
    before = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("repo")).agg(F.count("*").alias("n"))
    return reports.compared(before, treated, "n")


_GOLD = ["frontend", "productcatalogservice", "cart", "redis-cart"]
_REFS = "CASE s_suppkey % 7 WHEN 0 THEN 'Component:acme-shop-frontend' WHEN 1 THEN 'Product Catalog Service' WHEN 2 THEN 'Component:Cart' WHEN 3 THEN 'x-redis-cart-y' WHEN 4 THEN 'myfrontendapp' WHEN 5 THEN 'Redis_Cart' ELSE 'none' END"


@query("gold_names", "SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'frontend' WHEN 1 THEN 'productcatalogservice' WHEN 2 THEN 'cart' WHEN 3 THEN 'cart' WHEN 4 THEN 'frontend' WHEN 5 THEN 'redis-cart' END AS gold FROM supplier")
def gold_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", reports.gold_name(F.expr(_REFS), _GOLD).alias("gold"))


@query("predicted_edges", """WITH r AS (SELECT concat('g', s_suppkey % 5) AS src, s_suppkey % 7 AS api, concat('g', s_suppkey % 4) AS owner, concat('g', s_suppkey % 3) AS a, s_suppkey % 6 AS b, s_nationkey AS n FROM supplier)
    SELECT DISTINCT src, dst FROM (SELECT r.src, p.owner AS dst FROM r JOIN (SELECT api, max(owner) AS owner FROM r GROUP BY api) p USING (api) WHERE r.src <> p.owner
    UNION ALL SELECT a, concat('g', b) FROM r WHERE b < 5 AND a <> concat('g', b) UNION ALL SELECT src, concat('resource:db', n) FROM r WHERE n % 3 = 0)""")
def predicted_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    edge = lambda src, kind, dst: rows.selectExpr(f"concat('Component:g', {src}) AS src", f"'{kind}' AS type", f"{dst} AS dst")
    edges = edge("s_suppkey % 5", "consumesApi", "concat('API:a', s_suppkey % 7)").unionByName(edge("s_suppkey % 4", "providesApi", "concat('API:a', s_suppkey % 7)"))
    edges = edges.unionByName(edge("s_suppkey % 3", "dependsOn", "concat('Component:g', s_suppkey % 6)")).unionByName(edge("s_suppkey % 5", "readsResource", "concat('Resource:db-', s_nationkey)"))
    services, owned = reports.predicted_edges(edges, [f"g{k}" for k in range(5)])
    wanted = rows.where("s_nationkey % 3 = 0").selectExpr("concat('g', s_suppkey % 5) AS src", "concat('resource:db', s_nationkey) AS resource", "array(CAST(s_nationkey AS string), 'absent') AS tokens")
    return services.unionByName(reports.resource_hits(owned, wanted).withColumnRenamed("resource", "dst")).distinct()


@query("repos_mentioned", r"SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\bwhich\b') THEN 'acme/Which' END, CASE WHEN regexp_matches(lower(text), '\bhours\b') THEN 'hours' END], lambda x: x IS NOT NULL), ',') AS repos FROM benchmark")
def repos_mentioned(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(reports.repos_mentioned(F.col("text"), ["acme/Which", "hours", "acme/the"]), ",").alias("repos"))


@query("inventory_fingerprint", f"""SELECT sha256('[' || string_agg(concat('{{"count":', n, ',"entity_kinds":["API","Component"],"normalised":"', normal, '","tag":"', tag, '"}}'), ',' ORDER BY normal, tag) || ']') AS fingerprint
    FROM (SELECT p_type AS tag, {_TAG.format('trim(lower(p_type))')} AS normal, count(*) AS n FROM part GROUP BY p_type)""")
def inventory_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count("*").alias("count"))
    return reports.fingerprint(rows.select("tag", text.tag("tag").alias("normalised"), "count", F.array(F.lit("Component"), F.lit("API")).alias("entity_kinds")))


@query("system_briefs", """SELECT concat('s', s_nationkey % 5) AS system, count(*) AS n_components, array_to_string(list_sort(list_distinct(list(nullif(CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'java' ELSE 'go' END, '')))), ',') AS runtimes,
    count(DISTINCT s_name) AS n_repos FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1""")
def system_briefs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("'Component' AS kind", "CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE concat('s', s_nationkey % 5) END AS system", "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'java' ELSE 'go' END AS runtime", "s_name AS repo")
    return reports.system_brief(rows).select("system", "n_components", F.array_join("runtimes", ",").alias("runtimes"), F.size("repos").cast("long").alias("n_repos"))


@query("verifier_totals", "SELECT sum(c_custkey % 5)::BIGINT AS matched, sum(c_custkey % 2)::BIGINT AS partial, sum(c_nationkey)::BIGINT AS missing, count(*) FILTER (WHERE c_custkey % 5 > 0) AS repos_matched, count(*) FILTER (WHERE c_custkey % 2 > 0) AS repos_partial, count(*) FILTER (WHERE c_nationkey > 0) AS repos_missing FROM customer")
def verifier_totals(spark, sf_dir):
    return reports.verifier_totals(table(spark, sf_dir, "customer").selectExpr("c_custkey % 5 AS matched", "c_custkey % 2 AS partial", "CAST(c_nationkey AS long) AS missing"))


@query("glossary_lines", """SELECT s_name AS name, concat('  - ', s_name, CASE WHEN s_suppkey % 2 = 0 THEN concat('   aliases: n', s_nationkey, ', z') ELSE '' END, CASE WHEN s_suppkey % 4 < 2 THEN concat('   (', substr(repeat(s_name || ' ', 9), 1, 80), ')') ELSE '' END) AS line
    FROM supplier ORDER BY s_suppkey % 3 = 0, s_name LIMIT 80""")
def glossary_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", f"CASE WHEN s_suppkey % 3 = 0 THEN {_NO} ELSE array('r') END AS source_repos", f"CASE WHEN s_suppkey % 2 = 0 THEN array('z', '', concat('n', s_nationkey), 'z') ELSE {_NO} END AS aliases",
                                                       "CASE WHEN s_suppkey % 4 < 2 THEN repeat(concat(s_name, ' '), 9) ELSE '' END AS description")
    return reports.glossary_lines(rows)


@query("lineage_names", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'mysql' ELSE 'catalog' END AS namespace, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '.' || p_name ELSE p_name END AS name FROM part")
def lineage_names(spark, sf_dir):
    space, name = reports.dataset(F.col("p_name"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_brand) END"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'h1 ' ELSE ' ' END"), F.expr("CASE WHEN p_size % 3 = 1 THEN 'MySQL' END"))
    return table(spark, sf_dir, "part").select("p_partkey", space.alias("namespace"), name.alias("name"))


@query("remote_repositories", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN 'acme' END AS org, CASE WHEN s_suppkey % 4 < 3 THEN concat('app.', s_suppkey) END AS repo FROM supplier")
def remote_repositories(spark, sf_dir):
    url = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('git@github.com:acme/app.', s_suppkey, '.git') WHEN 1 THEN concat('https://github.com/acme/app.', s_suppkey, '/') WHEN 2 THEN concat('ssh://git@github.com/acme/app.', s_suppkey) ELSE 'https://example.com/a/b' END")
    org, repo = reports.remote_repository(url)
    return table(spark, sf_dir, "supplier").select("s_suppkey", org.alias("org"), repo.alias("repo"))


@query("node_order", with_ctes("SELECT e.ref, coalesce(n, 0) AS degree FROM entities e LEFT JOIN (SELECT ref, count(*) AS n FROM (SELECT src AS ref FROM relations UNION ALL SELECT dst FROM relations) GROUP BY ref) d ON d.ref = e.ref ORDER BY 2 DESC, lower(name), e.ref LIMIT 200", "facts", "relations", "entities"))
def node_order(spark, sf_dir):
    return reports.node_order(entities(spark, sf_dir).select("ref", "name"), graph.degrees(relations(spark, sf_dir)), 200)
