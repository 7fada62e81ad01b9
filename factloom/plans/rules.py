"""Naming, staleness, confidence and decision rules over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import confidence, text
from factloom.operators import derive, rules
from factloom.plans.binding import citations, table, with_ctes
from factloom.plans.graphs import relations
from factloom.plans.registry import query

_NAME = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[^A-Za-z0-9_.-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"
_CANON = r"regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), '^(.{{3,}}?)(?:serviceapi|apiservice|service|api|backend|frontend|client|gateway)+$', '\1')"
_HOST = "CASE WHEN p_size % 4 = 0 THEN concat('jdbc://db-', p_size, '.shop.local:5432/x') WHEN p_size % 4 = 1 THEN concat('${HOST:cache-', p_size, '}') WHEN p_size % 4 = 2 THEN '' ELSE 'node7' END"
_STORE = "CASE WHEN p_partkey % 3 = 0 THEN 'orders Database' WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END"
_HOST_NAME = f"CASE WHEN h = '' THEN '' ELSE {_NAME.format('''regexp_extract(regexp_replace(CASE WHEN regexp_extract(h, '\\$\\{[^:}]+:([^}]+)\\}', 1) <> '' THEN regexp_extract(h, '\\$\\{[^:}]+:([^}]+)\\}', 1) ELSE h END, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/:]*)', 1)''')} END"


@query("preferred_names", f"""SELECT p_partkey, label AS host, CASE WHEN label <> '' AND label <> 'cache-9' AND regexp_matches({_CANON.format('cur')}, 'database|datastore|data|store|mongodb|mysql|postgres|redis') THEN label ELSE cur END AS name
    FROM (SELECT p_partkey, {_HOST_NAME} AS label, {_NAME.format("coalesce(nullif(n, ''), 'unknown-resource')")} AS cur FROM (SELECT p_partkey, {_HOST} AS h, {_STORE} AS n FROM part))""")
def preferred_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_HOST).alias("h"), F.expr(_STORE).alias("n"))
    return rows.select("p_partkey", text.host_name("h").alias("host"), text.preferred_name(F.col("n"), F.col("h"), F.array(F.lit("cache-9"))).alias("name"))


_REPO = "CASE WHEN s_suppkey % 3 = 0 THEN concat('acme/team/app-', s_suppkey) WHEN s_suppkey % 3 = 1 THEN concat('acme/app-', s_suppkey, '/') ELSE concat('app-', s_suppkey) END"


@query("repository_names", f"""SELECT s_suppkey, regexp_extract(r, '([^/]*)/*$', 1) AS short, CASE WHEN len(p) < 2 THEN '' ELSE concat('https://github.com/', p[1], '/', p[2]) END AS location,
    replace(regexp_replace(r, '^[^/]*/', ''), '/', '__') AS record, concat(CASE WHEN len(p) < 2 THEN '' ELSE concat('https://github.com/', p[1], '/', p[2]) END, '/blob/main/src/a.py#L', s_nationkey) AS url,
    concat('owner-', s_nationkey) AS owner FROM (SELECT s_suppkey, s_nationkey, r, list_filter(string_split(r, '/'), lambda x: x <> '') AS p FROM (SELECT s_suppkey, s_nationkey, {_REPO} AS r FROM supplier))""")
def repository_names(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("r", F.expr(_REPO))
    owner = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("group:default/owner-"), "s_nationkey")).otherwise(F.concat(F.lit("user:owner-"), "s_nationkey"))
    return rows.select(
        "s_suppkey", text.short_repo("r").alias("short"), text.source_location("r").alias("location"), text.record_name(F.col("r"), F.lit("")).alias("record"),
        text.evidence_url(F.col("r"), F.lit("src/a.py"), F.col("s_nationkey")).alias("url"), text.owner_name(owner).alias("owner"),
    )


@query("edge_signatures", with_ctes("SELECT concat(src, '|', type, '|', dst) AS signature, split_part(src, ':', 1) AS kind, substr(dst, strpos(dst, ':') + 1) AS name, coalesce(protocol, 'resource') AS transport FROM relations", "facts", "relations"))
def edge_signatures(spark, sf_dir):
    rows = relations(spark, sf_dir)
    signature = text.edge_signature(F.col("src"), F.col("type"), F.col("dst"))
    return rows.select(signature.alias("signature"), text.ref_kind("src").alias("kind"), text.ref_name("dst").alias("name"), text.transport(F.col("protocol"), F.lit(""), F.col("dst")).alias("transport"))


_ENDS = "CASE WHEN p_size % 4 = 0 THEN concat('Consumer.c', p_partkey, '.VirtualTopic.', p_type) WHEN p_size % 4 = 1 THEN 'Message-Broker' WHEN p_size % 4 = 2 THEN 'google Pub/Sub' ELSE p_name END"


@query("shared_endpoints", f"""SELECT endpoint, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'feed' WHEN starts_with(e, 'Consumer.') THEN concat('VirtualTopic.', regexp_extract(e, '\\.VirtualTopic\\.(.*)$', 1)) ELSE e END AS endpoint
    FROM (SELECT p_partkey, {_ENDS} AS e FROM part)) WHERE endpoint NOT IN ('Message-Broker', 'google Pub/Sub') GROUP BY endpoint""")
def shared_endpoints(spark, sf_dir):
    end = text.endpoint(F.expr(_ENDS), F.when(F.col("p_partkey") % 11 == 0, "feed").otherwise(""))
    rows = table(spark, sf_dir, "part").select(end.alias("endpoint"))
    return rows.where(~text.is_generic_endpoint("endpoint")).groupBy("endpoint").agg(F.count("*").alias("n"))


_STALE = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('c', c_custkey % 5) END AS stored, concat('c', c_nationkey % 5) AS here, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '2024-01-30T12:00:00' ELSE '2024-01-02T00:00:00' END AS seen FROM customer"


@query("stale_reasons", f"""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'missing' WHEN stored <> here THEN 'commit_changed' WHEN seen IS NULL THEN 'no_timestamp' WHEN try_cast(seen AS TIMESTAMP) IS NULL THEN 'bad_timestamp'
    WHEN epoch(TIMESTAMP '2024-01-31 00:00:00' - try_cast(seen AS TIMESTAMP)) > 72 * 3600 THEN 'stale' END AS reason FROM ({_STALE})""")
def stale_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 13 != 0).alias("found"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('c', c_custkey % 5) END").alias("stored"),
        F.expr("concat('c', c_nationkey % 5)").alias("now"), F.expr("CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '2024-01-30T12:00:00' ELSE '2024-01-02T00:00:00' END").alias("at"),
    )
    return rows.select("c_custkey", rules.stale_reason(F.col("found"), F.col("stored"), F.col("now"), F.col("at"), "2024-01-31 00:00:00", 72).alias("reason"))


_DEP = "CASE o_orderkey % 6 WHEN 0 THEN 'Resource' WHEN 1 THEN 'external' WHEN 2 THEN 'API' ELSE '' END"
_USE = "CASE o_orderkey % 5 WHEN 0 THEN 'consumesApi' WHEN 1 THEN 'producesMessage' WHEN 2 THEN 'readsResource' ELSE 'dependsOn' END"
_NOTE = "CASE WHEN o_orderkey % 7 = 0 THEN 'URL from the Request Body' ELSE '' END"
_CONF = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'review' END"


@query("target_kinds", f"""SELECT kinds, confidence, count(*) AS n FROM (SELECT CASE WHEN dyn THEN 'API,Component' WHEN d = 'Resource' THEN 'Resource' WHEN d = 'API' THEN 'API' WHEN d = 'external' AND u = 'consumesApi' THEN 'Component,API,Provider' WHEN d = 'external' THEN 'Provider'
    WHEN u IN ('producesMessage', 'readsResource') THEN 'Resource' WHEN u = 'consumesApi' THEN 'Component,API' ELSE 'Component,Provider,Resource,API' END AS kinds,
    CASE WHEN dyn OR (d = 'external' AND u = 'dependsOn') THEN 'review' WHEN c = 'high' THEN 'medium' ELSE c END AS confidence
    FROM (SELECT {_DEP} AS d, {_USE} AS u, {_CONF} AS c, o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 AS dyn FROM orders)) GROUP BY kinds, confidence""")
def target_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr(_DEP).alias("d"), F.expr(_USE).alias("u"), F.expr(_CONF).alias("c"), F.expr(_NOTE).alias("note"))
    dynamic = rules.is_dynamic(F.col("u"), F.col("note"), F.array().cast("array<string>"))
    kinds = F.array_join(rules.target_kinds(F.col("d"), F.col("u"), dynamic), ",")
    sure = rules.dependency_confidence(F.col("c"), F.lit("medium"), F.col("d"), F.col("u"), F.lit("unknown"), dynamic)
    return rows.select(kinds.alias("kinds"), sure.alias("confidence")).groupBy("kinds", "confidence").agg(F.count("*").alias("n"))


@query("confined_evidence", "SELECT p_partkey, (p_partkey % 3 <> 0)::INT + (p_partkey % 4 <> 0)::INT + 1 AS n_kept, 3 - ((p_partkey % 3 <> 0)::INT + (p_partkey % 4 <> 0)::INT + 1) AS n_gone FROM part")
def confined_evidence(spark, sf_dir):
    at = lambda good, bad, k: F.when(F.col("p_partkey") % k == 0, bad).otherwise(good)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(at("src/a", "src/../../b", 3), at("/b", "", 4), F.lit("c..d/e")).alias("paths"))
    kept = rules.confined("paths")
    return rows.select("p_partkey", F.size(kept).alias("n_kept"), (F.size("paths") - F.size(kept)).alias("n_gone"))


@query("new_flows", with_ctes("""SELECT DISTINCT w.src, r.src AS dst FROM relations w JOIN relations r ON w.dst = r.dst AND w.type = 'writesResource' AND r.type = 'readsResource' AND w.src <> r.src
    EXCEPT SELECT p.src, c.src FROM relations p JOIN relations c ON p.dst = c.dst AND p.type = 'producesMessage' AND c.type = 'consumesMessage'""", "facts", "relations"))
def new_flows(spark, sf_dir):
    edges = relations(spark, sf_dir)
    return rules.new_pairs(derive.messages(edges), derive.shared_resources(edges))


_GONE = "SELECT concat('component:', s_suppkey) AS src, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'readsResource' END AS type FROM supplier WHERE s_suppkey % 5 = 0"


@query("edge_decisions", with_ctes(f"""SELECT src, type, dst FROM relations WHERE NOT EXISTS (SELECT 1 FROM ({_GONE}) g WHERE g.src = relations.src AND relations.dst = 'resource:7' AND (g.type = '' OR g.type = relations.type))
    UNION SELECT concat('component:', s_suppkey), 'dependsOn', 'component:1' FROM supplier WHERE s_suppkey % 10 = 3""", "facts", "relations"))
def edge_decisions(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumn("src", F.expr("concat('component:', s_suppkey)"))
    gone = suppliers.where("s_suppkey % 5 = 0").select("src", F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("readsResource").alias("type"), F.lit("resource:7").alias("dst"))
    added = suppliers.where("s_suppkey % 10 = 3").select("src", F.lit("dependsOn").alias("type"), F.lit("component:1").alias("dst"))
    return rules.decide_edges(relations(spark, sf_dir).select("src", "type", "dst"), gone, added)


@query("usage_costs", """SELECT user_id, round(sum(CASE event_type WHEN 'click' THEN (greatest(event_id - 500, 0) * 0.75 + 500 * 0.075 + user_id * 4.5) / 1000000 WHEN 'view' THEN (greatest(event_id - 500, 0) * 5.0 + 500 * 0.5 + user_id * 25.0) / 1000000
    ELSE (event_id + user_id) * 5.0 / 1000000 END::DOUBLE), 4) AS usd FROM events GROUP BY user_id""")
def usage_costs(spark, sf_dir):
    model = F.when(F.col("event_type") == "click", "gpt-5.4-mini").when(F.col("event_type") == "view", "gpt-5.4")
    cost = rules.usage_cost(model, F.col("event_id"), F.lit(500), F.col("user_id"), digits=None)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(cost), 4).alias("usd"))


@query("mentions", """SELECT item_id, contains(lower(text), 'the') OR contains(lower(text), 'hours') AS any_of, contains(lower(text), 'the') AND contains(lower(text), 'hours') AS all_of FROM benchmark""")
def mentions(spark, sf_dir):
    words = ["The", "hours", ""]
    return table(spark, sf_dir, "benchmark").select("item_id", rules.mentions_any("text", words).alias("any_of"), rules.mentions_all("text", words).alias("all_of"))


@query("worker_ids", "SELECT run, concat('W', row_number() OVER (ORDER BY seen, run)) AS worker FROM (SELECT user_id AS run, min(ts) AS seen FROM events WHERE event_type = 'signup' GROUP BY user_id)")
def worker_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("at"))
    return rules.worker_ids(rows, "at", "run").select("run", "worker")


@query("queue_order", with_ctes("SELECT path, confidence, count(*) AS n FROM cited GROUP BY path, confidence ORDER BY CASE confidence WHEN 'low' THEN 0 ELSE 1 END, 3 DESC, 1, 2 LIMIT 50", "cited"))
def queue_order(spark, sf_dir):
    rows = citations(spark, sf_dir).groupBy(F.col("path").cast("long").alias("path"), "confidence").agg(F.count("*").alias("n"))
    return rows.orderBy(F.when(F.col("confidence") == "low", 0).otherwise(1), F.desc("n"), "path", "confidence").limit(50)


@query("floor_and_highest", "SELECT c_mktsegment AS segment, CASE min(r) WHEN 0 THEN 'review' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS least, CASE max(r) WHEN 0 THEN 'review' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS most FROM (SELECT c_mktsegment, c_nationkey % 3 + 1 AS r FROM customer) GROUP BY 1")
def floor_and_highest(spark, sf_dir):
    from factloom.operators import merge

    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), confidence.from_rank(F.col("c_nationkey") % 3 + 1).alias("c"))
    return rows.groupBy("segment").agg(merge.floor(F.col("c")).alias("least"), merge.highest(F.col("c")).alias("most"))
