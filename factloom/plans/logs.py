"""Verification, event folds, reports and metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import metrics, resolve, verify
from factloom.plans.binding import citations, depends, events, table, with_ctes
from factloom.plans.registry import query
from factloom.streaming import folds


def _lines(spark, sf_dir):
    return verify.source_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


_SQ = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_CHECKED = rf"""SELECT fact, path, line, CASE WHEN known = 0 THEN 'invalid_path' WHEN s <> '' AND contains(w, s) THEN 'matched'
    WHEN len(t) > 0 AND len(list_filter(t, lambda x: contains(w, x))) / greatest(len(t), 1) >= 0.5 THEN 'partial' ELSE 'missing' END AS status FROM
    (SELECT *, list_distinct(list_filter(string_split_regex(s, '[^a-z0-9_]+'), lambda x: length(x) >= 3)) AS t FROM
    (SELECT fact, c.path, c.line, {_SQ.format('c.snippet')} AS s, count(l.line) AS known, {_SQ.format("coalesce(string_agg(l.text, ' ' ORDER BY l.line), '')")} AS w
    FROM cited c LEFT JOIN lines l ON l.path = c.path AND l.line BETWEEN c.line - 2 AND c.line + 4 GROUP BY fact, c.path, c.line, c.snippet))"""


def _checked(spark, sf_dir):
    return verify.check_files(citations(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("snippet_verify", with_ctes(f"SELECT fact, status FROM ({_CHECKED})", "cited", "lines"))
def snippet_verify(spark, sf_dir):
    return _checked(spark, sf_dir).select("fact", "status")


_VERDICT = "SELECT fact // 100000 AS fact, count(*) AS n_evidence, count(*) FILTER (WHERE status IN ('matched', 'partial')) AS n_good, CASE WHEN count(*) FILTER (WHERE status IN ('matched', 'partial')) = count(*) THEN 'confirmed' WHEN count(*) FILTER (WHERE status IN ('matched', 'partial')) = 0 THEN 'disconfirmed' ELSE 'mixed' END AS verdict FROM ({}) GROUP BY 1"


@query("fact_verdicts", with_ctes(_VERDICT.format(_CHECKED), "cited", "lines"))
def fact_verdicts(spark, sf_dir):
    return verify.verdicts(_checked(spark, sf_dir).withColumn("fact", F.expr("fact div 100000")))


_CAL = """SELECT f.fact, f.confidence AS "before", v AS verdict, CASE v WHEN 'confirmed' THEN CASE f.confidence WHEN 'low' THEN 'medium' ELSE 'high' END WHEN 'disconfirmed' THEN 'review' ELSE f.confidence END AS "after" FROM cited f JOIN
    (SELECT c.fact, CASE WHEN a.status NOT IN ('matched', 'partial') THEN 'disconfirmed' WHEN l.text IS NULL OR trim(l.text) = '' THEN 'mixed' ELSE 'confirmed' END AS v
    FROM cited c JOIN ({}) a ON a.fact = c.fact LEFT JOIN lines l ON l.path = c.path AND l.line = c.line) x ON x.fact = f.fact"""


@query("calibrate", with_ctes(_CAL.format(_CHECKED), "cited", "lines"))
def calibrate(spark, sf_dir):
    cited = citations(spark, sf_dir)
    here = cited.join(_lines(spark, sf_dir), ["path", "line"], "left").select("fact", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").otherwise("code").alias("status"))
    return verify.calibrate(cited, verify.verdicts(_checked(spark, sf_dir)), verify.verdicts(here, ("code",)))


_ANCHOR = f"CASE WHEN length({_SQ.format('snippet')}) >= 8 AND len(list_filter(string_split_regex({_SQ.format('snippet')}, '[^a-z0-9_]+'), lambda w: length(w) >= 3)) >= 2 THEN {_SQ.format('snippet')} END"


@query("snippet_relocate", with_ctes(rf'''SELECT fact, arg_min(found, CASE WHEN line BETWEEN 1 AND most THEN abs(found - line) ELSE 0 END * 1000000 + found) AS found_line FROM
    (SELECT c.fact, c.line, m.most, l.line AS found FROM (SELECT *, {_ANCHOR} AS anchor FROM cited) c LEFT JOIN (SELECT path, max(line) AS most FROM lines GROUP BY path) m ON m.path = c.path
    LEFT JOIN (SELECT path, line, {_SQ.format('text')} AS s FROM lines) l ON l.path = c.path AND contains(l.s, c.anchor)) GROUP BY fact''', "cited", "lines"))
def snippet_relocate(spark, sf_dir):
    return verify.relocate(citations(spark, sf_dir), _lines(spark, sf_dir)).select("fact", "found_line")


@query("problem_queue", with_ctes(f"SELECT path, count(*) AS n_problems FROM ({_CHECKED}) WHERE status IN ('missing', 'invalid_path') GROUP BY path", "cited", "lines"))
def problem_queue(spark, sf_dir):
    bad = _checked(spark, sf_dir).where("status in ('missing', 'invalid_path')")
    return bad.groupBy(F.col("path").cast("long").alias("path")).agg(F.count("*").alias("n_problems"))


@query("latest_decision", with_ctes("SELECT run, arg_max(ord, ord) AS ord, arg_max(event, ord) AS event FROM log GROUP BY run", "log"))
def latest_decision(spark, sf_dir):
    return resolve.latest(events(spark, sf_dir).select("run", "ord", "event"), "run", "ord")


@query("triage_queue", """SELECT c_custkey, coalesce(n, 0) AS inbound FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error') ORDER BY 2 DESC, 1 LIMIT 100""")
def triage_queue(spark, sf_dir):
    decided = events(spark, sf_dir).where("event = 'error'").select(F.col("run").alias("c_custkey")).distinct()
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(decided, "c_custkey", "left_anti").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("inbound")).orderBy(F.desc("inbound"), "c_custkey").limit(100)


@query("fact_queue", """SELECT event, count(*) AS n, count(*) FILTER (WHERE run % 3 = 0) AS n_assigned, count(*) FILTER (WHERE run % 3 <> 0) AS n_unassigned FROM (SELECT user_id AS run, arg_max(event_type, event_id) AS event FROM events GROUP BY user_id)
    WHERE event NOT IN ('purchase', 'signup') GROUP BY event""")
def fact_queue(spark, sf_dir):
    left = resolve.latest(events(spark, sf_dir).select("run", "ord", "event"), "run", "ord").where("event not in ('purchase', 'signup')")
    assigned = F.col("run") % 3 == 0
    return left.groupBy("event").agg(F.count("*").alias("n"), F.count_if(assigned).alias("n_assigned"), F.count_if(~assigned).alias("n_unassigned"))


@query("cost_trend", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS cost, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def cost_trend(spark, sf_dir):
    return folds.cost_by_day(events(spark, sf_dir))


@query("staleness_buckets", """SELECT CASE WHEN h <= 24 THEN 'fresh' WHEN h <= 72 THEN 'warm' WHEN h <= 168 THEN 'aging' ELSE 'stale' END AS bucket, count(*) AS n
    FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) / 3600.0 AS h FROM events GROUP BY user_id) GROUP BY 1""")
def staleness_buckets(spark, sf_dir):
    return folds.staleness(events(spark, sf_dir), "2024-01-31 00:00:00")


@query("run_tallies", """SELECT run, count(*) FILTER (WHERE event = 'purchase') AS completed, count(*) FILTER (WHERE event = 'error') AS failures, round(sum(cost), 2) AS cost, max(ord) AS last_ord
    FROM (SELECT user_id AS run, event_id AS ord, event_type AS event, value AS cost FROM events) GROUP BY run""")
def run_tallies(spark, sf_dir):
    return folds.tallies(events(spark, sf_dir))


@query("active_workers", with_ctes("SELECT run, ord FROM log l WHERE event = 'signup' AND NOT EXISTS (SELECT 1 FROM log p WHERE p.run = l.run AND p.event = 'purchase' AND p.ord > l.ord)", "log"))
def active_workers(spark, sf_dir):
    return folds.unfinished(events(spark, sf_dir), "signup", "purchase")


@query("since_last_tick", with_ctes("SELECT run, count(*) AS n FROM log JOIN (SELECT run AS r, max(ord) AS tick FROM log WHERE event = 'signup' GROUP BY run) ON r = run WHERE ord >= tick GROUP BY run", "log"))
def since_last_tick(spark, sf_dir):
    return folds.since_last(events(spark, sf_dir), "signup").groupBy("run").agg(F.count("*").alias("n"))


@query("dedup_events", "SELECT user_id AS run, event_type AS event, min(event_id) AS ord FROM events GROUP BY user_id, event_type")
def dedup_events(spark, sf_dir):
    return folds.first_of_each(events(spark, sf_dir))


@query("session_activity", """SELECT run, count(DISTINCT s) AS n_sessions FROM (SELECT run, sum(new) OVER (PARTITION BY run ORDER BY ts, ord) AS s FROM
    (SELECT user_id AS run, event_id AS ord, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY run""")
def session_activity(spark, sf_dir):
    return folds.sessions(events(spark, sf_dir), "30 minutes").groupBy("run").agg(F.count("*").alias("n_sessions"))


@query("sampled_events")
def sampled_events(spark, sf_dir):
    """Events at least six hours after the last kept one of their run: a state machine, tested against a plain loop."""
    return folds.sample_by_gap(events(spark, sf_dir), 6 * 3600)


_PRED, _GOLD = "SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority < '3'", "SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'"


def _edge_sets(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    edges = joined.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), "o_orderpriority", "o_orderstatus")
    return edges.where("o_orderpriority < '3'"), edges.where("o_orderstatus <> 'O'")


@query("edge_set_scores", f"""SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(5.0::DOUBLE * (tp / (tp + fp)) * (tp / (tp + fn)) / (4.0::DOUBLE * (tp / (tp + fp)) + tp / (tp + fn)), 6) AS fbeta FROM
    (SELECT (SELECT count(*) FROM ({_PRED} INTERSECT {_GOLD})) AS tp, (SELECT count(*) FROM ({_PRED} EXCEPT {_GOLD})) AS fp, (SELECT count(*) FROM ({_GOLD} EXCEPT {_PRED})) AS fn)""")
def edge_set_scores(spark, sf_dir):
    predicted, gold = _edge_sets(spark, sf_dir)
    return metrics.edge_scores(predicted, gold, beta=2.0)


@query("recall_metrics", "SELECT item_id AS question, round(avg(CASE WHEN contains(text, w) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT item_id, text, unnest(['the', 'of', 'and', 'which']) AS w FROM benchmark) GROUP BY item_id")
def recall_metrics(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    words = items.select("question", F.explode(F.array(*map(F.lit, ("the", "of", "and", "which")))).alias("word"))
    return metrics.recall_set(words, items)


@query("audit_findings", """SELECT severity, count(*) AS n FROM (SELECT CASE WHEN p_retailprice > 1500 THEN 'high' WHEN p_size > 40 THEN 'medium' WHEN p_type LIKE '%A%' THEN 'low' ELSE '-' END AS severity FROM part) GROUP BY severity""")
def audit_findings(spark, sf_dir):
    severity = F.expr("CASE WHEN p_retailprice > 1500 THEN 'high' WHEN p_size > 40 THEN 'medium' WHEN p_type LIKE '%A%' THEN 'low' ELSE '-' END")
    return table(spark, sf_dir, "part").groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))


@query("mean_and_deviation", "SELECT l_returnflag AS category, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY l_returnflag")
def mean_and_deviation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("category"))
    return rows.agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"))


@query("dependency_degree", "SELECT concat('provider:', o_custkey) AS src, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def dependency_degree(spark, sf_dir):
    return depends(spark, sf_dir).groupBy("src").agg(F.count_distinct("dst").alias("n"))
