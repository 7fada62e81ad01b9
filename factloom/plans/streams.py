"""A crawl's log over the events table, folded in batch and as streams that must give the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.binding import table
from factloom.plans.registry import query
from factloom.streaming import states

#: Seconds between events of one repository that are passed on: the table's events are hours apart.
GAP = 6 * 3600
_LOG = {
    "run": "concat('run', user_id % 12)", "repo": "CASE WHEN user_id % 3 = 0 THEN 'repo' ELSE concat('repo', user_id) END", "ord": "event_id",
    "event": "CASE event_type WHEN 'view' THEN 'extractor_child_event' WHEN 'click' THEN CASE WHEN value > 30 THEN 'extractor_child_event' ELSE 'extractor_heartbeat' END WHEN 'signup' THEN 'extractor_process_start' WHEN 'purchase' THEN 'repo_done' ELSE CASE WHEN value < 20 THEN 'repo_clone_failed' ELSE 'extractor_process_exit' END END",
    "inner": "CASE WHEN value < 8 THEN 'turn_completed' WHEN value < 60 THEN 'item' END", "status": "CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 40 THEN 'no_changes' WHEN value > 20 THEN 'failed' END END",
    "returncode": "CASE WHEN value > 25 THEN CAST(0 AS bigint) WHEN value > 10 THEN CAST(1 AS bigint) END", "cost": "CASE WHEN event_type = 'purchase' AND value > 10 THEN value END",
}


def _shaped(rows):
    out = rows.select(*(F.expr(x).alias(c) for c, x in _LOG.items()), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return out.select(*states.LOG)


def log(spark, sf_dir):
    return _shaped(table(spark, sf_dir, "events"))


def streamed_log(spark, sf_dir):
    # braces make the one file a pattern, as a stream reads folders and patterns only
    return _shaped(spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/{{events}}.parquet"))


_BASE = f"log AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _LOG.items())}, epoch_us(ts) AS at_ FROM events)"
_KEPT = f"""WITH RECURSIVE {_BASE}, others AS (SELECT run, repo, ord, at_ FROM log WHERE event = 'extractor_child_event' AND coalesce(inner, '') NOT IN ('turn_completed', 'thread_started')),
kept AS (SELECT run, repo, min({{'a': at_, 'o': ord}}) AS m FROM others GROUP BY run, repo
    UNION ALL SELECT k.run, k.repo, min({{'a': o.at_, 'o': o.ord}}) FROM kept k JOIN others o ON o.run = k.run AND o.repo = k.repo AND o.at_ - k.m.a >= {GAP * 1_000_000} GROUP BY k.run, k.repo)
SELECT run, repo, ord FROM log WHERE event <> 'extractor_child_event' OR inner IN ('turn_completed', 'thread_started') UNION ALL SELECT run, repo, m.o FROM kept""".replace("inner", '"inner"')
_STATES = f"""WITH {_BASE}, placed AS (SELECT *, row_number() OVER (PARTITION BY run, repo ORDER BY at_, ord) AS n, event IN ('repo_done', 'extractor_process_exit') AS done,
    CASE WHEN event = 'extractor_process_start' THEN 'starting' WHEN event IN ('extractor_child_event', 'extractor_heartbeat') THEN 'extracting' END AS p FROM log),
marked AS (SELECT *, coalesce(max(CASE WHEN done THEN n END) OVER (PARTITION BY run, repo), 0) AS ended FROM placed),
states AS (SELECT run, repo, count(*) AS version, max_by(p, n) FILTER (WHERE n > ended AND p IS NOT NULL) AS phase,
    coalesce(max(at_) FILTER (WHERE n > ended AND p = 'starting'), min(at_) FILTER (WHERE n > ended AND p IS NOT NULL)) AS started,
    max_by(event, n) FILTER (WHERE n > ended AND p IS NOT NULL) AS last_event, max_by(at_, n) FILTER (WHERE n > ended AND p IS NOT NULL) AS last,
    max_by(coalesce(status, CASE WHEN returncode = 0 THEN 'ok' END), n) FILTER (WHERE done AND (status IS NOT NULL OR returncode = 0)) AS status, max_by(cost, n) FILTER (WHERE done AND cost IS NOT NULL) AS cost,
    max_by(at_, n) FILTER (WHERE done) AS completed FROM marked GROUP BY run, repo)"""


@query("kept_child_events", _KEPT)
def kept_child_events(spark, sf_dir):
    return states.sample_children(log(spark, sf_dir), GAP)


@query("streamed_child_events", _KEPT)
def streamed_child_events(spark, sf_dir):
    return states.drained(states.stream_children(streamed_log(spark, sf_dir), GAP), "append")


@query("repo_states", f"{_STATES} SELECT * FROM states")
def repo_states(spark, sf_dir):
    return states.repo_states(log(spark, sf_dir))


@query("streamed_repo_states", f"{_STATES} SELECT * FROM states")
def streamed_repo_states(spark, sf_dir):
    return states.last_states(states.drained(states.stream_repo_states(streamed_log(spark, sf_dir)), "update")).select("run", "repo", *states.FIELDS)


@query("crawl_tallies", f"""{_STATES}, failed AS (SELECT run, count(*) AS n FROM log WHERE event = 'repo_clone_failed' GROUP BY run)
    SELECT run, count(phase) AS active, count(completed) AS completed, count(*) FILTER (WHERE status IN ('ok', 'no_changes')) AS ok, count(*) FILTER (WHERE status NOT IN ('ok', 'no_changes')) + coalesce(max(n), 0) AS failures, round(sum(cost), 4) AS cost
    FROM states LEFT JOIN failed USING (run) GROUP BY run""")
def crawl_tallies(spark, sf_dir):
    rows = log(spark, sf_dir)
    return states.run_tallies(states.repo_states(rows), rows)


@query("run_output_tails", """SELECT run, right(string_agg(line || chr(10), '' ORDER BY ord), 4000) AS tail FROM
    (SELECT concat('run', conv_id % 12) AS run, conv_id * 1000 + turn AS ord, text AS line FROM conversations) WHERE line <> '' GROUP BY run""")
def run_output_tails(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.expr("concat('run', conv_id % 12)").alias("run"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("line"))
    return states.output_tail(rows)
