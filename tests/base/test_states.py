import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import states

LOG = "run string, repo string, ord long, at long, event string, inner string, status string, returncode long, cost double"
SECOND = 1_000_000


def log(n=400, seed=1):
    rng, rows, at = random.Random(seed), [], 0
    for k in range(n):
        at += rng.randrange(12) * SECOND // 2
        # a third of all events are of one repository
        repo = "hot" if rng.random() < 0.33 else rng.choice(["a", "b", "c", None])
        event = rng.choice([states.CHILD] * 6 + ["extractor_process_start", "extractor_process_pid", "extractor_heartbeat", "extractor_process_exit", "repo_done", "repo_clone_failed", "noise"])
        rows.append((f"r{k % 2}", repo, k, at, event, rng.choice(["item", "turn_completed", None]), rng.choice(["ok", "failed", None]), rng.choice([0, 1, None]), rng.choice([1.5, None])))
    return rows


def one_by_one(rows, gap=15 * SECOND):
    """Events in order with a dictionary for each run."""
    kept, last, state = set(), {}, {}
    for run, repo, ord_, at, event, inner, status, code, cost in sorted(rows, key=lambda r: (r[3], r[2])):
        if repo is None:
            continue
        key = (run, repo)
        if event != states.CHILD or inner in states.ALWAYS:
            kept.add((run, repo, ord_))
        elif key not in last or at - last[key] >= gap:
            last[key] = at
            kept.add((run, repo, ord_))
        active, done, n = state.get(key, (None, {}, 0))
        if event in states.COMPLETIONS:
            active, done = None, done | {k: v for k, v in {"status": status or ("ok" if code == 0 else None), "cost": cost, "completed": at}.items() if v is not None}
        elif event in states.PHASES:
            started = at if active is None or event == "extractor_process_start" else active[1]
            active = (states.PHASES[event], started, event, at)
        state[key] = (active, done, n + 1)
    flat = {(*k, n, *(a or (None,) * 4), d.get("status"), d.get("cost"), d.get("completed")) for k, (a, d, n) in state.items()}
    return kept, flat


def test_batch_equals_one_by_one(spark):
    rows = log()
    kept, flat = one_by_one(rows)
    frame = spark.createDataFrame(rows, LOG)
    assert {tuple(r) for r in states.sample_children(frame).collect()} == kept
    assert {tuple(r) for r in states.repo_states(frame).collect()} == flat
    assert 0 < len(kept) < len([r for r in rows if r[1]])
    tallies = {r.run: r for r in states.run_tallies(states.repo_states(frame), frame).collect()}
    for run in ("r0", "r1"):
        own = [s for s in flat if s[0] == run]
        fails = sum(r[0] == run and r[4] == "repo_clone_failed" for r in rows)
        assert (tallies[run].active, tallies[run].completed) == (sum(s[3] is not None for s in own), sum(s[9] is not None for s in own))
        assert tallies[run].failures == fails + sum(s[7] == "failed" for s in own)
    assert states.repo_states(frame.limit(0)).count() == 0


def test_streams_equal_the_batch_across_restarts(spark, tmp_path):
    """The log comes in four parts; each is a run of the streams of its own, which go on from where they were."""
    rows = log()
    kept, flat = one_by_one(rows)
    for k in range(4):
        part = spark.createDataFrame(rows[k * 100 : k * 100 + 100], LOG).repartition(3)
        part.write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
        sampled = states.drained(states.stream_children(stream, late="10 minutes"), "append", str(tmp_path / "children"))
        states_ = states.drained(states.stream_repo_states(stream, late="10 minutes"), "update", str(tmp_path / "states"))
    assert sorted(map(tuple, sampled.collect())) == sorted(kept)
    assert {tuple(r) for r in states.last_states(states_).collect()} == flat
    assert states_.count() > len(flat)


def test_lines_of_a_child(spark):
    lines = ['{"event":"repo_done","repo":"a","status":"ok","cost_usd":1.5,"ts":"2024-01-01T00:00:01Z"}', "plain " + "x" * 2000, "", None, "[1]", "5", '{"event": "broken', json.dumps({"event": states.CHILD, "repo": "a", "line": '{"event":"turn_completed"}'})]
    frame = spark.createDataFrame([("r", k, line) for k, line in enumerate(lines)], "run string, ord long, line string").withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200)))
    got = {r.ord: r for r in states.parsed(frame).collect()}
    assert sorted(got) == [0, 1, 4, 5, 6, 7]
    assert (got[0].event, got[0].repo, got[0].status, got[0].cost, got[0].at) == ("repo_done", "a", "ok", 1.5, 1_704_067_201 * SECOND)
    assert [got[k].event for k in (1, 4, 5, 6)] == ["crawler_output"] * 4 and len(got[1].line) == 1200
    assert got[7].inner == "turn_completed"


@pytest.mark.parametrize("chars", [7, 60, 4000])
def test_tail_of_a_run(spark, chars):
    rng = random.Random(chars)
    rows = [(f"r{k % 3}", k, "é" * rng.choice((1, 2, 30, 90))) for k in range(300)]
    want = {run: "".join(line + "\n" for r, _, line in rows if r == run)[-chars:] for run in ("r0", "r1", "r2")}
    assert {r.run: r.tail for r in states.output_tail(spark.createDataFrame(rows, "run string, ord long, line string"), chars).collect()} == want


def test_rows_of_a_large_key_are_held_compactly():
    import random
    import tracemalloc

    from pyspark.sql import Row

    rng, n = random.Random(4), 50_000
    shape = Row("at", "ord", "event", "status", "returncode", "cost")
    made = lambda: (shape(10**9 + rng.randrange(n // 2), k, "".join(["e", str(k % 3)]), None if k % 2 else "ok", k % 5 or None, None if k % 3 else k / 7) for k in range(n))
    rng.seed(4)
    want = [(r.at, r.ord, r.cost, r.event, r.status, r.returncode) for r in sorted(made(), key=lambda r: (r.at, r.ord))]
    rng.seed(4)
    tracemalloc.start()
    same = all(x == y for x, y in zip(states._in_order(made(), "event", "status", "returncode"), want, strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same and peak < 150 * n
