"""Folds of a crawl's log that keep state between events: in batch over sorted rows, and as streams with the state in a store.

The log has run, repo, ord, at (microseconds), event, inner (what an extractor's own event is), status, returncode and cost.
Both forms go through the same step for each event of a (run, repo), in order of at and ord, so a stream gives what the batch
gives wherever it is stopped and started again, as long as its batches come in order.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from factloom.operators.graph import shared_folder

# The event that is thinned out, what of it is always kept, seconds between others; events of completion and of
# failure; states of success; characters of a run's output and of one foreign line that are kept.
CHILD, ALWAYS, GAP_SECONDS = "extractor_child_event", ("turn_completed", "thread_started"), 15
COMPLETIONS = ("extractor_process_exit", "repo_done")
CLONE_FAILURES = ("repo_clone_failed", "seed_clone_failed", "gh_repo_api_error", "gh_repo_list_error")
SUCCESSES = ("ok", "no_changes")
TAIL_CHARS, LINE_CHARS = 4000, 1200
PHASES = {"extractor_process_start": "starting", "extractor_process_pid": "extracting", "extractor_heartbeat": "extracting", CHILD: "extracting"}

LOG = ("run", "repo", "ord", "at", "event", "inner", "status", "returncode", "cost")
STATE = "version long, phase string, started long, last_event string, last long, status string, cost double, completed long"
FIELDS = [c.split()[0] for c in STATE.split(", ")]
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _given(value: Any) -> Any:
    return None if value is None or pd.isna(value) else value


def keeps(event: str, inner: str | None, at: int, last: int | None, gap: int) -> tuple[bool, int | None]:
    """Whether an event is passed on, and when the last one was that others have to keep their distance from."""
    if event != CHILD or inner in ALWAYS:
        return True, last
    return (True, at) if last is None or at - last >= gap else (False, last)


def folded(state: dict, event: str, at: int, status: str | None, returncode: int | None, cost: float | None) -> dict:
    """The state of a (run, repo) after an event: a worker that is active (with a phase), and what its completions say; a later one adds to an earlier."""
    state = state | {"version": state["version"] + 1}
    if event in COMPLETIONS:
        told = {"status": status or ("ok" if returncode == 0 else None), "cost": cost, "completed": at}
        return state | {"phase": None, "started": None, "last_event": None, "last": None} | {k: v for k, v in told.items() if v is not None}
    if event not in PHASES:
        return state
    started = at if state["phase"] is None or event == "extractor_process_start" else state["started"]
    return state | {"phase": PHASES[event], "started": started, "last_event": event, "last": at}


def _begin() -> dict:
    return dict.fromkeys(FIELDS) | {"version": 0}


def _sorted_by_key(log: DataFrame, columns: list[str]) -> DataFrame:
    return log.where("repo is not null").select(*columns).repartition("run", "repo").sortWithinPartitions("run", "repo", "at", "ord")


def sample_children(log: DataFrame, seconds: int = GAP_SECONDS) -> DataFrame:
    """(run, repo, ord) of the events that are passed on; one time is remembered for the (run, repo) that a task is at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = last = None
        for batch in batches:
            keep = []
            for key, repo, at, event, inner in zip(batch["run"], batch["repo"], batch["at"], batch["event"], batch["inner"], strict=True):
                if (key, repo) != current:
                    current, last = (key, repo), None
                kept, last = keeps(event, inner, at, last, seconds * 1_000_000)
                keep.append(kept)
            yield batch.loc[keep, ["run", "repo", "ord"]]

    rows = _sorted_by_key(log, ["run", "repo", "ord", "at", "event", "inner"])
    return rows.mapInPandas(run, f"run {log.schema['run'].dataType.simpleString()}, repo string, ord long")


def repo_states(log: DataFrame) -> DataFrame:
    """The last state of each (run, repo); one state is held for the (run, repo) that a task is at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, _begin()
        row = lambda: pd.DataFrame([(*current, *(state[c] for c in FIELDS))], columns=["run", "repo", *FIELDS])
        for batch in batches:
            out = []
            for key, repo, at, event, status, code, cost in zip(*(batch[c] for c in ("run", "repo", "at", "event", "status", "returncode", "cost")), strict=True):
                if (key, repo) != current:
                    if current is not None:
                        out.append(row())
                    current, state = (key, repo), _begin()
                state = folded(state, event, at, _given(status), _given(code), _given(cost))
            if out:
                yield pd.concat(out)
        if current is not None:
            yield row()

    rows = _sorted_by_key(log, ["run", "repo", "ord", "at", "event", "status", "returncode", "cost"])
    return rows.mapInPandas(run, f"run {log.schema['run'].dataType.simpleString()}, repo string, {STATE}")


def _in_order(rows: Iterator[Any], *columns: str) -> Iterator[tuple]:
    """(at, ord, cost, *columns) of one key's rows by (at, ord).  A key may have a large part of a batch, so numbers are held as such and what recurs once."""
    at, order, code, cost, told = array("q"), array("q"), array("q"), array("d"), {}
    for r in rows:
        at.append(r.at)
        order.append(r.ord)
        cost.append(0.0 if r.cost is None else r.cost)
        code.append(told.setdefault((r.cost is None, *(r[c] for c in columns)), len(told)))
    names = list(told)
    for k in np.lexsort((np.asarray(order), np.asarray(at))):
        none, *values = names[code[k]]
        yield at[k], order[k], None if none else cost[k], *values


class _Sampler(StatefulProcessor):
    """The last time of a (run, repo) as value state; a timer drops it once it can't hold an event back any more."""

    def __init__(self, seconds: int) -> None:
        self.gap = seconds * 1_000_000

    def init(self, handle: Any) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = was = self.last.get()[0] if self.last.exists() else None
        for at, ord_, _, event, inner in _in_order(rows, "event", "inner"):
            kept, last = keeps(event, inner, at, last, self.gap)
            if kept:
                yield Row(run=key[0], repo=key[1], ord=ord_)
        if last != was:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class _RepoFold(StatefulProcessor):
    """The state of a (run, repo) as value state, given out after each batch that has an event of it."""

    def init(self, handle: Any) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = dict(zip(FIELDS, self.state.get(), strict=True)) if self.state.exists() else _begin()
        for at, _, cost, event, status, returncode in _in_order(rows, "event", "status", "returncode"):
            state = folded(state, event, at, status, returncode, cost)
        values = tuple(state[c] for c in FIELDS)
        self.state.update(values)
        yield Row(run=key[0], repo=key[1], **state)

    def close(self) -> None:
        pass


def _keyed(log: DataFrame, late: str) -> DataFrame:
    """A streamed log with its time as a watermark, by (run, repo)."""
    log.sparkSession.conf.set(*_STORE)
    return log.where("repo is not null").select(*LOG).withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)


def stream_children(log: DataFrame, seconds: int = GAP_SECONDS, late: str = "1 hour") -> DataFrame:
    """`sample_children` of a stream.  Events that come later than the watermark allows are left out."""
    schema = f"run {log.schema['run'].dataType.simpleString()}, repo string, ord long"
    return _keyed(log, late).groupBy("run", "repo").transformWithState(_Sampler(seconds), schema, "Append", "EventTime")


def stream_repo_states(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """States of the (run, repo) of a stream as they change; the greatest version is the last (`last_states`)."""
    schema = f"run {log.schema['run'].dataType.simpleString()}, repo string, {STATE}"
    return _keyed(log, late).groupBy("run", "repo").transformWithState(_RepoFold(), schema, "Update", "EventTime")


def last_states(states: DataFrame) -> DataFrame:
    rest = [c for c in states.columns if c not in ("run", "repo", "version")]
    return states.groupBy("run", "repo").agg(F.max(F.struct("version", *rest)).alias("s")).select("run", "repo", "s.*")


def run_tallies(states: DataFrame, log: DataFrame) -> DataFrame:
    """(run, active, completed, ok, failures, cost) from states and the failures to clone of a log: totals are sums over states, so no run is one task's."""
    status = F.coalesce("status", F.lit(""))
    sums = states.groupBy("run").agg(
        F.count("phase").alias("active"), F.count("completed").alias("completed"), F.count_if(status.isin(*SUCCESSES)).alias("ok"),
        F.count_if((status != "") & ~status.isin(*SUCCESSES)).alias("failed"), F.round(F.sum("cost"), 4).alias("cost"),
    )
    clones = log.where(F.col("event").isin(*CLONE_FAILURES)).groupBy("run").agg(F.count("*").alias("clones"))
    found = sums.join(clones, "run", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("run", zero("active"), zero("completed"), zero("ok"), (F.coalesce("failed", F.lit(0)) + F.coalesce("clones", F.lit(0))).alias("failures"), "cost")


def parsed(lines: DataFrame) -> DataFrame:
    """A child's output (run, ord, ts, line) as log rows, in batch or as a stream: JSON objects as their events, other lines as crawler_output with their first LINE_CHARS; empty ones go."""
    schema = "event string, repo string, status string, returncode long, cost_usd double, run_id string, ts string, line string"
    is_object = F.col("line").rlike(r"^\s*\{") & F.coalesce(F.typeof(F.try_parse_json("line")) == "variant", F.lit(False)) & F.try_parse_json("line").isNotNull()
    told = lines.where(F.coalesce("line", F.lit("")) != "").withColumn("e", F.when(is_object, F.from_json("line", schema)))
    inner = F.get_json_object(F.col("e.line"), "$.event")
    at = F.unix_micros(F.coalesce(F.col("e.ts").try_cast("timestamp"), F.col("ts").cast("timestamp")))
    event = F.when(F.col("e").isNull(), "crawler_output").otherwise(F.col("e.event"))
    line = F.when(F.col("e").isNull(), F.substring("line", 1, LINE_CHARS)).otherwise(F.col("e.line"))
    return told.select(F.coalesce("e.run_id", "run").alias("run"), F.coalesce("e.repo", F.lit("")).alias("repo"), "ord", at.alias("at"), event.alias("event"), inner.alias("inner"),
                       "e.status", "e.returncode", F.col("e.cost_usd").alias("cost"), line.alias("line"))


def output_tail(lines: DataFrame, chars: int = TAIL_CHARS) -> DataFrame:
    """(run, tail): the last `chars` characters of each run's lines, a line feed after each.

    A line has two characters at least with its feed, so the last chars / 2 lines of each part of a run, and then of the run, hold them."""
    rows = lines.where(F.coalesce("line", F.lit("")) != "").select("run", "ord", F.concat(F.substring("line", -chars, chars), F.lit("\n")).alias("line"), F.pmod(F.xxhash64("ord"), F.lit(16)).alias("salt"))
    newest = lambda *by: Window.partitionBy("run", *by).orderBy(F.desc("ord"))
    for by in (("salt",), ()):
        rows = rows.withColumn("n", F.row_number().over(newest(*by))).where(F.col("n") <= chars // 2 + 1)
    before = F.sum(F.length("line")).over(newest().rowsBetween(Window.unboundedPreceding, 0)) - F.length("line")
    held = rows.withColumn("before", before).where(F.col("before") < chars).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return held.select("run", F.substring(F.array_join(F.transform("l", lambda x: x["line"]), ""), -chars, chars).alias("tail"))


def drained(stream: DataFrame, mode: str, place: str | None = None, write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """What a stream over all there is gives, appended to a Parquet table under `place`, a folder that later calls go on from; without it a new one in the shared folder.

    A batch that is written a second time, after a failure, goes to the same folder as the first, so nothing is there twice."""
    spark = stream.sparkSession
    place = place or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/state").foreachBatch(write or put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{place}/out").parquet(f"{place}/out").select(*stream.columns)
