import random

from factloom.functions import confidence, text
from factloom.operators import derive, graph, merge, verify
from factloom.plans import binding, registry
from factloom.streaming import folds
from pyspark.sql import functions as F


def test_every_query_but_the_state_machine_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"sampled_events"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Order-Service API",), ("api",), (None,), ("  ///  ",)], "v string")
    got = [(r.a, r.b) for r in df.select(text.canonical_key("v").alias("a"), text.canonical_name("v").alias("b")).collect()]
    assert got == [("order", "Order-Service-API"), ("api", "api"), ("", "unknown"), ("", "unknown")]
    hosts = spark.createDataFrame([("https://Orders-api.example.com:80/x",), ("",)], "v string")
    assert [r[0] for r in hosts.select(text.host_key("v")).collect()] == ["orders", ""]
    assert text.search_terms("the async") == sorted(["the", "async", "asynchronous", "asynchronously", "message", "messages", "queue", "broker"])


def test_confidence(spark):
    df = spark.createDataFrame([("high",), (None,), ("review",)], "c string")
    got = [tuple(r) for r in df.select(confidence.query_rank(F.col("c")), confidence.build_rank(F.col("c")), confidence.weight(F.col("c"))).collect()]
    assert got == [(3, 3, 1.0), (1, -1, 0.5), (0, 0, 0.1)]
    empty = spark.createDataFrame([(None,)], "c string")
    assert empty.agg(merge.floor(F.col("c"))).first()[0] == "medium" and empty.agg(merge.highest(F.col("c"))).first()[0] is None


def test_neighbours_of_cyclic_graphs_match_a_loop(spark):
    rng = random.Random(1)
    edges = sorted({(f"n{rng.randrange(9)}", rng.choice("ab"), f"n{rng.randrange(9)}") for _ in range(25)})
    df = spark.createDataFrame([(*e, "high") for e in edges], "src string, type string, dst string, confidence string")
    start = spark.createDataFrame([("n0",)], "ref string")
    want, seen, front = [], {"n0"}, {"n0"}
    for level in (1, 2, 3):
        met = [(s, t, d, "out", level) for s, t, d in edges if s in front] + [(s, t, d, "in", level) for s, t, d in edges if d in front]
        want += met
        front = {m[2] if m[3] == "out" else m[0] for m in met} - seen
        seen |= front
    assert sorted(map(tuple, graph.neighbors(df, start, "both", 3).collect())) == sorted(want)
    paths, found = [("n0",)], []
    for level in (1, 2, 3):
        paths = [(p + (d,), t) for p in paths for s, t, d in edges if s == p[-1] and d not in p]
        found += [(">".join(p), t, level) for p, t in paths]
        paths = [p for p, _ in paths]
    assert sorted(map(tuple, graph.trace(df, start, 3).collect())) == sorted(found)


def test_snippets(spark):
    files = spark.createDataFrame([("f", "one\ntwo words here\nthree\nfour\nfive\nsix\nseven\n")], "path string, text string")
    rows = [(1, "f", 3, "Two  WORDS here"), (2, "f", 7, "two words here"), (3, "f", 2, "two words absent"), (4, "f", 99, "one"), (5, "../f", 1, "one")]
    checked = verify.check(spark.createDataFrame(rows, "fact int, path string, line int, snippet string"), verify.source_lines(files))
    assert {r.fact: r.status for r in checked.collect()} == {1: "matched", 2: "missing", 3: "partial", 4: "invalid_path", 5: "invalid_path"}


def test_sampling_matches_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), k, rng.randrange(10_000)) for k in range(200)]
    df = spark.createDataFrame(rows, "run long, ord long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, last = set(), {}
    for run, k, s in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if run not in last or s - last[run] >= 900:
            want.add((run, k))
            last[run] = s
    assert set(map(tuple, folds.sample_by_gap(df, 900).collect())) == want


def test_streamed_tallies(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:10:00", "x", 1.0), (1, 2, "2024-01-01 00:20:00", "x", 2.0), (2, 3, "2024-01-02 00:00:00", "x", 4.0)]
    spark.createDataFrame(rows, "run long, ord long, ts string, event string, cost double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("run long, ord long, ts timestamp, event string, cost double").parquet(f"{tmp_path}/in")
    job = folds.stream_tallies(stream).writeStream.format("memory").queryName("tallies").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    job.awaitTermination()
    assert {(r.run, r.n, r.cost) for r in spark.table("tallies").collect()} == {(1, 2, 3.0), (2, 1, 4.0)}


def test_api_calls_meet_at_the_api(spark):
    rows = [("a", "consumesApi", "api:1", "high", 2), ("b", "providesApi", "api:1", "low", 3), ("a", "providesApi", "api:2", "low", 1)]
    df = spark.createDataFrame(rows, "src string, type string, dst string, confidence string, n_evidence long")
    assert [(r.src, r.dst, r.n_via, r.n_evidence, r.confidence) for r in derive.api_calls(df).collect()] == [("a", "b", 1, 5, "low")]


def test_tag_inventory_holds_five_parts_of_a_tag(spark, tmp_path):
    rows = [(k, "BIG" if k % 3 else None, f"b{k % 2}") for k in range(3000)] + [(9000, "ONE", "b9")]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    out = registry.queries()["tag_inventory"](spark, str(tmp_path))
    assert {r.tag: (r.n, r.brands, r.samples) for r in out.collect()} == {"BIG": (2000, "b0,b1", "1,2,4,5,7"), None: (1000, "b0,b1", "0,3,6,9,12"), "ONE": (1, "b9", "9000")}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_facts_are_dealt_by_relation_before_they_merge(spark, monkeypatch):
    monkeypatch.setattr(binding, "PART_ROWS", 1000)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert binding.facts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == rows // 1000 + 1


def test_levels_read_edges_that_are_written_once(spark, monkeypatch):
    kept, calls = graph.kept, []
    monkeypatch.setattr(graph, "kept", lambda df: (calls.append(1), kept(df))[1])
    edges = spark.createDataFrame([("a", "t", "b", "high"), ("b", "t", "c", "high"), ("c", "t", "d", "high")], "src string, type string, dst string, confidence string")
    start = spark.createDataFrame([("a",)], "ref string")
    assert {(r.src, r.way, r.depth) for r in graph.neighbors(edges, start, "both", 2).collect()} == {("a", "out", 1), ("a", "in", 2), ("b", "out", 2)}
    assert {r.path for r in graph.trace(edges, start, 2).collect()} == {"a>b", "a>b>c"}
    assert len(calls) == 2
