import random
import re

import pytest

from factloom.operators import trace

EDGE = "src string, type string, dst string, n_evidence long, confidence string"
NODE = "ref string, kind string, type string"


def walked(edges, nodes, start, ends, hops, types, follow, fanout, most):
    """One hop after another, with lists."""
    kinds = {r: (k, t) for r, k, t in nodes}
    out, terminal, n = [], set(), 0
    level = [(start, "0", 0, [start])]
    while level and len(out) < most:
        later = []
        for node, branch, depth, path in level:
            own = [e for t in types for e in sorted(e for e in edges if e[0] == node and e[1] == t)[:fanout]]
            if depth >= hops or not own:
                terminal.add(node)
                continue
            for i, (_, kind, to, count, sure) in enumerate(own):
                if to in path:
                    continue
                if i:
                    n += 1
                mine = f"{branch}.{n}" if i else branch
                out.append((len(out) + 1, mine, depth + 1, node, to, kind, count, sure, False))
                if ends(to, kinds.get(to, ("", ""))[0]):
                    terminal.add(to)
                    continue
                later.append((to, mine, depth + 1, [*path, to]))
                if follow and kind == "producesMessage" and kinds.get(to, ("", ""))[0] == "Resource" and kinds[to][1] in trace.MESSAGE_TYPES:
                    for who, _, _, many, sure2 in sorted(e for e in edges if e[1] == "consumesMessage" and e[2] == to):
                        if who not in path and who != to:
                            n += 1
                            out.append((len(out) + 1, f"{mine}.async{n}", depth + 2, to, who, "consumesMessage", many, sure2, True))
                            later.append((who, f"{mine}.async{n}", depth + 2, [*path, to, who]))
        level = later
    return out, terminal


def graph(seed):
    rng = random.Random(seed)
    nodes = [(f"c{k}", "Component", None) for k in range(14)] + [(f"q{k}", "Resource", rng.choice(["topic", "queue", "table"])) for k in range(6)] + [("p", "Provider", None)]
    edges = {}
    for _ in range(90):
        a, b = f"c{rng.randrange(14)}", rng.choice(nodes)[0]
        kind = rng.choice(["producesMessage", "consumesMessage"]) if b.startswith("q") else rng.choice(["dependsOn", "consumesApi"])
        edges[a, kind, b] = (rng.randrange(5), rng.choice(["high", "low", "review"]))
    # a queue that most components hear
    for k in range(13):
        edges[f"c{k}", "consumesMessage", "q0"] = (k, "high")
    edges["c0", "producesMessage", "q0"] = (1, "high")
    return [(*k, *v) for k, v in edges.items()], [n if n[0] != "q0" else ("q0", "Resource", "topic") for n in nodes]


CASES = [
    (1, None, 3, ["consumesApi", "producesMessage", "dependsOn"], True, 12, 5000), (2, "kind:Provider", 4, ["dependsOn", "producesMessage"], True, 2, 5000),
    (3, "q1", 3, ["producesMessage", "dependsOn", "consumesMessage"], True, 3, 60), (4, "c5", 5, ["dependsOn", "consumesApi"], False, 2, 5000),
    (5, None, 6, ["producesMessage"], True, 12, 40),
]


@pytest.mark.parametrize("seed, end, hops, types, follow, fanout, most", CASES)
def test_equals_a_walk_hop_by_hop(spark, seed, end, hops, types, follow, fanout, most):
    edges, nodes = graph(seed)
    ends = lambda ref, kind: end is not None and (kind == end[5:] if end.startswith("kind:") else ref == end)
    want, terminal = walked(edges, nodes, "c0", ends, hops, types, follow, fanout, most)
    got = trace.trace(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), "c0", end, hops, types, follow, fanout, most=most)
    assert sorted(tuple(r) for r in got.hops.collect()) == want
    assert {r.ref for r in got.terminals.collect()} == terminal
    if most > 100:
        assert len(want) > 20 and any(r[8] for r in want) == follow


def test_confidence_hubs_and_a_start_without_edges(spark):
    edges = [("hub", "dependsOn", f"n{k:03}", 1, "high") for k in range(300)] + [("hub", "dependsOn", "a", 1, "review")]
    frame, nodes = spark.createDataFrame(edges, EDGE), spark.createDataFrame([("n000", "Component", None)], NODE)
    got = trace.trace(frame, nodes, "hub", fanout=5, least="medium")
    assert [r.dst for r in got.hops.orderBy("step").collect()] == [f"n{k:03}" for k in range(5)]
    assert [r.branch for r in got.hops.orderBy("step").collect()] == ["0", "0.1", "0.2", "0.3", "0.4"]
    alone = trace.trace(frame, nodes, "nowhere")
    assert alone.hops.count() == 0 and [r.ref for r in alone.terminals.collect()] == ["nowhere"]


def test_starts_and_ends_by_name_or_search(spark):
    known = spark.createDataFrame([("component:1", "Component", "orders", ["ord"], 1), ("provider:2", "Provider", "mail", [], 2)], "ref string, kind string, name string, aliases array<string>, pos long")
    found = spark.createDataFrame([("provider:2", 0.5), ("component:1", 0.7)], "ref string, score double")
    assert trace.resolved(known, "ORDERS") == "component:1"
    assert trace.resolved(known, "unheard of", found) == "component:1"
    assert trace.resolved(known, "unheard of") is None and trace.resolved(known, "unheard of", found.limit(0)) is None
    assert trace.resolved_end(known, "mail") == "provider:2"
    assert [trace.resolved_end(known, e) for e in ("kind:Provider", "resource:9", "nothing", None)] == ["kind:Provider", "resource:9", "nothing", None]


def test_facts_meet_their_orders_in_as_many_parts_as_they_have(spark, tmp_path, monkeypatch):
    """Beyond a shuffle's partitions the join has a bounded share of the lines too; all facts are there either way."""
    from factloom.plans import binding

    lines = "id div 3 as l_orderkey, id % 7 as l_partkey, id % 5 as l_suppkey, cast(id % 3 + 1 as int) as l_linenumber, 'R' as l_returnflag, 'O' as l_linestatus"
    spark.range(900).selectExpr(*lines.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id as o_orderkey", "id as o_custkey", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    few = binding.facts(spark, str(tmp_path))
    monkeypatch.setattr(binding, "PART_ROWS", 100)
    many = binding.facts(spark, str(tmp_path))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert [re.search(rf"hashpartitioning\({c}#\d+L, 10\)", plan) is not None for c in ("l_orderkey", "o_orderkey")] == [True, True]
    assert few.count() == 900 and sorted(few.collect()) == sorted(many.collect())
