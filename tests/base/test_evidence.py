import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import assemble, evidence

LIST = evidence.EVIDENCE
EDGE = f"src string, type string, dst string, ord long, confidence string, evidence {LIST}, properties map<string,array<string>>, extra int"
ENTITY = f"ref string, ord long, kind string, title string, description string, tags array<string>, aliases array<string>, source_repos array<string>, attributes array<struct<attribute:string,meaning:string>>, glossary array<struct<term:string,definition:string>>, confidence string, evidence {LIST}"
RANK = {"review": 0, "low": 1, "medium": 2, "high": 3}


def higher(a, b):
    return a if RANK.get(a, -1) >= RANK.get(b, -1) else b


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_equal_facts_folded_one_by_one(spark, seed):
    """A third of the facts are of one edge; places repeat with other snippets, and properties are missing, null and repeated."""
    rng = random.Random(seed)
    rows = []
    for k in range(900):
        edge = ("Component:a", "dependsOn", "Resource:hot") if k % 3 == 0 else (f"Component:{rng.randrange(9)}", "dependsOn", f"Resource:{rng.randrange(9)}")
        cited = rng.choice([None, []]) if rng.random() < 0.2 else [(rng.choice(["f", "g", None]), rng.choice([None, *range(9)]), f"s{rng.randrange(99)}") for _ in range(rng.randint(1, 4))]
        names = rng.sample(["aliases", "transports", "via_edges", "note", "operation"], rng.randint(0, 4))
        rows.append((*edge, k, rng.choice([None, "", *RANK]), cited, {n: [f"{n}{rng.randrange(6)}" for _ in range(rng.randint(0, 2))] for n in names} if rng.random() < 0.9 else None, k))
    want = {}
    for src, kind, dst, _, sure, cited, properties, _ in rows:
        held = want.setdefault((src, kind, dst), {"c": None, "e": {}, "p": {}})
        for path, line, snippet in cited or []:
            held["e"].setdefault((path, line), snippet)
        for name, values in (properties or {}).items():
            if name in evidence.UNITED:
                held["p"][name] = sorted(set(held["p"].get(name, [])) | set(values))
            else:
                held["p"].setdefault(name, values)
        held["c"] = higher(held["c"], sure) if sure in RANK else held["c"]
    rng.shuffle(rows)
    got = evidence.merge_relations(spark.createDataFrame(rows, EDGE)).collect()
    assert len(got) == len(want)
    for r in got:
        held = want[r.src, r.type, r.dst]
        assert (r.confidence, r.n_evidence) == (held["c"], len(held["e"]))
        assert [tuple(e) for e in r.evidence] == [(*place, s) for place, s in held["e"].items()][: evidence.KEPT]
        assert r.evidence_file == (r.evidence[0].path if r.evidence else None)
        assert r.properties == held["p"]
    assert max(r.n_evidence for r in got) > evidence.KEPT


def test_entities_keep_first_texts_unions_and_items(spark):
    rows = [
        ("Resource:q", 2, "Resource", "Queue", "second", ["b", "a", None], ["x"], ["r2"], [("ttl", "late"), ("size", "n")], [("ack", "two")], "high", [("f", 1, "later"), ("g", 1, "new")]),
        ("Resource:q", 1, "Resource", "", "first", ["b"], None, ["r1"], [("ttl", "early"), ("", "none"), (None, "none")], None, "low", [("f", 1, "first")]), ("Resource:q", 1, "Resource", "", "first", ["b"], None, ["r1"], None, None, None, None),
        ("API:none", 1, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.ref: r for r in evidence.merge_entities(spark.createDataFrame(rows, ENTITY)).collect()}
    q, none = got["Resource:q"], got["API:none"]
    assert (q.kind, q.title, q.description, q.confidence) == ("Resource", "Queue", "first", "high")
    assert (q.tags, q.aliases, q.source_repos) == (["a", "b"], ["x"], ["r1", "r2"])
    assert [tuple(a) for a in q.attributes] == [("ttl", "early"), ("size", "n")] and [tuple(g) for g in q.glossary] == [("ack", "two")]
    assert [tuple(e) for e in q.evidence] == [("f", 1, "first"), ("g", 1, "new")] and (q.n_evidence, q.evidence_file) == (2, "f")
    assert (none.tags, none.attributes, none.evidence, none.n_evidence, none.evidence_file, none.confidence) == ([], [], [], 0, None, None)
    assert evidence.merge_entities(spark.createDataFrame([], ENTITY)).count() == 0
    shown = spark.createDataFrame([([("p", k, "s" * 300) for k in range(8)],)], f"e {LIST}").select(evidence.queued(F.col("e")).alias("q"), evidence.embedded(F.col("e")).alias("t")).first()
    assert (len(shown.q), [len(t) for t in shown.t]) == (5, [200] * 6)


def test_assembled_facts_carry_their_evidence(spark):
    cite = lambda *lines: [{"path": "a.py", "line": n, "snippet": f"s{n}"} for n in lines]
    docs = [{"repo": {"id": f"acme/r{k}"}, "components": [{"name": "m", "evidence": cite(k)}], "resources": [{"name": "jobs", "access": "read", "evidence": cite(*range(k, k + 3))}]} for k in range(12)]
    lines = spark.createDataFrame([(json.dumps(d),) for d in docs], "d string")
    entities, relations = assemble.catalog(lines.select(F.from_json("d", assemble.DOCUMENT).alias("d")).select("d.*"))
    jobs = entities.where("ref = 'Resource:jobs'").first()
    assert jobs.n_evidence == 14 and jobs.evidence_file == "a.py"
    # repositories go by name, so r10's and r11's places stand before r2's
    assert [e.line for e in jobs.evidence] == [0, 1, 2, 3, 10, 11, 12, 13]
    edge = relations.where("src = 'Component:r4' and dst = 'Resource:jobs'").first()
    assert ([e.line for e in edge.evidence], edge.n_evidence, edge.evidence_file) == ([4, 5, 6], 3, "a.py")


def test_places_take_two_shuffles(spark):
    facts = spark.createDataFrame([], EDGE)
    plan = evidence.first_places(facts, ["src", "type", "dst"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def _facts(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        edge = ("Component:a", "dependsOn", "Resource:hot") if k % 3 == 0 else (f"Component:{rng.randrange(9)}", "dependsOn", f"Resource:{rng.randrange(9)}")
        # equal orders, so that ties are told by what follows
        cited = rng.choice([None, [], [None]]) if rng.random() < 0.2 else [(rng.choice(["f", "", None, "-", "1:p"]), rng.choice([None, *range(-3, 6)]), rng.choice([None, *"xyz"])) for _ in range(rng.randint(1, 4))]
        properties = {name: rng.choice([None, [], [None, "b"], [rng.choice("abc")]]) for name in rng.sample(["aliases", "transports", "note", "operation"], rng.randint(0, 4))}
        rows.append((*edge, k // 2, rng.choice([None, "odd", *RANK]), cited, properties if rng.random() < 0.9 else None, k))
    return rows


@pytest.mark.parametrize("hot", [0, 200])
def test_busy_edges_and_others_are_merged_alike(spark, monkeypatch, hot):
    """All edges spread, or one, come to what edges in one place do."""
    facts = spark.createDataFrame(_facts(700, hot), EDGE)
    rows = lambda found: {r[:3]: r for r in found.select("src", "type", "dst", *sorted(found.columns)).collect()}
    want = rows(evidence.merge_relations(facts))
    monkeypatch.setattr(evidence, "HOT", hot)
    assert (busy := evidence._dealt(facts, ["src", "type", "dst"])[1]) is not None and (busy.count() < 700) == (hot > 0)
    assert rows(evidence.merge_relations(facts)) == want
    assert len(want) > 50 and max(r.n_evidence for r in want.values()) > evidence.KEPT


def test_facts_of_edges_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PART_ROWS", 50)
    found = evidence.merge_relations(spark.createDataFrame(_facts(200, 1), EDGE))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(src" in plan
    assert ", 5), REPARTITION_BY_NUM" in plan
