import random
import re

import pytest

from factloom.operators import audit

EVIDENCE = "array<struct<path:string,line:int,snippet:string>>"
ENTITY = f"kind string, name string, external boolean, source_repos array<string>, evidence {EVIDENCE}, pos int"
RELATION = f"src string, type string, dst string, target_kind string, source_repos array<string>, evidence {EVIDENCE}, pos int"
FILE = "path string, text string, lang string"


def cite(*pairs):
    return [(path, 1, snippet) for path, snippet in pairs]


def test_kinds_endpoints_and_provenance_without_a_workspace(spark):
    entities = [
        ("Component", "orders", False, ["acme/orders"], cite(("src/app.py", "orders")), 1), ("Component", "orders-db", True, None, [], 2), ("Resource", "orders-db", None, ["acme/orders"], cite(("src/db.py", "x")), 3),
        ("API", "Orders-API", None, [], None, 4), ("Provider", "pay", None, None, [], 5), ("System", "shop", None, None, None, 6), ("Component", None, None, None, None, 7), ("Component", "orders", False, ["acme/orders"], cite(("src/app.py", "orders")), 1),
    ]
    edges = [
        ("Component:orders", "readsResource", "Component:orders-db", None, ["acme/orders"], cite(("src/db.py", "orders-db")), 1), ("Component:gone", "dependsOn", "Provider:pay", "Provider", None, [], 2),
        ("Component:orders", "consumesApi", "Resource:orders-db", "resource", ["b", "a"], [], 3), ("Component:orders", "partOf", "System:shop", "domain", None, None, 4), ("Component:orders", "partOf", "System:shop", None, None, None, 5), (None, None, "bare", None, None, None, 6),
    ]
    entities, edges = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(edges, RELATION)
    rows = audit.audit(entities, edges)
    assert tuple(rows.columns) == audit.COLUMNS
    got = {r.fact: (r.verdict, r.severity, r.recommended_fix, r.actual, r.source_evidence) for r in rows.collect()}
    assert rows.count() == 13
    assert got["Component:orders"] == ("PASS", "-", audit.PASSED, "Component; source_repos=['acme/orders']; evidence=1", "1 citation(s), workspace not provided")
    assert got["Component:orders-db"][:3] == ("FAIL", "high", "wrong-kind-duplicate: component name also emitted as Resource")
    assert got["API:Orders-API"][:4] == ("FAIL", "high", "missing-provenance: API has no source_repos annotation", "API; source_repos=-; evidence=0")
    assert got["Provider:pay"][:3] == ("REVIEW", "medium", "missing-provenance: provider has no source_repos annotation")
    assert got["Component:"][2] == "missing-evidence: no cited evidence"
    assert got["Component:orders -[readsResource]-> Component:orders-db"][2] == "target-kind-mismatch: readsResource target is Component, expected Resource"
    assert got["Component:gone -[dependsOn]-> Provider:pay"][2:4] == ("missing-endpoint: source endpoint does not exist: Component:gone", "dependsOn; source_repo=-; evidence=0")
    assert got["Component:orders -[consumesApi]-> Resource:orders-db"][2:4] == ("target-kind-mismatch: consumesApi target is Resource, expected Component or API", "consumesApi; source_repo=a; evidence=0")
    assert got[" -[]-> bare"][2] == "missing-endpoint: source endpoint does not exist: "
    by_row = {r.recommended_fix for r in rows.where("fact like '%partOf%'").collect()}
    assert by_row == {"target-kind-property-mismatch: property target_kind=domain, target ref kind=system", audit.PASSED}
    assert [r.status for r in audit.gates(rows).collect()] == ["FAIL", "FAIL", "FAIL", "FAIL", "PASS"]
    counts = audit.summary(rows).first()
    assert (counts.facts_audited, counts.entities_audited, counts.relations_audited, counts.high_findings, counts["pass"]) == (13, 7, 6, 7, 4)
    empty = audit.audit(entities.limit(0), edges.limit(0), spark.createDataFrame([], FILE))
    assert empty.count() == 0
    assert {r.status for r in audit.gates(empty).collect()} == {"PASS"}


def judged(evidence, repos, files):
    """Evidence taken citation by citation and file by file."""
    if not evidence:
        return "missing", "no cited evidence"
    there = {"/".join(p.split("/")[:k]) for p in files for k in range(1, len(p.split("/")) + 1)}
    even = lambda s: re.sub(r"\s+", " ", s or "").strip()
    tops = {p.split("/")[0] for p in files if "/" in p}
    held = checked = lost = 0
    for path, _, snippet in evidence:
        bases = [b for b in (r.rstrip("/").split("/")[-1] for r in repos) if b in tops] or tops
        found = [p for p in [*(f"{b}/{path}" for b in bases), path] if path and p in there] or [p for p in there if path and (p == path or p.endswith("/" + path))]
        lost += not found
        checked += bool(found)
        held += bool(even(snippet)) and any(even(snippet) in even(files.get(p)) for p in found)
    n = len(evidence)
    if held == n:
        return "matched", f"{n}/{n} citation(s) matched"
    if held:
        return "partial", f"{held}/{n} citation(s) matched; {lost} missing path(s)"
    return ("unmatched", f"0/{n} citation(s) matched") if checked else ("missing_paths", f"0/{n} citation path(s) found")


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_equals_a_search_file_by_file(spark, seed):
    """A third of the facts cite one path of one repository; paths are those of own, other and no repository, endings, folders and nothing."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma ray", "delta  x", "x\ty"]
    files = {f"r{k}/{d}{n}": "\n ".join(rng.choices(words, k=3)) for k in range(5) for d in ("", "src/", "deep/er/") for n in ("a.py", "b.py") if rng.random() < 0.8}
    files |= {"top.txt": "alpha", "r0/src/a.py": "alpha beta " + "filler " * 50_000 + "last words"}
    paths = ["a.py", "src/a.py", "er/b.py", "r1/a.py", "top.txt", "src", "gone.py", "", None, "b.py"]
    snippets = [*words, "alpha beta", "last words", "nowhere", "", None, " \n"]
    facts = []
    for k in range(240):
        repos = ["acme/r0/"] if k % 3 == 0 else rng.choice([["acme/r1"], ["r2", "acme/r3"], ["acme/none"], [], None])
        evidence = cite(("src/a.py", rng.choice(snippets))) if k % 3 == 0 else cite(*((rng.choice(paths), rng.choice(snippets)) for _ in range(rng.randint(0, 3))))
        facts.append((k, repos, evidence or rng.choice([[], None])))
    frame = spark.createDataFrame(facts, f"id int, source_repos array<string>, evidence {EVIDENCE}")
    sources = spark.createDataFrame([(p, t, "en") for p, t in files.items()] + [("", "alpha", ""), (None, "alpha", None), ("r4/null.py", None, None)], FILE)
    files["r4/null.py"] = ""
    got = {r.id: (r.status, r.detail) for r in audit.evidence_status(frame, audit.evidence_counts(frame, sources)).collect()}
    assert got == {k: judged(e, [r for r in repos or []], files) for k, repos, e in facts}
    assert {s for s, _ in got.values()} == {"matched", "partial", "unmatched", "missing_paths", "missing"}


def test_relations_are_dealt_out_by_their_evidence_alone(spark):
    """What is told of their ends comes to them; their evidence itself, and those without any, stay where they are."""
    entities = spark.createDataFrame([("Component", f"c{k}", False, ["r"], None, k) for k in range(20)] + [("Resource", "c3", None, ["r"], None, 21)], ENTITY)
    edges = spark.createDataFrame([(f"Component:c{k % 25}", "readsResource", ("Component:c3", "Resource:c3", "Resource:gone")[k % 3], None, ["r"], cite(("a.py", "x")) if k % 2 else [], k) for k in range(200)], RELATION)
    counts = audit.evidence_counts(edges, spark.createDataFrame([("r/a.py", "x", "en")], FILE))
    found = audit.audit_relations(edges, entities, counts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange hashpartitioning(evidence_key") == 2
    fixes = found.groupBy("recommended_fix").count().collect()
    of = lambda *remainders: sum(k % 25 < 20 and (k % 3, k % 2) in remainders for k in range(200))
    assert {r[0]: r[1] for r in fixes if "endpoint" not in r[0]} == {
        "target-kind-mismatch: readsResource target is Component, expected Resource": of((0, 0), (0, 1)), audit.PASSED: of((1, 1)), "missing-evidence: no cited evidence": of((1, 0)),
    }


@pytest.mark.parametrize("limit", [0, 4])
def test_many_ends_with_something_to_tell(spark, monkeypatch, limit):
    """Ends looked up in parts give what they give when all of them are broadcast; a third of the relations share one of them, and entities of other kinds ask for no name."""
    rng = random.Random(limit)
    names = [f"n{k}" for k in range(12)]
    entities = [(rng.choice(["Component", "Resource", "Provider", "API", "System"]), rng.choice([*names, None, ""]), rng.choice([True, False, None]), rng.choice([["r"], [], None]), cite(("a.py", "x")) if rng.random() < 0.5 else None, k) for k in range(60)]
    ends = [f"{kind}:{n}" for kind in ("Component", "Resource", "System", "") for n in names] + ["bare", None]
    edges = [(rng.choice(ends), rng.choice(["readsResource", "partOf", "consumesApi"]), "Component:n1" if k % 3 == 0 else rng.choice(ends), rng.choice([None, "Resource"]), rng.choice([["r"], []]), cite(("gone", "x")) if k % 2 else None, k) for k in range(300)]
    frames = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(edges, RELATION), spark.createDataFrame([("r/a.py", "x", "en")], FILE)
    rows = lambda: sorted(map(tuple, audit.audit(*frames).collect()))
    want = rows()
    monkeypatch.setattr(audit, "BROADCAST_ROWS", limit)
    assert rows() == want
    assert {r[7].split(":")[0] for r in want} >= {"wrong-kind-duplicate", "missing-endpoint", "wrong-kind-target"}
