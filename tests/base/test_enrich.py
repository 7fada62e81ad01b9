import random
import re

from factloom.functions.text import API_STOP
from factloom.operators import enrich

OPS, PLACES = "array<struct<method:string,path:string,name:string>>", "array<struct<path:string,line:int,snippet:string>>"
APIS = f"repo string, pos long, name string, operations {OPS}, evidence {PLACES}, emitted_by array<string>, rule string"
SPECS = f"repo string, ord long, name string, rule string, operations {OPS}, evidence {PLACES}, lang string"


def key(name):
    return "".join(t for t in re.split(r"[^a-z0-9]+", (name or "").lower()) if t and t not in API_STOP)


def test_ambiguous_and_unknown_names_are_left_alone(spark):
    own = [("GET", "/a", "list")]
    apis = [("r", 1, "Orders API", own, None, None, "x"), ("r", 2, "Payments service", None, None, None, "x"), ("r", 3, "payments-REST", None, None, None, "x"), ("s", 1, "Payments", None, None, None, None), ("s", 2, None, [], [], [], None)]
    specs = [
        ("r", 1, "openapi: Orders", "openapi", [("GET", "/a", "other"), ("POST", "", "make"), ("POST", None, "make"), None], [("o.yaml", 1, "paths"), ("o.yaml", 1, "paths")], "en"), ("r", 2, "Payments contract", "openapi", own, None, "en"),
        ("r", 3, "Refunds", "openapi", own, None, "en"), ("r", 4, "orders", "openapi", [("POST", "", "make")], None, "en"), ("s", 1, "payments api", "graphql", None, None, "en"), ("s", 2, "REST API", "proto", own, None, "en"),
    ]
    apis, specs = spark.createDataFrame(apis, APIS), spark.createDataFrame(specs, SPECS)
    got = {(r.repo, r.pos): r for r in enrich.enriched(apis, specs).collect()}
    assert [tuple(o) for o in got["r", 1].operations] == [("GET", "/a", "list"), ("POST", "", "make")]
    assert [tuple(e) for e in got["r", 1].evidence] == [("o.yaml", 1, "paths")] and got["r", 1].emitted_by == ["openapi"]
    assert all(got["r", k].operations is None and got["r", k].emitted_by is None for k in (2, 3))
    assert got["s", 1].emitted_by == ["graphql"] and got["s", 1].operations is None
    assert [tuple(o) for o in got["s", 2].operations] == [("GET", "/a", "list")]
    assert enrich.enriched(apis, specs).columns == apis.columns
    assert {tuple(r) for r in enrich.enrichment(apis, specs).collect()} == {("r", 4, 1, 1), ("s", 2, 1, 1)}
    assert enrich.enriched(apis.limit(0), specs).count() == 0 and enrich.enriched(apis, specs.limit(0)).count() == 5


def test_equals_specifications_merged_one_by_one(spark):
    """A third of the specifications are of one API."""
    rng = random.Random(5)
    names = [f"{a} {b}" for a in ("Orders", "pay", "Stock-Level") for b in ("API", "service v1", "rest", "")]
    apis = [(f"r{k % 4}", k, rng.choice(names), [("GET", f"/{rng.randrange(5)}", None)] * rng.randint(0, 2), [("f", rng.randrange(4), "s")], rng.choice([None, ["a"]]), None) for k in range(24)] + [("hot", 99, "Hot API", None, None, None, None)]
    specs = [("hot" if k % 3 == 0 else f"r{k % 4}", k, "hot contract" if k % 3 == 0 else rng.choice(names), rng.choice("abc"), [("GET", f"/{rng.randrange(40)}", None) for _ in range(rng.randint(0, 3))], [("f", rng.randrange(9), "s")], None) for k in range(300)]
    want = {(r, p): [list(o), list(e), list(m or [])] for r, p, _, o, e, m, _ in [(a, b, c, d or [], e or [], f, g) for a, b, c, d, e, f, g in apis]}
    place = lambda o: (o[0] or "", o[1] or o[2] or "")
    for repo, _, name, rule, operations, evidence, _ in specs:
        same = [(r, p) for r, p, n, *_ in apis if r == repo and key(n) == key(name)]
        if len(same) == 1:
            held = want[same[0]]
            for o in operations:
                held[0] += [o] if place(o) not in set(map(place, held[0])) else []
            held[1] += [e for e in evidence if e not in held[1]]
            held[2] += [rule] if rule not in held[2] else []
    rng.shuffle(specs)
    got = enrich.enriched(spark.createDataFrame(apis, APIS), spark.createDataFrame(specs, SPECS)).collect()
    assert {(r.repo, r.pos): [[tuple(o) for o in r.operations or []], [tuple(e) for e in r.evidence or []], list(r.emitted_by or [])] for r in got} == want
    assert len(want["hot", 99][0]) > 20
