import random

import pytest

from factloom.operators import decisions

ENTITY = "ref string, name string, description string, tagline string, owner string, lifecycle string, category string, external boolean, source_repos array<string>, source_location string, aliases array<string>, tags array<string>, n_evidence long, pos int"
EDGE = "src string, type string, dst string, n_evidence long, confidence string, source string"
LOG = "ord long, entity string, " + ", ".join(f"{c} string" for c in decisions.FIELDS)


def entity(ref, description="", aliases=(), tags=(), external=False, pos=0):
    return (ref, ref.upper(), description, "old", "nobody", "production", None, external, ["r"], None, list(aliases), list(tags), 1, pos)


def said(ord_, ref, action, **more):
    return (ord_, ref, action, *(more.get(c) for c in decisions.FIELDS[1:]))


def frames(spark, entities, edges, log):
    return spark.createDataFrame(entities, ENTITY), spark.createDataFrame(edges, EDGE), spark.createDataFrame(log, LOG)


def test_every_action_and_again(spark):
    names = "abcdefghijklmn"
    entities = [entity(n, external=n == "b", aliases=["x", "y", "x"], tags=["t" + n], description="told" if n == "l" else "", pos=k) for k, n in enumerate(names)]
    edges = [("a", "dependsOn", "k", 2, "high", "code"), ("a", "dependsOn", "m", 3, "low", "code"), ("k", "consumesApi", "m", 1, "high", "code"), ("n", "dependsOn", "a", 1, "high", "code"), ("n", "reads", "a", 1, "high", "code"), ("n", "reads", "b", 1, "high", "code")]
    log = [
        said(1, "a", "set_owner", value="early"), said(2, "a", "mark_external", category="saas"), said(3, "b", "link", repo="org/b"), said(4, "c", "skip"), said(5, "d", "set_tagline", value="  new "),
        said(6, "e", "set_owner", value="team"), said(7, "f", "set_lifecycle", value="deprecated"), said(8, "g", "set_lifecycle", value="retired"), said(9, "h", "add_alias", value="a"), said(10, "i", "remove_alias", value="x"),
        said(11, "j", "add_dependency", target="a", reason="why"), said(12, "k", "merge", into="l"), said(13, "l", "merge", into="m"), said(14, "n", "remove_dependency", target="a"),
        said(15, "nobody", "set_owner", value="x"), said(16, "gone", "merge", into="a"), said(17, "", "skip"), said(18, None, "skip"), said(19, "m", "dance"),
    ]
    random.Random(1).shuffle(log)
    e, r, decided = frames(spark, entities, edges, log)
    got = decisions.decide(e, r, decided)
    outcomes = {x.entity: x.outcome for x in got.outcomes.collect()}
    assert outcomes == {n: "applied" for n in "abcdefhijkln"} | {"g": "invalid", "m": "unknown", "nobody": "missing", "gone": "done"}
    rows = {x.ref: x for x in got.entities.collect()}
    assert set(rows) == set(names) - {"k", "l"}
    assert (rows["a"].external, rows["a"].category, rows["a"].owner) == (True, "saas", "nobody")
    assert (rows["b"].external, rows["b"].source_repos, rows["b"].source_location) == (False, ["org/b"], "url:https://github.com/org/b/")
    assert (rows["d"].tagline, rows["e"].owner, rows["f"].lifecycle, rows["g"].lifecycle) == ("new", "team", "deprecated", "production")
    assert (rows["h"].aliases, rows["i"].aliases, rows["c"].aliases) == (["a", "x", "y"], ["y"], ["x", "y", "x"])
    assert (rows["m"].aliases, rows["m"].tags, rows["m"].n_evidence, rows["m"].description, rows["m"].pos) == (["K", "L", "x", "y"], ["tk", "tl", "tm"], 3, "told", 12)
    relations = {tuple(x) for x in got.relations.collect()}
    assert relations == {("a", "dependsOn", "m", 5, "high", "code"), ("n", "reads", "b", 1, "high", "code"), ("j", "dependsOn", "a", 0, "review", "triage")}
    again = decisions.decide(got.entities, got.relations, decided)
    assert {tuple(map(str, x)) for x in again.entities.collect()} == {tuple(map(str, x)) for x in got.entities.collect()}
    assert {tuple(x) for x in again.relations.collect()} == relations


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_circles_of_merges(spark, seed):
    """Each node is merged into another, many into one: chains end at their last, a circle lets go of its oldest decision."""
    rng = random.Random(seed)
    new = {k: rng.randrange(300) if rng.random() < 0.7 else 7 for k in range(280)}
    new |= {k: k + 1 for k in range(100, 160)} | {200: 201, 201: 202, 202: 200, 7: 8, 8: 299}
    new = {k: v for k, v in new.items() if k != v}
    ord_ = {k: rng.randrange(1000) for k in new}
    void = set()
    for k in new:
        path, at = [], k
        while at in new and at not in path:
            path.append(at)
            at = new[at]
        if at in path:
            void.add(min(path[path.index(at) :], key=lambda x: (ord_[x], f"{x:03}")))
    assert len(void) > 0

    def end(k):
        return end(new[k]) if k in new and k not in void else k

    pairs = spark.createDataFrame([(f"{k:03}", f"{v:03}", ord_[k]) for k, v in new.items()], "old string, new string, ord int")
    assert {(r.old, r.new) for r in decisions.merge_ends(pairs).collect()} == {(f"{k:03}", f"{end(k):03}") for k in new if k not in void}
    assert decisions.merge_ends(pairs.limit(0)).count() == 0


def test_equal_times_do_not_depend_on_the_order_of_rows(spark):
    log = [said(1, "a", "set_owner", value=v) for v in ("x", "z", "y")]
    for rows in (log, log[::-1]):
        assert [r.value for r in decisions.last_decisions(spark.createDataFrame(rows, LOG)).collect()] == ["z"]


def test_twins_are_merged_at_the_highest_confidence(spark):
    e, r, _ = frames(spark, [entity("a"), entity("b"), entity("c")], [("c", "reads", "a", 1, "low", "x"), ("c", "reads", "b", 2, "high", "y"), ("a", "reads", "b", 1, "low", "x")], [])
    entities, relations = decisions.merge_pairs(e, r, spark.createDataFrame([("a", "b")], "old string, new string"))
    assert [tuple(x) for x in relations.collect()] == [("c", "reads", "b", 3, "high", "x")]
    assert {x.ref: x.n_evidence for x in entities.collect()} == {"b": 2, "c": 1}
