import json
import random

from factloom.functions import confidence
from factloom.operators import assemble, search
from pyspark.sql import functions as F


def test_ranks_of_whole_lists_match_a_sort(spark):
    rng = random.Random(3)
    rows = [(f"r{k:04}", float(rng.randrange(40))) for k in range(1500)]
    df = spark.createDataFrame(rows, "ref string, score double").repartition(7)
    want = {ref: k for k, (ref, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.ref: r.rank for r in search.top(df).collect()} == want
    assert {r.ref: r.rank for r in search.top(df, 9).collect()} == {r: k for r, k in want.items() if k < 9}
    assert search.top(df.limit(0)).collect() == []


def test_a_row_deep_in_both_lists_keeps_both_shares(spark):
    ranks = {n: spark.createDataFrame([("a", k)], "ref string, rank long") for n, k in (("vector", 3), ("lexical", 900))}
    assert abs(search.fuse(ranks).first().score - (1 / 64 + 0.6 / 961)) < 1e-12


def test_metadata_boost_and_threshold(spark):
    rows = [
        ("a", "queue", "review", ["Order Queue", None], ["queue: a line"], ["x"]),
        ("b", "nothing", None, None, None, ["Red-Is", None]),
        ("c", "queue", "high", ["z"] * 30 + ["queue"], [], None),
    ]
    docs = spark.createDataFrame(rows, "ref string, haystack string, confidence string, attributes array<string>, glossary array<string>, names array<string>")
    assert {r.ref: r.score for r in search.metadata(docs, ["queue"]).collect()} == {"a": 2.0}
    assert search.metadata(docs, []).count() == 0
    boost = {r.ref: r.b for r in docs.select("ref", search.exact_boost("names", ["redis", "service"]).alias("b")).collect()}
    assert boost == {"a": 0.0, "b": 1.0, "c": 0.0}
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "ref string, embedding array<double>")
    assert [r.ref for r in search.hybrid(docs, vectors, "redis queue", [1.0, 0.0], least="low").collect()] == ["b", "c"]


def _catalog(spark, *documents):
    lines = spark.createDataFrame([(json.dumps(d),) for d in documents], "d string")
    entities, relations = assemble.catalog(lines.select(F.from_json("d", assemble.DOCUMENT).alias("d")).select("d.*"))
    return {r.ref: r for r in entities.collect()}, {(r.src, r.type, r.dst): r for r in relations.collect()}


def test_assembly_of_partial_documents(spark):
    evidence = [{"path": "a", "line": 1}]
    entities, relations = _catalog(
        spark,
        {"repo": {"id": "acme/team/Order-Service"}, "components": [{"name": "zzz", "evidence": evidence}, {"name": ""}], "dependencies": [
            {"target": "payment service", "kind": "consumesApi", "confidence": "high", "evidence": evidence},
            {"target": "https://pay.example.com", "target_kind": "external", "aliases": ["stripe"]},
            {"target": "Ledger DB", "target_kind": "resource", "source": "elsewhere"},
            {"target": ""}]},
        {"repo": {"id": "acme/payment"}, "providers": [{"name": "Stripe"}, {"name": ""}], "resources": [{"name": "database", "host_or_instance": "ledger-db:5432", "access": "read-write"}]},
        {},
    )
    assert set(entities) == {"Component:Order-Service", "Component:payment", "Component:unknown", "Provider:Stripe", "Resource:ledger-db"}
    assert relations[("Component:Order-Service", "consumesApi", "Component:payment")].confidence == "high"
    assert relations[("Component:Order-Service", "dependsOn", "Provider:Stripe")].confidence == "review"
    assert relations[("Component:Order-Service", "dependsOn", "Resource:ledger-db")].confidence == "medium"
    assert relations[("Component:payment", "readsResource", "Resource:ledger-db")].n_evidence == 0
    assert entities["Component:Order-Service"].confidence == "high" and not entities["Component:payment"].external


def test_labels_of_one_key_share_a_placeholder(spark):
    wants = lambda repo, target: {"repo": {"id": repo}, "dependencies": [{"target": target, "confidence": "high"}]}
    entities, relations = _catalog(spark, wants("o/b", "Fraud Check"), wants("o/a", "fraud-check"))
    assert [r for r, e in entities.items() if e.external] == ["Component:fraud-check"]
    assert {k[0] for k in relations} == {"Component:a", "Component:b"} and {r.confidence for r in relations.values()} == {"medium"}
    assert entities["Component:fraud-check"].aliases == ["Fraud Check", "fraud-check"]


def test_empty_corpus(spark):
    entities, relations = assemble.catalog(spark.createDataFrame([], assemble.DOCUMENT))
    assert entities.count() == 0 and relations.count() == 0 and confidence.QUERY_RANK
