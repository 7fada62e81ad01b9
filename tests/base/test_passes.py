from factloom.operators import passes, reports
from pyspark.sql import functions as F

ENTITY = "ref string, name string, aliases array<string>, external boolean, source_repos array<string>, pos long"


def test_endings_meet_the_earliest_sourced_component(spark):
    rows = [
        ("c:catalogue", "Catalogue", [], False, ["r"], 2),
        ("c:logue", "x-catalogue-api", None, False, ["r"], 1),
        ("c:demo", "demo-catalogue", None, True, None, 3),
        ("c:alias", "zeta", ["Catalogue Service"], True, [], 4),
        ("c:own", "catalogue-service", [], True, [], 5),
        ("c:lone", "other", None, True, None, 6),
        ("c:inner", "demo-catalogue", None, False, None, 7),
    ]
    got = {r.old: r.new for r in passes.suffix_twins(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got == {"c:demo": "c:catalogue", "c:alias": "c:catalogue"}


def test_passes_on_empty_tables(spark):
    edges = spark.createDataFrame([], "src string, type string, dst string, n_evidence long, confidence string")
    entities = spark.createDataFrame([], ENTITY)
    assert passes.provider_twins(entities, entities).count() == passes.suffix_twins(entities).count() == 0
    assert passes.fold_providers(edges, spark.createDataFrame([], "old string, new string")).count() == 0
    assert reports.predicted_edges(edges, ["a"])[0].count() == 0 and reports.predicted_edges(edges, [])[1].count() == 0


def test_corrections_refer_to_indices_before_them(spark):
    facts = spark.createDataFrame([(1, "apis", k, f"f{k}") for k in range(4)], "doc int, category string, index int, fact string")
    asked = [(1, "apis", 1, "drop", None, 1), (1, "apis", 1, "drop", None, 2), (1, "apis", 2, "fix", "new", 3), (1, "apis", 3, "fix", None, 4), (1, "apis", 9, "drop", None, 5), (2, "apis", 0, "drop", None, 6), (1, "apis", 0, "keep", "no", 7)]
    out = passes.correct(facts, spark.createDataFrame(asked, "doc int, category string, index int, action string, fact string, ord int"))
    assert sorted((r["index"], r["fact"]) for r in out.collect()) == [(0, "f0"), (1, "new"), (2, "f3")]


def test_keys_names_and_means(spark):
    one = spark.createDataFrame([("OMS", ["cart", "https://pay-gw.example.com/x", "my.config.key"])], "n string, a array<string>")
    assert one.select(passes.alias_keys(F.col("n"), F.col("a"))).first()[0] == ["httpspaygwexamplecomx", "myconfigkey", "oms", "paygw"]
    out = reports.category_means(spark.createDataFrame([("a", True, 1.0, None), (None, None, None, None)], "category string, passed boolean, x double, y double"), "x", "y")
    got = {r.category: (r.pass_rate, r.x, str(r.y)) for r in out.collect()}
    assert got["a"] == (1.0, 1.0, "nan") and got["uncategorised"][0] == 0.0
