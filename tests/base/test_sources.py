from factloom.sources import files, sinks
from pyspark.sql import functions as F


def test_repository_scans(spark):
    rows = [
        ("a/Dockerfile", "FROM --platform=x python:3.12\nRUN ls\nEXPOSE 8080/tcp"),
        ("a/requirements.txt", "requests==2.0\n# note\nkafka-python>=2"),
        ("a/package.json", '{"dependencies": {"express": "1"}, "devDependencies": {"jest": "2"}}'),
        ("a/x.proto", "service Orders { rpc Get(Ask) returns (stream Reply); rpc Put (A.B) returns (C) {} }"),
        ("a/s.graphql", "type Query {\n  user(id: ID): User\n  all: [User]\n}"),
        ("a/api.json", '{"openapi": "3", "info": {"title": "T"}, "paths": {"/x": {"get": {}, "post": {}, "parameters": []}}}'),
        ("a/CODEOWNERS", "# @no/one\n* @org/team-a @org/b"),
        ("a/empty.json", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert got(files.dockerfile_facts(df)) == [("a/Dockerfile", 1, "FROM", "python"), ("a/Dockerfile", 3, "EXPOSE", "8080")]
    assert {r.coordinate for r in files.dependencies(df).collect()} == {"requests", "kafka-python", "express", "jest"}
    assert {(r.service, r.call, r.request, r.response) for r in files.protobuf_calls(df).collect()} == {("Orders", "Get", "Ask", "Reply"), ("Orders", "Put", "A.B", "C")}
    assert {r.field for r in files.graphql_fields(df).collect()} == {"user", "all"}
    assert {(r.route, r.method) for r in files.openapi_operations(df).collect()} == {("/x", "get"), ("/x", "post")}
    assert got(files.code_owners(df)) == [("a/CODEOWNERS", "org/team-a")]


def test_logs_and_documents(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"event": "x", "cost": 1.5}\n\nnot json\nnoise {"event": "y"}\n')
    assert sorted(r.event for r in files.json_lines(spark, f"{tmp_path}/log", "event string, cost double").collect()) == ["x", "y"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text('{"components": [{"name": "c"}]}')
    (tmp_path / "docs/b.json").write_text('{"other": 1}')
    (tmp_path / "docs/c.json").write_text("{broken")
    assert files.fact_documents(spark, f"{tmp_path}/docs", "components array<struct<name:string>>").count() == 1
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.txt").write_text("é")
    (tmp_path / "src/node_modules/b.txt").write_text("no")
    assert [r.text for r in files.repository_files(spark, f"{tmp_path}/src").collect()] == ["é"]


def test_sinks(spark, tmp_path):
    entities = spark.createDataFrame([("c:1", "Component", "one", "s"), ("r:1", "Resource", "two", "s")], "ref string, kind string, name string, owner string")
    relations = spark.createDataFrame([("c:1", "readsResource", "r:1"), ("c:1", "readsResource", "r:9")], "src string, type string, dst string")
    sinks.write_graph(entities, relations, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/relations").count() == 1
    assert '"inputs":[{"namespace":"catalog","name":"r:1"}' in sinks.lineage_events(relations, "2024-01-01").first().event
    many = spark.range(150).selectExpr("'c:1' as src", "'dependsOn' as type", "concat('r:', id) as dst")
    page = sinks.system_pages(entities, relations.unionByName(many)).orderBy("system", "component", "at").collect()
    assert [r.line for r in page[:2]] == ["- one", "  - dependsOn r:0"] and len(page) == 153
    sinks.append_log(entities, f"{tmp_path}/l")
    sinks.append_log(entities, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/l").count() == 4
    sinks.quarantine(entities, F.col("kind") == "Component", f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert (spark.read.parquet(f"{tmp_path}/ok").count(), spark.read.parquet(f"{tmp_path}/bad").count()) == (1, 1)
