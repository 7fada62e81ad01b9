"""Readers of fact documents, logs and repository files, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources, HTTP methods of an API description, marks of dependency lines by manifest.
SKIPPED = (
    ".git", "node_modules", "target", "build", "dist", "out", "vendor", ".venv", "venv", "__pycache__", "test", "tests", "__tests__", "spec", "specs", "e2e",
    "example", "examples", "sample", "samples",
)
METHODS = ("get", "put", "post", "delete", "patch", "head", "options")
MANIFESTS = {
    "requirements.txt": r"^\s*([A-Za-z0-9_.-]+)\s*(?:[=<>~!\[].*)?$",
    "go.mod": r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v\S+",
    "Gemfile": r"""^\s*gem\s+["']([^"']+)["']""",
    "Cargo.toml": r"^([A-Za-z0-9_-]+)\s*=\s*(?:\"|\{)",
    "pom.xml": r"<artifactId>\s*([^<\s]+)\s*</artifactId>",
}


def fact_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON documents of a folder, one each, that have components; unreadable ones are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.where(F.col("_corrupt_record").isNull() & F.col("components").isNotNull() & ~F.col("file").startswith(".")).drop("_corrupt_record")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines log; blank and invalid lines are left out.  Text before the first brace is ignored."""
    lines = spark.read.text(path).select(F.from_json(F.regexp_extract("value", r"(\{.*)", 1), schema).alias("r")).where("r is not null")
    return lines.select("r.*").where(" or ".join(f"`{c}` is not null" for c in spark.createDataFrame([], schema).columns))


def json_lines_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def last(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def repository_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the files below a folder, without those in folders that hold no sources."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/").rpartition("://")[2].removeprefix("file:")
    below = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    kept = rows.where(~F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, SKIPPED))))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"))


def numbered_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def named(files: DataFrame, name: str) -> DataFrame:
    return files.where((F.col("path") == name) | F.col("path").endswith(f"/{name}"))


def dockerfile_facts(files: DataFrame) -> DataFrame:
    """(path, line, directive, value): FROM images without their tag, and EXPOSEd ports."""
    rows = numbered_lines(named(files, "Dockerfile"))
    found = F.regexp_extract("text", r"(?i)^\s*(FROM|EXPOSE)\s+(?:--\S+\s+)?(\S+)", 0)
    rows = rows.where(found != "")
    value = F.regexp_extract("text", r"(?i)^\s*(?:FROM|EXPOSE)\s+(?:--\S+\s+)?(\S+)", 1)
    kind = F.upper(F.regexp_extract("text", r"(?i)^\s*(FROM|EXPOSE)", 1))
    return rows.select("path", "line", kind.alias("directive"), F.regexp_replace(value, r"(?<=[^/]):[^/]*$|/tcp$|/udp$", "").alias("value"))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, line, coordinate) of line-based manifests, and of package.json (line null)."""
    lines = numbered_lines(files)
    name = F.substring_index("path", "/", -1)
    pattern = None
    for file, regex in MANIFESTS.items():
        hit = F.when(name == file, F.regexp_extract("text", regex, 1))
        pattern = hit if pattern is None else F.coalesce(pattern, hit)
    listed = lines.select("path", "line", pattern.alias("coordinate")).where("coordinate <> ''")
    body = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.explode(F.concat(F.coalesce(F.map_keys("j.dependencies"), F.array()), F.coalesce(F.map_keys("j.devDependencies"), F.array())))
    packages = named(files, "package.json").select("path", body.alias("j")).select("path", F.lit(None).cast("int").alias("line"), keys.alias("coordinate"))
    return listed.unionByName(packages)


def code_owners(files: DataFrame) -> DataFrame:
    """(path, owner): the first team that a CODEOWNERS file names outside comments."""
    rows = numbered_lines(named(files, "CODEOWNERS")).withColumn("owner", F.regexp_extract("text", r"@([\w.-]+(?:/[\w.-]+)?)", 1))
    return rows.where("owner <> '' and not ltrim(text) like '#%'").groupBy("path").agg(F.min_by("owner", "line").alias("owner"))


def protobuf_calls(files: DataFrame) -> DataFrame:
    """(path, service, call, request, response) of .proto services."""
    blocks = F.explode(F.regexp_extract_all("text", F.lit(r"service\s+\w+\s*\{[^}]*(?:\{[^}]*\}[^}]*)*\}"), F.lit(0)))
    rows = files.where(F.col("path").endswith(".proto")).select("path", blocks.alias("block"))
    rpc = r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)"
    calls = rows.select("path", F.regexp_extract("block", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("block", F.lit(rpc), F.lit(0))).alias("rpc"))
    part: list[Column] = [F.regexp_extract("rpc", rpc, k).alias(n) for k, n in ((1, "call"), (2, "request"), (3, "response"))]
    return calls.select("path", "service", *part)


def graphql_fields(files: DataFrame) -> DataFrame:
    """(path, root, field) of the Query, Mutation and Subscription types."""
    blocks = F.explode(F.regexp_extract_all("text", F.lit(r"type\s+(?:Query|Mutation|Subscription)\b[^{]*\{[^}]*\}"), F.lit(0)))
    rows = files.where(F.col("path").rlike(r"\.(graphql|gql)$")).select("path", blocks.alias("block"))
    fields = F.explode(F.regexp_extract_all(F.substring_index("block", "{", -1), F.lit(r"(?m)^\s*(\w+)\s*(?:\(|:)"), F.lit(1)))
    return rows.select("path", F.regexp_extract("block", r"type\s+(\w+)", 1).alias("root"), fields.alias("field"))


def openapi_operations(files: DataFrame) -> DataFrame:
    """(path, title, route, method) of JSON API descriptions."""
    shape = "openapi string, swagger string, info struct<title:string>, paths map<string,map<string,string>>"
    rows = files.where(F.col("path").endswith(".json")).select("path", F.from_json("text", shape).alias("j")).where("j.openapi is not null or j.swagger is not null")
    routes = rows.select("path", F.col("j.info.title").alias("title"), F.explode("j.paths").alias("route", "ways"))
    methods = routes.select("path", "title", "route", F.explode(F.map_keys("ways")).alias("method"))
    return methods.where(F.col("method").isin(*METHODS))
