"""Audit of a catalog against its own rules and a workspace of source files.

Cited evidence is looked for in whole files: under the fact's own repositories, or under every
repository where none of its own is there; as a path from the root; and, where nothing of these
exists, at any place whose path ends so.  All four are equi-joins, the wide ones on an index of
path endings.  Equal questions are asked once, and texts meet only the files that a question found.

Relations are many and hold much: they are written once, and are dealt out by their evidence alone,
without it.  Of their ends only what is to be told of one, that it is missing or has another kind's
name, is worked out of the different ends and looked up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.graph import kept

# Kinds that are audited, relations by what they need, what a finding weighs, what a fact should be.
CORE = ("Component", "API", "Resource", "Provider")
RESOURCE_RELATIONS = ("readsResource", "writesResource", "producesMessage", "consumesMessage")
CODE_RELATIONS = (*RESOURCE_RELATIONS, "dependsOn", "consumesApi")
STRUCTURAL = ("partOf", "providesApi", "communicatesWith")
EXPECTED = {
    "entity": "typed entity with provenance and matching source evidence",
    "relation": "existing endpoints, correct direction, correct target kind, matching evidence",
}
PASSED = "source-backed structural checks passed"
#: Any white space, the same in Spark and in SQL engines with other ideas of it.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Names and references with something to tell that are broadcast, and the parts of one that many facts ask for where there are more.
BROADCAST_ROWS, SALTS = 100_000, 16
COLUMNS = ("scope", "fact", "expected", "actual", "verdict", "severity", "source_evidence", "recommended_fix")


def even(value: Column | str) -> Column:
    """A text with each run of white space as one blank, none at its ends; null gives ''."""
    return F.trim(F.regexp_replace(text._col(value), WHITE, " "))


def _plain(path: Column | str) -> Column:
    """A path without doubled slashes, steps on the spot and a last slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text._col(path), "/+", "/"), r"(^|/)(?:\./)+", "$1"), "(?<=.)/$", "")


def places(files: DataFrame) -> DataFrame:
    """(file): every file of (path, text) and every folder above one."""
    parts = F.split(_plain("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.select(F.explode(above).alias("file")).where("file <> ''").distinct()


def endings(found: DataFrame) -> DataFrame:
    """(path, depth, file): each ending of a place's path at a slash, and how many folders stand before it."""
    parts = F.split("file", "/")
    rows = found.select("file", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("depth", "path"))
    return rows.select("path", "depth", "file")


def _held(asks: DataFrame, files: DataFrame) -> DataFrame:
    """Questions (file, wanted) whose file holds the wanted text; nothing is in none."""
    texts = files.select(_plain("path").alias("file"), even("text").alias("whole"))
    rows = asks.where("wanted <> ''").select("file", "wanted").distinct().join(texts, "file")
    return rows.where(F.contains("whole", "wanted")).select("file", "wanted").distinct().withColumn("held", F.lit(True))


def _answered(asks: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, there, held): whether a question has a file at all, and one that holds what is wanted."""
    rows = asks.join(_held(asks, files), ["file", "wanted"], "left")
    return rows.groupBy(*keys).agg(F.lit(True).alias("there"), F.bool_or(F.coalesce("held", F.lit(False))).alias("held"))


def cited(citations: DataFrame, files: DataFrame) -> DataFrame:
    """`citations` (key, k, path, snippet, source_repos) as (key, k, there, held).

    `there`: a file of that path exists; `held`: one of those files holds the snippet, white space apart.  A folder is there and holds nothing.
    A path or snippet that is null or empty has no file, or is in none.  Under other repositories, and by endings, a path that very many
    repositories have is read in each of them, once for each snippet."""
    known = kept(places(files))
    folders = known.where(F.contains("file", F.lit("/"))).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("base")).distinct()
    rows = citations.select("key", "k", _plain("path").alias("path"), even("snippet").alias("wanted"), F.coalesce("source_repos", F.array().cast("array<string>")).alias("repos"))
    # bases of a set of repositories are looked up once for all facts that share it
    named = rows.select("repos").distinct().select("repos", F.explode("repos").alias("repo")).select("repos", F.element_at(F.split(F.rtrim("repo", F.lit("/")), "/"), -1).alias("base"))
    bases = named.join(folders, "base").groupBy("repos").agg(F.collect_set("base").alias("bases"))
    rows = kept(rows.where("path <> ''").join(bases, "repos", "left").drop("repos"))
    # exact places: under own repositories, and from the root
    own = rows.select("key", "k", "wanted", F.explode(F.transform("bases", lambda b: F.concat(b, F.lit("/"), "path"))).alias("file"))
    exact = own.unionByName(rows.select("key", "k", "wanted", F.col("path").alias("file")))
    asked = exact.select("file", "wanted").distinct().join(known, "file")
    exact = exact.join(_answered(asked, files, ["file", "wanted"]), ["file", "wanted"]).groupBy("key", "k").agg(F.bool_or("held").alias("held"))
    # any repository, where the fact's own are unknown
    index = endings(known)
    wide = lambda asks, places: _answered(asks.select("path", "wanted").distinct().join(places, "path").select("path", "wanted", "file"), files, ["path", "wanted"])
    lost = rows.where("bases is null")
    anywhere = lost.join(wide(lost, index.where("depth = 1")), ["path", "wanted"]).select("key", "k", "held")
    first = kept(exact.unionByName(anywhere).groupBy("key", "k").agg(F.bool_or("held").alias("held")))
    # any place that ends so, where there is nothing yet
    rest = rows.join(first, ["key", "k"], "left_anti")
    deep = rest.join(wide(rest, index), ["path", "wanted"]).select("key", "k", "held")
    return first.unionByName(deep).withColumn("there", F.lit(True)).select("key", "k", "there", "held")


def _evidence_key(repos: str = "source_repos", evidence: str = "evidence") -> Column:
    """16 bytes that stand for repositories and evidence, as they go wherever a fact goes; null without evidence."""
    told = F.to_json(F.struct(F.coalesce(repos, F.array().cast("array<string>")).alias("r"), F.col(evidence).alias("e")))
    return F.when(F.size(evidence) > 0, F.unhex(F.md5(told)))


def _keyed(facts: DataFrame) -> DataFrame:
    """`facts` with evidence_key, and n, how many citations there are."""
    return facts.withColumns({"evidence_key": _evidence_key(), "n": F.greatest(F.coalesce(F.size("evidence"), F.lit(0)), F.lit(0))})


def evidence_counts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(evidence_key, there, held): for each set of repositories and evidence of `facts`, taken once, its citations with a file and those that a file holds."""
    return _counts(_keyed(facts), files)


def _counts(keyed: DataFrame, files: DataFrame) -> DataFrame:
    # a key is made of the other columns, which a hash of all takes without a sort
    sets = keyed.where("evidence_key is not null").select(F.col("evidence_key").alias("key"), "source_repos", "evidence").distinct()
    asked = sets.select("key", "source_repos", F.posexplode("evidence").alias("k", "c"))
    found = cited(asked.select("key", "k", F.col("c.path").alias("path"), F.col("c.snippet").alias("snippet"), "source_repos"), files)
    return kept(found.groupBy(F.col("key").alias("evidence_key")).agg(F.count("*").alias("there"), F.count_if("held").alias("held")))


def evidence_status(facts: DataFrame, counts: DataFrame | None) -> DataFrame:
    """`facts` (source_repos, evidence array<struct<path, snippet, ...>>, ...) with status and detail, from `evidence_counts` of them.

    matched, partial, unmatched (files are there, none holds a snippet), missing_paths, missing (nothing cited), or not_checked without counts."""
    return _with_status(_answers(_keyed(facts), counts), counts is not None)


def _answers(keyed: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Facts with there and held in place of evidence_key; those without evidence meet nothing, and all of them would do so in one task."""
    none = keyed.drop("evidence_key").withColumns({"there": F.lit(0).cast("long"), "held": F.lit(0).cast("long")})
    if counts is None:
        return none
    met = keyed.where("evidence_key is not null").join(counts.hint("shuffle_hash"), "evidence_key", "left").drop("evidence_key").fillna(0, ["there", "held"])
    return met.unionByName(none.where("n = 0"))


def _with_status(rows: DataFrame, checked: bool) -> DataFrame:
    """Facts with status and detail in place of n, there and held."""
    none = F.col("n") == 0
    if not checked:
        detail = F.when(none, "no cited evidence").otherwise(F.concat("n", F.lit(" citation(s), workspace not provided")))
        return rows.withColumns({"status": F.when(none, "missing").otherwise("not_checked"), "detail": detail}).drop("n", "there", "held")
    shown = lambda what: F.concat("held", F.lit("/"), "n", F.lit(f" citation{what}"))
    status = F.when(none, "missing").when(F.col("held") == F.col("n"), "matched").when(F.col("held") > 0, "partial").when(F.col("there") > 0, "unmatched").otherwise("missing_paths")
    detail = (
        F.when(none, "no cited evidence").when((status == "matched") | (status == "unmatched"), shown("(s) matched"))
        .when(status == "partial", F.concat(shown("(s) matched; "), F.col("n") - F.col("there"), F.lit(" missing path(s)"))).otherwise(shown(" path(s) found"))
    )
    return rows.withColumns({"status": status, "detail": detail}).drop("n", "there", "held")


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A left join of `rows` with `table`, unique by `key`: a small table goes to every task.

    Of a larger one each key stands in every part and a row asks in one, as very many rows may ask for one key; rows without a key go past it."""
    table = kept(table)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    every = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asking = rows.where(F.col(key).isNotNull()).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    met = asking.join(every.hint("shuffle_hash"), [key, "_part"], "left").drop("_part")
    return met.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def _finding(when: Column, severity: Column | str, code: str, message: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.when(when, F.struct(lit(severity).alias("severity"), F.concat(F.lit(f"{code}: "), lit(message)).alias("message")))


def _evidence_findings(excused: Column) -> list[Column]:
    bad = F.col("status").isin("unmatched", "missing_paths")
    return [
        _finding(bad, "high", "bad-evidence", F.col("detail")), _finding(F.col("status") == "partial", "medium", "partial-evidence", F.col("detail")),
        _finding((F.col("status") == "missing") & ~excused, "medium", "missing-evidence", F.col("detail")),
    ]


def _judged(rows: DataFrame, scope: str, findings: list[Column], actual: Column) -> DataFrame:
    """The worst finding of each fact, the first of equal ones."""
    first = lambda severity: F.get(F.filter("findings", lambda f: f["severity"] == severity), F.lit(0))
    worst = F.coalesce(*map(first, ("high", "medium", "low")))
    rows = rows.withColumn("findings", F.array_compact(F.array(*findings))).withColumn("worst", worst)
    severity = F.coalesce("worst.severity", F.lit("-"))
    verdict = F.when(F.col("worst").isNull(), "PASS").when(severity == "high", "FAIL").otherwise("REVIEW")
    return rows.select(
        F.lit(scope).alias("scope"), "fact", F.lit(EXPECTED[scope]).alias("expected"), actual.alias("actual"), verdict.alias("verdict"), severity.alias("severity"),
        F.col("detail").alias("source_evidence"), F.coalesce("worst.message", F.lit(PASSED)).alias("recommended_fix"),
    )


def _names(entities: DataFrame) -> DataFrame:
    """(key, as_provider, as_resource): names that are a resource's or a provider's."""
    rows = entities.where(F.col("kind").isin("Resource", "Provider") & (text._col("name") != "")).select(text.canonical_key("name").alias("key"), "kind")
    return rows.groupBy("key").agg(F.bool_or(F.col("kind") == "Provider").alias("as_provider"), F.bool_or(F.col("kind") == "Resource").alias("as_resource"))


def _colliding() -> Column:
    """Names of the kinds that a name also has; null without one."""
    kinds = F.array_join(F.array_compact(F.array(F.when(F.col("as_provider"), "Provider"), F.when(F.col("as_resource"), "Resource"))), ", ")
    return F.nullif(kinds, F.lit(""))


def _repos(value: str = "source_repos") -> Column:
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda r: F.coalesce(r, F.lit("")) != "")


def _entities(entities: DataFrame) -> DataFrame:
    return _keyed(entities.where(F.col("kind").isin(*CORE)).select("kind", "name", "external", _repos().alias("source_repos"), "evidence"))


def _relations(relations: DataFrame) -> DataFrame:
    blank = [text._col(c).alias(c) for c in ("src", "type", "dst")]
    return _keyed(relations.select(*blank, F.lower(text._col("target_kind")).alias("told"), F.array_sort(F.array_distinct(_repos())).alias("source_repos"), "evidence"))


def _target() -> dict[str, Column]:
    """Kind and name of a relation's target; kinds are compared as written, what has no colon has none and is a name as a whole."""
    return {"kind": F.when(F.contains("dst", F.lit(":")), F.split_part("dst", F.lit(":"), F.lit(1))).otherwise(""), "key": text.canonical_key(F.regexp_replace("dst", "^[^:]*:", ""))}


def _told_of_ends(rows: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, no_src) of sources that no entity has, and (dst, no_dst, clash) of targets that no entity has, or that are components named like a resource or provider."""
    refs = entities.select(F.concat(text._col("kind"), F.lit(":"), text._col("name")).alias("ref")).distinct()
    unknown = lambda end: rows.select(end).distinct().join(refs.withColumnRenamed("ref", end), end, "left_anti").withColumn(f"no_{end}", F.lit(True))
    components = rows.select("dst").distinct().withColumns(_target()).where("kind = 'Component'")
    clashes = components.join(_names(entities), "key").select("dst", F.lit(None).cast("boolean").alias("no_dst"), _colliding().alias("clash"))
    every = unknown("dst").withColumn("clash", F.lit(None).cast("string")).unionByName(clashes)
    return unknown("src"), every.groupBy("dst").agg(F.bool_or("no_dst").alias("no_dst"), F.max("clash").alias("clash"))


def audit_entities(entities: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row for each entity (kind, name, external, source_repos, evidence) of the kinds in CORE, repeated ones too, as COLUMNS.

    A component named like a resource or provider, resources and APIs without a repository, and evidence that isn't found, are high; providers without
    a repository, evidence found in part, or none of an entity that isn't external, are medium."""
    return _judged_entities(_entities(entities), entities, counts)


def _judged_entities(rows: DataFrame, entities: DataFrame, counts: DataFrame | None) -> DataFrame:
    rows = rows.drop("evidence").withColumn("key", F.when(F.col("kind") == "Component", text.canonical_key("name")))
    asked = rows.select("key").where("key is not null").distinct()
    clashes = _names(entities).join(asked, "key", "left_semi").select("key", _colliding().alias("clash"))
    rows = _answers(looked_up(rows, clashes, "key"), counts).withColumn("cited", F.col("n"))
    rows = _with_status(rows, counts is not None)
    kind, unknown = F.col("kind"), F.size("source_repos") == 0
    findings = [
        _finding((kind == "Component") & F.col("clash").isNotNull(), "high", "wrong-kind-duplicate", F.concat(F.lit("component name also emitted as "), "clash")),
        _finding(kind.isin("API", "Resource") & unknown, "high", "missing-provenance", F.concat(kind, F.lit(" has no source_repos annotation"))),
        _finding((kind == "Provider") & unknown, "medium", "missing-provenance", "provider has no source_repos annotation"),
        *_evidence_findings(F.coalesce("external", F.lit(False))),
    ]
    listed = F.when(unknown, "-").otherwise(F.concat(F.lit("['"), F.array_join("source_repos", "', '"), F.lit("']")))
    actual = F.concat(kind, F.lit("; source_repos="), listed, F.lit("; evidence="), "cited")
    return _judged(rows.withColumn("fact", F.concat(kind, F.lit(":"), text._col("name"))), "entity", findings, actual)


def audit_relations(relations: DataFrame, entities: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row for each relation (src, type, dst, target_kind, source_repos, evidence), repeated ones too, as COLUMNS.

    Ends that no entity has, targets of another kind than the type or the property says, components named like a resource or provider, and evidence that
    isn't found, are high; relations of code without a repository, evidence found in part, or none where the type isn't structural, are medium."""
    return _judged_relations(_relations(relations), entities, counts)


def _judged_relations(rows: DataFrame, entities: DataFrame, counts: DataFrame | None) -> DataFrame:
    sources, targets = _told_of_ends(rows, entities)
    narrow = rows.select("src", "type", "dst", "told", F.get("source_repos", F.lit(0)).alias("repo"), "n", "evidence_key")
    rows = looked_up(looked_up(_answers(narrow, counts), sources, "src"), targets, "dst")
    rows = _with_status(rows.withColumns({"cited": F.col("n"), "kind": _target()["kind"]}), counts is not None)
    kind, of = F.col("kind"), F.col("type")
    findings = [
        _finding(F.col("no_src").isNotNull(), "high", "missing-endpoint", F.concat(F.lit("source endpoint does not exist: "), "src")),
        _finding(F.col("no_dst").isNotNull(), "high", "missing-endpoint", F.concat(F.lit("target endpoint does not exist: "), "dst")),
        _finding(of.isin(*RESOURCE_RELATIONS) & (kind != "Resource"), "high", "target-kind-mismatch", F.concat(of, F.lit(" target is "), kind, F.lit(", expected Resource"))),
        _finding((of == "consumesApi") & ~kind.isin("Component", "API"), "high", "target-kind-mismatch", F.concat(F.lit("consumesApi target is "), kind, F.lit(", expected Component or API"))),
        _finding((F.col("told") != "") & (F.col("told") != F.lower(kind)), "high", "target-kind-property-mismatch", F.concat(F.lit("property target_kind="), "told", F.lit(", target ref kind="), F.lower(kind))),
        _finding((kind == "Component") & F.col("clash").isNotNull(), "high", "wrong-kind-target", F.concat(F.lit("relation points to Component but same name exists as "), "clash")),
        _finding(of.isin(*CODE_RELATIONS) & F.col("repo").isNull(), "medium", "missing-relation-provenance", "code relation has no properties.source_repo"),
        *_evidence_findings(of.isin(*STRUCTURAL)),
    ]
    actual = F.concat(of, F.lit("; source_repo="), F.coalesce("repo", F.lit("-")), F.lit("; evidence="), "cited")
    return _judged(rows.withColumn("fact", F.concat("src", F.lit(" -["), "type", F.lit("]-> "), "dst")), "relation", findings, actual)


def audit(entities: DataFrame, relations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Both audits as one; `files` (path from the workspace's root, text), or none."""
    facts, edges = _entities(entities), kept(_relations(relations))
    shown = lambda rows: rows.select("evidence_key", "source_repos", "evidence")
    counts = None if files is None else _counts(shown(facts).unionByName(shown(edges)), files)
    return _judged_entities(facts, entities, counts).unionByName(_judged_relations(edges, entities, counts))


def summary(judged: DataFrame) -> DataFrame:
    """One row of counts: facts, entities, relations, findings by severity, verdicts."""
    count = lambda name, when: F.count_if(when).alias(name)
    is_ = lambda column, value: F.col(column) == value
    return judged.agg(
        F.count("*").alias("facts_audited"), count("entities_audited", is_("scope", "entity")), count("relations_audited", is_("scope", "relation")),
        *(count(f"{s}_findings", is_("severity", s)) for s in ("high", "medium", "low")), *(count(v.lower(), is_("verdict", v)) for v in ("PASS", "REVIEW", "FAIL")),
    )


def gates(judged: DataFrame) -> DataFrame:
    """(gate, status): the five promises of a catalog, each FAIL (or REVIEW, for evidence) if a fact breaks it."""
    high, fix = F.col("severity") == "high", F.col("recommended_fix")
    told = lambda *codes: reduce(Column.__or__, (fix.contains(c) for c in codes))
    sourced = F.col("scope").eqNullSafe("entity") & (F.col("fact").contains("API:") | F.col("fact").contains("Resource:"))
    rules = {
        "No Resource-as-Component or Provider-as-Component duplicates": (high & told("wrong-kind"), "FAIL"),
        "APIs and Resources carry source provenance": (high & told("missing-provenance") & sourced, "FAIL"),
        "Resource relation target kinds are respected": (high & told("target-kind"), "FAIL"),
        "Relation endpoints exist": (high & told("missing-endpoint"), "FAIL"),
        "Cited evidence resolves in workspace": (told("partial-evidence", "bad-evidence"), "REVIEW"),
    }
    broken = [F.struct(F.lit(gate).alias("gate"), F.when(F.coalesce(F.bool_or(when), F.lit(False)), status).otherwise("PASS").alias("status")) for gate, (when, status) in rules.items()]
    return judged.agg(F.array(*broken).alias("g")).select(F.inline("g"))
