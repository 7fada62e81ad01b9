"""Catalog assembly: extraction documents, one per repository, become entities and relations.

Each category of a document is one explode; facts of all documents meet in one aggregation per reference or edge.
Null documents, sections and fields count as absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence, text
from factloom.operators import evidence as proof
from factloom.operators import graph, rules

EVIDENCE = "array<struct<path:string,line:int,snippet:string>>"
#: Schema of an extraction document, for spark.read.schema(DOCUMENT).json(...).
DOCUMENT = f"""repo struct<id:string,tagline:string,system:string,domain:string,owner:string,lifecycle:string,
    summary:struct<purpose:string,notes:string,primary_language:string,runtime:string,evidence:{EVIDENCE}>>,
  components array<struct<name:string,type:string,runtime:string,lifecycle:string,subcomponent_of:string,notes:string,tags:array<string>,aliases:array<string>,evidence:{EVIDENCE}>>,
  apis array<struct<name:string,type:string,notes:string,aliases:array<string>,evidence:{EVIDENCE}>>,
  resources array<struct<name:string,type:string,technology:string,host_or_instance:string,datasource_url:string,access:string,confidence:string,notes:string,
    env_or_config_keys:array<string>,aliases:array<string>,evidence:{EVIDENCE}>>,
  providers array<struct<name:string,category:string,description:string,aliases:array<string>,evidence:{EVIDENCE}>>,
  dependencies array<struct<source:string,target:string,target_kind:string,kind:string,protocol:string,confidence:string,notes:string,aliases:array<string>,evidence:{EVIDENCE}>>"""
# The relation that an access means; relations that a dependency can be.
ACCESS = {
    "read": "readsResource", "write": "writesResource", "read-write": "readsResource", "publish": "producesMessage", "consume": "consumesMessage",
    "publish-consume": "consumesMessage",
}
DEPENDENCY = ("dependsOn", "consumesApi", "producesMessage", "consumesMessage", "readsResource", "writesResource")
_LISTS = ("tags", "aliases", "source_repos", "keys")


def _given(value: Column) -> Column:
    """A trimmed value, null where nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def _strings(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def _compact(values: Column) -> Column:
    return F.array_distinct(F.filter(_strings(values), lambda v: F.coalesce(v, F.lit("")) != ""))


def match_key(value: Column) -> Column:
    """The key a label is looked up by: canonical, or that of its host."""
    key = text.canonical_key(value)
    return F.when(key == "", text.host_key(value)).otherwise(key)


def _documents(docs: DataFrame) -> DataFrame:
    """Documents with the names their parts share: repository, main component, all components, what a repository says of itself."""
    main = text.canonical_name(text.short_repo("repo.id"))
    named = F.transform("components", lambda c, k: F.when(k == 0, F.col("main")).otherwise(text.canonical_name(F.coalesce(F.nullif(c["name"], F.lit("")), F.col("main")))))
    domain = text.domain_label("repo.domain")
    return docs.withColumns({
        "repo_id": F.coalesce("repo.id", F.lit("")), "main": main, "system": _given(F.col("repo.system")), "domain": F.nullif(domain, F.lit("")), "owner": _given(F.col("repo.owner")),
        "about": F.coalesce(F.nullif("repo.summary.purpose", F.lit("")), "repo.summary.notes", F.lit("")),
    }).withColumn("units", F.when(F.size(F.coalesce("components", F.array())) > 0, named).otherwise(F.array("main")))


def _units(docs: DataFrame) -> DataFrame:
    """One row per component; a document without any has its repository as one.  The first is named by the repository."""
    return docs.select("*", F.posexplode_outer("components").alias("at", "c")).withColumn("at", F.coalesce("at", F.lit(0))).withColumn("name", F.get("units", F.col("at")))


def _order(part: int, at: Column) -> Column:
    return F.struct(F.col("repo_id").alias("repo"), F.lit(part).alias("part"), at.cast("int").alias("at")).alias("ord")


def _entity(rows: DataFrame, part: int, kind: str, name: Column, sure: Column | str, **fields: Column) -> DataFrame:
    text_of = lambda c: fields.get(c, F.lit(None).cast("string")).cast("string").alias(c)
    list_of = lambda c: _compact(fields.get(c, F.array().cast("array<string>"))).alias(c)
    return rows.select(
        F.concat(F.lit(f"{kind}:"), name).alias("ref"), F.lit(kind).alias("kind"), name.alias("name"), *map(text_of, ("description", "type", "owner", "system", "domain", "lifecycle", "host")),
        F.lit(fields.get("external", False)).cast("boolean").alias("external"), *map(list_of, _LISTS),
        (F.lit(sure) if isinstance(sure, str) else sure).alias("confidence"), _order(part, fields.get("at", F.lit(0))),
        F.coalesce(fields.get("evidence", F.lit(None).cast(EVIDENCE)), F.array().cast(EVIDENCE)).alias("evidence"),
    )


def _exploded(docs: DataFrame, category: str) -> DataFrame:
    return docs.select("*", F.posexplode(category).alias("at", "x"))


def entity_facts(docs: DataFrame) -> DataFrame:
    """(ref, kind, name, ..., confidence, ord, evidence) of every component, system, domain, group, provider, API and resource that a document names."""
    docs = _documents(docs)
    units, repo = _units(docs), F.array("repo_id")
    said = F.array("repo.summary.primary_language", "repo.summary.runtime")
    owner = F.coalesce("owner", F.lit("unknown"))
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    parts = [
        _entity(units, 0, "Component", F.col("name"), "high", description=F.coalesce(F.nullif("c.notes", F.lit("")), "about"), type=given("c.type", "service"), owner=owner, system=F.col("system"),
                domain=F.col("domain"), lifecycle=F.coalesce(_given(F.col("c.lifecycle")), _given(F.col("repo.lifecycle")), F.lit("unknown")), tags=F.concat(said, _strings(F.col("c.tags"))),
                aliases=F.col("c.aliases"), source_repos=repo, at=F.col("at"), evidence=F.col("c.evidence")),
        _entity(docs.where("system is not null"), 1, "System", text.canonical_name("system"), "medium", owner=owner),
        _entity(docs.where("system is not null and domain is not null"), 2, "Domain", text.canonical_name("domain"), "medium", owner=owner,
                aliases=F.when(F.trim("repo.domain") != F.col("domain"), F.array(F.trim("repo.domain")))),
        _entity(docs.where("owner is not null"), 3, "Group", text.canonical_name("owner"), "medium", type=F.lit("team")),
        _entity(_exploded(docs, "providers").where("x.name <> ''"), 4, "Provider", text.canonical_name("x.name"), "high", description=F.col("x.description"), type=F.lit("provider"),
                owner=F.lit("external"), lifecycle=F.lit("production"), external=True, aliases=F.col("x.aliases"), source_repos=repo, at=F.col("at"), evidence=F.col("x.evidence")),
        _entity(_exploded(docs, "apis"), 5, "API", text.canonical_name(given("x.name", "unknown-api")), "high", description=F.col("x.notes"), type=given("x.type", "rest"), owner=F.lit("unknown"),
                lifecycle=F.lit("unknown"), aliases=F.col("x.aliases"), source_repos=repo, at=F.col("at"), evidence=F.col("x.evidence")),
        _entity(_exploded(docs, "resources"), 6, "Resource", _resource(), given("x.confidence", "medium"), description=F.col("x.notes"), type=given("x.type", "unknown"), owner=F.lit("unknown"),
                host=F.col("x.host_or_instance"), aliases=F.col("x.aliases"), source_repos=repo, at=F.col("at"), evidence=F.col("x.evidence"),
                keys=F.concat(_strings(F.col("x.env_or_config_keys")), F.array("x.datasource_url", "x.host_or_instance"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _resource() -> Column:
    return text.preferred_name(F.col("x.name"), F.col("x.host_or_instance"), F.col("units"))


def _edge(rows: DataFrame, src: Column, kind: Column | str, dst: Column, sure: Column | str, via: str, evidence: Column | None = None) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    shown = F.lit(None).cast(EVIDENCE) if evidence is None else evidence
    order = _order(0, F.col("at") if "at" in rows.columns else F.lit(0))
    return rows.select(src.alias("src"), lit(kind).alias("type"), dst.alias("dst"), lit(sure).alias("confidence"), F.lit(via).alias("via"), F.coalesce(shown, F.array().cast(EVIDENCE)).alias("evidence"), order)


def relation_facts(docs: DataFrame) -> DataFrame:
    """(src, type, dst, confidence, via, evidence, ord) that documents state outright; dependencies on labels are in `deferred`."""
    docs = _documents(docs)
    units = _units(docs)
    to = lambda kind, name: F.concat(F.lit(f"{kind}:"), name)
    own, main, system = to("Component", F.col("name")), to("Component", F.col("main")), to("System", text.canonical_name("system"))
    parent = text.canonical_name("c.subcomponent_of")
    access = F.coalesce(*(F.when(F.col("x.access") == k, v) for k, v in ACCESS.items()), F.lit("dependsOn"))
    parts = [
        _edge(units.where(F.trim("c.subcomponent_of") != "").where(parent != F.col("name")), own, "subcomponentOf", to("Component", parent), "high", "subcomponent_of", F.col("c.evidence")),
        _edge(units.where("system is not null"), own, "partOf", system, "medium", ""),
        _edge(docs.where("system is not null and domain is not null"), system, "partOf", to("Domain", text.canonical_name("domain")), "medium", ""),
        _edge(units.where("owner is not null"), own, "ownedBy", to("Group", text.canonical_name("owner")), "medium", ""),
        _edge(_exploded(docs, "providers").where("x.name <> ''"), main, "dependsOn", to("Provider", text.canonical_name("x.name")), "high", "provider", F.col("x.evidence")),
        _edge(_exploded(docs, "apis"), main, "providesApi", to("API", text.canonical_name(F.coalesce(F.nullif("x.name", F.lit("")), F.lit("unknown-api")))), "high", "", F.col("x.evidence")),
        _edge(_exploded(docs, "resources"), main, access, to("Resource", _resource()), F.coalesce(F.nullif("x.confidence", F.lit("")), F.lit("medium")), "", F.col("x.evidence")),
    ]
    return reduce(DataFrame.unionByName, parts)


def deferred(docs: DataFrame) -> DataFrame:
    """(src, type, label, keys, kinds, dynamic, ...) of dependencies whose target is a label; those without a label are none."""
    rows = _exploded(_documents(docs), "dependencies").where("x.target <> ''")
    told = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    source = text.canonical_name(F.coalesce(F.nullif("x.source", F.lit("")), "main"))
    kind, aliases = told("x.kind", "dependsOn"), F.concat(_strings(F.col("x.aliases")), F.array("x.target"))
    dynamic = rules.is_dynamic(kind, F.col("x.notes"), aliases)
    wanted = F.array_distinct(F.filter(F.transform(F.concat(F.array("x.target"), aliases), match_key), lambda k: k != ""))
    return rows.select(
        F.concat(F.lit("Component:"), F.when(F.array_contains("units", source), source).otherwise(F.col("main"))).alias("src"),
        F.when(kind.isin(*DEPENDENCY), kind).otherwise("dependsOn").alias("type"), F.col("x.target").alias("label"), wanted.alias("wanted"),
        rules.target_kinds(told("x.target_kind", "component"), kind, dynamic).alias("kinds"), told("x.target_kind", "component").alias("told"), kind.alias("kind"),
        told("x.protocol", "unknown").alias("protocol"), told("x.confidence", "medium").alias("own"), dynamic.alias("dynamic"), _compact(aliases).alias("aliases"),
        F.coalesce("x.evidence", F.array().cast(EVIDENCE)).alias("evidence"), "repo_id", _order(7, F.col("at")),
    )


def upsert(facts: DataFrame) -> DataFrame:
    """One row per ref: the first non-empty text fields, unions of lists, the highest confidence; external where all its facts are."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("ord"))).alias(c)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return facts.groupBy("ref").agg(
        *map(first, ("kind", "name", "description", "type", "owner", "system", "domain", "lifecycle", "host")), *map(union, _LISTS),
        F.bool_and("external").alias("external"), confidence.from_rank(F.max(confidence.build_rank(F.col("confidence")))).alias("confidence"), F.min("ord").alias("ord"),
    )


def alias_claims(entities: DataFrame) -> DataFrame:
    """(key, kind, ref): who has a key: a real entity's name before a placeholder's, any name before aliases, the earliest of equals."""
    name = F.struct(F.col("name").alias("label"), F.when(F.col("external"), 2).otherwise(3).alias("priority"))
    others = F.transform(F.concat("aliases", "keys"), lambda a: F.struct(a.alias("label"), F.lit(1).alias("priority")))
    rows = entities.select("ref", "kind", "ord", F.explode(F.concat(F.array(name), others)).alias("c"))
    rows = rows.select("ref", "kind", match_key(F.col("c.label")).alias("key"), F.struct((-F.col("c.priority")).alias("p"), "ord").alias("by")).where("key <> ''")
    return rows.groupBy("key", "kind").agg(F.min_by("ref", "by").alias("ref"))


def resolve_deferred(wanted: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts on placeholder entities, relations): each dependency goes to the entity of the first key and kind that has one.

    Labels nobody has get one placeholder per first kind and key, named by the earliest of them.  Keys and kinds are
    looked up once for all dependencies that share them.
    """
    asked = wanted.select("wanted", "kinds").distinct()
    pairs = asked.select("wanted", "kinds", F.posexplode("wanted").alias("k", "key")).select("*", F.posexplode("kinds").alias("j", "kind"))
    found = pairs.join(alias_claims(entities), ["key", "kind"]).groupBy("wanted", "kinds").agg(F.min_by("ref", F.struct("k", "j")).alias("found"))
    rows = wanted.join(found, ["wanted", "kinds"], "left")
    lost = rows.where("found is null").withColumns({"first_kind": F.get("kinds", F.lit(0)), "key": F.coalesce(F.get("wanted", F.lit(0)), F.lit(""))})
    names = lost.groupBy("first_kind", "key").agg(F.concat("first_kind", F.lit(":"), F.min_by(text.canonical_name("label"), "ord")).alias("placeholder"))
    held = lost.join(names, ["first_kind", "key"])
    component = F.col("first_kind") == "Component"
    facts = held.select(
        F.col("placeholder").alias("ref"), F.col("first_kind").alias("kind"), text.ref_name("placeholder").alias("name"),
        F.concat(F.when(component, "External or unresolved: ").otherwise(F.concat(F.lit("Unresolved "), F.lower("first_kind"), F.lit(" dependency: "))), "label").alias("description"),
        F.when(component, "service").when(F.col("first_kind") == "Provider", "provider").when((F.col("first_kind") == "Resource") & F.col("kind").isin("producesMessage", "consumesMessage"), "queue")
        .when(F.col("first_kind") == "API", F.when(F.col("dynamic"), "dynamic-http").otherwise(F.col("protocol"))).otherwise("unknown").alias("type"),
        F.when(F.col("first_kind") == "Provider", "external").otherwise("unknown").alias("owner"), *(F.lit(None).cast("string").alias(c) for c in ("system", "domain", "lifecycle", "host")),
        F.col("first_kind").isin("Component", "Provider").alias("external"), F.when(component, F.array(F.lit("external"))).otherwise(F.array().cast("array<string>")).alias("tags"), "aliases",
        F.when(component, F.array().cast("array<string>")).otherwise(F.array("repo_id")).alias("source_repos"), F.array().cast("array<string>").alias("keys"),
        F.when(component, "medium").otherwise("review").alias("confidence"), "ord",
    )
    known = entities.select(F.col("ref").alias("dst"), F.col("confidence").alias("theirs"))
    met = rows.where("found is not null").withColumn("dst", F.col("found")).join(known, "dst").unionByName(
        held.withColumn("dst", F.col("placeholder")).withColumn("theirs", F.when(component, "medium").otherwise("review")).drop("first_kind", "key", "placeholder"), allowMissingColumns=True
    )
    sure = rules.dependency_confidence(F.col("own"), F.col("theirs"), F.col("told"), F.col("kind"), F.col("protocol"), F.col("dynamic"))
    return facts, met.select("src", "type", "dst", sure.alias("confidence"), F.lit("").alias("via"), "evidence", "ord")


def merge_edges(facts: DataFrame) -> DataFrame:
    """(src, type, dst, confidence, via, n_evidence, evidence, evidence_file): edges with their first evidence, distinct by path and line, and their highest confidence."""
    keys = ["src", "type", "dst"]
    edges = facts.groupBy(*keys).agg(confidence.from_rank(F.max(confidence.build_rank(F.col("confidence")))).alias("confidence"), F.max("via").alias("via"))
    return proof.with_evidence(edges, facts, keys)


def catalog(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a corpus of extraction documents.  What later steps read again is checkpointed, so documents are parsed three times in all."""
    named = graph.cut(entity_facts(docs))
    placeholders, found = resolve_deferred(graph.cut(deferred(docs)), upsert(named))
    every = named.unionByName(placeholders, allowMissingColumns=True)
    return proof.with_evidence(upsert(every), every, ["ref"]), merge_edges(relation_facts(docs).unionByName(found))
