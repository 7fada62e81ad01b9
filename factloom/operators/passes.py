"""Passes over an assembled catalog: brokers, stores and placeholders that stand for another entity, corrections of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence, text
from factloom.operators.assemble import match_key

# Tags and words that tell of a store, relations that tell of behaviour, names too generic to match by.
STORE_TAGS = ("database", "datastore", "db", "mongodb", "mongo", "mysql", "postgres", "postgresql", "redis", "cache", "seed-data")
STORE_WORDS = ("database", "mongodb", "mysql", "postgres", "redis", "seed data")
BEHAVIOUR = ("providesApi", "consumesApi", "producesMessage", "consumesMessage", "communicatesWith")
GENERIC_KEYS = (
    "test", "tests", "mock", "mocks", "sandbox", "fake", "stub", "demo", "dev", "prod", "staging", "qa", "uat", "preview", "draft", "server", "client", "service", "api",
    "app", "web", "ui", "backend", "frontend", "gateway", "platform", "shared", "common", "core", "main", "default", "base", "internal", "external", "public", "private",
    "hub", "edge", "node", "worker", "consumer", "producer", "search", "store", "data", "log", "auth", "user", "admin",
)


def is_external(external: Column, source_repos: Column) -> Column:
    """Whether an entity is said to be external, or no repository is its source."""
    return F.coalesce(external, F.lit(False)) | (F.size(F.coalesce(source_repos, F.array().cast("array<string>"))) < 1)


def alias_keys(name: Column, aliases: Column) -> Column:
    """Keys that lead to a component: its name's, and those of aliases (and of their hosts) of five characters or more; none that is generic."""
    others = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    hosts = F.transform(F.filter(others, text.looks_like_url), text.host_key)
    keys = F.filter(F.concat(F.transform(others, text.canonical_key), hosts), lambda k: F.length(k) >= 5)
    every = F.array_union(F.array(text.canonical_key(name)), keys)
    return F.array_sort(F.filter(every, lambda k: (k != "") & ~k.isin(*GENERIC_KEYS)))


def _floor(a: Column, b: Column) -> Column:
    """The lesser of two confidences, one alone where the other is missing."""
    rank = lambda c: F.when(c.isin(*confidence.QUERY_RANK), confidence.build_rank(c))
    return F.coalesce(confidence.from_rank(F.least(rank(a), rank(b))), F.lit("medium"))


def _merged(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "type", "dst").agg(F.sum("n_evidence").alias("n_evidence"), confidence.from_rank(F.max(confidence.build_rank(F.col("confidence")))).alias("confidence"))


def broker_edges(relations: DataFrame, resources: DataFrame) -> DataFrame:
    """Edges (src, type, dst, confidence) to the brokers that resources (ref, name, technology, n_evidence) run on: from the resources, and from components that use them."""
    found = resources.select("ref", text.broker(F.col("technology"), F.col("name")).alias("broker")).where("broker is not null")
    found = found.select(F.col("ref").alias("dst"), F.concat(F.lit("resource:"), text.canonical_name(F.lower("broker"))).alias("to"))
    own = found.select(F.col("dst").alias("src"), F.lit("dependsOn").alias("type"), F.col("to").alias("dst"), F.lit("medium").alias("confidence"))
    users = relations.where(F.col("type").isin("producesMessage", "consumesMessage", "dependsOn") & (F.lower(text.ref_kind("src")) == "component")).join(found, "dst")
    used = users.select("src", "type", F.col("to").alias("dst"), _floor(F.col("confidence"), F.lit("medium")).alias("confidence"))
    every = used.unionByName(own).where("src <> dst")
    return every.groupBy("src", "type", "dst").agg(confidence.from_rank(F.max(confidence.build_rank(F.col("confidence")))).alias("confidence"))


def stores(components: DataFrame, resources: DataFrame, relations: DataFrame) -> DataFrame:
    """(old, new, confidence): components that look like a store, have no behaviour and share their name's key with a resource.

    Components have ref, name, description, type and tags; resources ref, name, host, aliases, confidence and pos.
    """
    said = F.lower(F.concat_ws(" ", "name", "description", "type", F.array_join("tags", " ")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), text.canonical_key)
    alike = components.where(F.arrays_overlap(tags, F.array(*map(F.lit, STORE_TAGS))) | said.rlike("|".join(STORE_WORDS)))
    active = relations.where(F.col("type").isin(*BEHAVIOUR)).select(F.explode(F.array("src", "dst")).alias("ref")).distinct()
    quiet = alike.join(active, "ref", "left_anti").select(F.col("ref").alias("old"), text.canonical_key("name").alias("key")).where("key <> ''")
    keys = F.concat(F.array(text.canonical_key("name"), text.host_key("host")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), match_key))
    known = resources.select("ref", "confidence", "pos", F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.min_by(F.struct("ref", "confidence"), "pos").alias("r"))
    return quiet.join(known, "key").select("old", F.col("r.ref").alias("new"), F.col("r.confidence").alias("confidence"))


def demote_stores(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations without those of demoted components; those to them go to the resource at the lesser confidence, partOf excepted."""
    kept = relations.join(names.select(F.col("old").alias("src")).distinct(), "src", "left_anti")
    met = kept.join(names.select(F.col("old").alias("dst"), "new", F.col("confidence").alias("theirs")), "dst", "left").where("new is null or type <> 'partOf'")
    sure = F.when(F.col("new").isNull(), F.col("confidence")).otherwise(_floor(F.col("confidence"), F.col("theirs")))
    return _merged(met.select("src", "type", F.coalesce("new", "dst").alias("dst"), "n_evidence", sure.alias("confidence")))


def provider_twins(components: DataFrame, providers: DataFrame) -> DataFrame:
    """(old, new): external components (ref, name, aliases, external, source_repos) without a source that share a key with a provider (.., pos).

    Of several providers the earliest is taken; the choice needs an order, which a set of keys doesn't have.
    """
    keys = F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), match_key))).alias("key")
    lone = components.where(F.coalesce("external", F.lit(False)) & (F.size(F.coalesce("source_repos", F.array().cast("array<string>"))) < 1))
    first = providers.select("ref", "pos", keys).where("key <> ''").groupBy("key").agg(F.min(F.struct("pos", "ref")).alias("r"))
    return lone.select(F.col("ref").alias("old"), keys).where("key <> ''").join(first, "key").groupBy("old").agg(F.min("r").getField("ref").alias("new"))


def fold_providers(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations without those of folded components; those to them are dependencies on the provider, for review."""
    kept = relations.join(names.select(F.col("old").alias("src")).distinct(), "src", "left_anti").join(names.select(F.col("old").alias("dst"), "new"), "dst", "left")
    moved = F.col("new").isNotNull()
    kind = F.when(moved & F.col("type").isin("consumesApi", "communicatesWith"), "dependsOn").otherwise(F.col("type"))
    return _merged(kept.select("src", kind.alias("type"), F.coalesce("new", "dst").alias("dst"), "n_evidence", F.when(moved, "review").otherwise(F.col("confidence")).alias("confidence")))


def suffix_twins(components: DataFrame) -> DataFrame:
    """(old, new): external components without a source whose name ends in '-' and a sourced one's name, else with an alias of its key; the earliest wins.

    Every ending of a name is a row, so endings meet names by equality; a name's endings are as many as its dashes.
    """
    sources = F.size(F.coalesce("source_repos", F.array().cast("array<string>")))
    slug = F.lower(text.canonical_name("name"))
    rows = components.withColumns({"slug": slug, "key": text.canonical_key("name")})
    sourced = rows.where(sources > 0).groupBy("key").agg(F.max_by(F.struct("slug", "ref"), "pos").alias("s"), F.min("pos").alias("first")).select("key", "s.*", "first")
    lone = rows.where((sources < 1) & F.coalesce("external", F.lit(False))).select(F.col("ref").alias("old"), F.col("slug").alias("own"), F.col("key").alias("own_key"), "aliases")
    parts = F.split("own", "-")
    endings = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "-"))
    by_end = lone.select("old", "own_key", F.explode(endings).alias("slug")).join(sourced, "slug").where("key <> own_key").select("old", F.struct(F.lit(0).alias("way"), "first", "ref").alias("r"))
    keys = F.explode(F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), match_key))).alias("key")
    by_alias = lone.select("old", keys).where("key <> ''").join(sourced, "key").select("old", F.struct(F.lit(1).alias("way"), "first", "ref").alias("r"))
    return by_end.unionByName(by_alias).groupBy("old").agg(F.min("r").getField("ref").alias("new"))


def correct(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts (doc, category, index, fact) after corrections (doc, category, index, action, fact, ord): the last fix holds, a drop takes the fact away.

    Indices are those before correction, so a fact is dropped once however often that is asked; what is left is counted
    anew from 0.  Corrections of facts that don't exist, and fixes without a fact, change nothing.
    """
    asked = corrections.groupBy("doc", "category", "index").agg(
        F.max_by("fact", F.when((F.col("action") == "fix") & F.col("fact").isNotNull(), F.col("ord"))).alias("fixed"), F.bool_or(F.col("action") == "drop").alias("gone")
    )
    left = facts.join(asked, ["doc", "category", "index"], "left").where(~F.coalesce("gone", F.lit(False)))
    held = left.groupBy("doc", "category").agg(F.array_sort(F.collect_list(F.struct("index", F.coalesce("fixed", "fact").alias("fact")))).alias("f"))
    return held.select("doc", "category", F.posexplode(F.transform("f", lambda x: x["fact"])).alias("index", "fact"))
