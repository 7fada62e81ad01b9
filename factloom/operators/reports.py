"""Run records, comparisons and evaluation of catalogs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text

# Relations that predict a service's or a resource's edge.
SERVICE_TYPES = ("communicatesWith", "consumesApi", "dependsOn")
RESOURCE_TYPES = ("readsResource", "writesResource", "dependsOn")


def run_id(repo: Column) -> Column:
    """Id of the run that an extraction record stands for."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(repo, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("extraction-"), F.when(safe == "", "repo").otherwise(safe))


def run_summaries(records: DataFrame) -> DataFrame:
    """Records (repo, extracted_at text, status, n_errors, cost, seconds) as runs: started `seconds` before they ended; code 0 where all is well."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.when(F.coalesce("n_errors", F.lit(0)) > 0, "validation_errors").otherwise("ok"))
    seconds = F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0))
    ended = F.col("extracted_at").try_cast("timestamp")
    began = F.timestamp_millis(F.unix_millis(ended) - F.round(seconds * 1000).cast("long"))
    return records.select(run_id(F.col("repo")).alias("run"), began.alias("started_at"), ended.alias("finished_at"), status.alias("status"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
                          F.when(status == "ok", 0).alias("code"))


def observed(status: Column, alive: Column, started: Column, finished: Column, last_event: Column, now: Column) -> tuple[Column, Column]:
    """(status, seconds): a running run whose process is gone is abandoned; it lasted until its end, now, or its last event."""
    seen = F.when((status == "running") & ~F.coalesce(alive, F.lit(True)), "abandoned").otherwise(status)
    until = F.coalesce(finished, F.when(seen == "running", now).otherwise(last_event))
    return seen, F.round(F.greatest((F.unix_millis(until) - F.unix_millis(started)) / 1000, F.lit(0.0)), 1)


def run_metrics(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Runs (repo, started_at) with status and cost of their repository's record, unless it is older than the run."""
    new = F.col("started_at").isNull() | (F.col("extracted_at") >= F.col("started_at"))
    held = records.select("repo", "extracted_at", "status", "cost")
    joined = runs.join(held, "repo", "left")
    pick = lambda c: F.when(new, F.col(c)).alias(c)
    return joined.select(*runs.columns, F.when(new, F.coalesce(F.nullif("status", F.lit("")), F.when(F.col("extracted_at").isNotNull(), "ok"))).alias("status"), pick("cost"))


def changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(question, change): questions (question, passed) of both runs that now pass or have regressed."""
    both = current.join(baseline.select("question", F.col("passed").alias("before")), "question").where("passed <> before")
    return both.select("question", F.when(F.col("passed"), "now passes").otherwise("regressed").alias("change"))


def category_means(results: DataFrame, *metrics: str) -> DataFrame:
    """(category, pass_rate, mean of each metric where it is given; NaN where it never is)."""
    mean = lambda m: F.coalesce(F.round(F.avg(m), 6), F.lit(float("nan"))).alias(m)
    rate = F.round(F.avg(F.coalesce("passed", F.lit(False)).cast("double")), 6).alias("pass_rate")
    return results.groupBy(F.coalesce("category", F.lit("uncategorised")).alias("category")).agg(rate, *map(mean, metrics))


def compared(baseline: DataFrame, treatment: DataFrame, *counts: str) -> DataFrame:
    """Each treated repository's counts beside those before, null where it has no baseline."""
    return treatment.select("repo", *counts).join(baseline.select("repo", *(F.col(c).alias(f"{c}_before") for c in counts)), "repo", "left")


def gold_name(ref: Column, gold: list[str]) -> Column:
    """The gold component a reference means: by name, by squashed name, by its only token that is one, by the longest it holds; else null.

    `gold` is the list of an evaluation's components, so each reference is looked at once and nothing is joined.
    """
    if not gold:
        return F.lit(None).cast("string")
    name = F.lower(text.ref_name(ref))
    bare = F.regexp_replace(name, "[^a-z0-9]+", "")
    squash = lambda g: re.sub("[^a-z0-9]+", "", g.lower())
    names = F.array(*map(F.lit, gold))
    tokens = F.array_intersect(names, F.split(name, "[^a-z0-9]+"))
    exact = F.when(F.array_contains(names, name), name)
    same = F.coalesce(*(F.when(bare == squash(g), g) for g in gold))
    held = F.coalesce(*(F.when(bare.contains(squash(g)), g) for g in sorted(gold, key=len, reverse=True) if squash(g)), F.lit(None).cast("string"))
    return F.coalesce(exact, same, F.when(F.size(tokens) == 1, F.get(tokens, F.lit(0))), held)


def predicted_edges(relations: DataFrame, gold: list[str]) -> tuple[DataFrame, DataFrame]:
    """((src, dst) between gold components, directly or through an API's provider; (src, resource) of gold components)."""
    at = relations.withColumn("from", gold_name(F.col("src"), gold)).where("`from` is not null").withColumn("kind", F.lower(text.ref_kind("dst")))
    served = at.where("type = 'providesApi'").groupBy("dst").agg(F.max("from").alias("provider"))
    used = at.where(F.col("type").isin(*SERVICE_TYPES))
    direct = used.where("kind = 'component'").select("from", gold_name(F.col("dst"), gold).alias("to"))
    through = used.where("kind = 'api'").join(served, "dst").select("from", F.col("provider").alias("to"))
    services = direct.unionByName(through).where("to is not null and to <> `from`").select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()
    owned = at.where(F.col("type").isin(*RESOURCE_TYPES)).where("kind = 'resource'")
    return services, owned.select(F.col("from").alias("src"), F.lower(text.ref_name("dst")).alias("resource")).distinct()


def resource_hits(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold edges (src, resource, tokens) that a predicted one (src, resource) of the same component shares a token with."""
    found = predicted.select("src", F.explode(F.split(F.lower("resource"), "[^a-z0-9]+")).alias("token")).where("token <> ''").distinct()
    return gold.select("src", "resource", F.explode("tokens").alias("token")).join(found, ["src", "token"], "left_semi").select("src", "resource").distinct()


def repos_mentioned(value: Column, repos: list[str]) -> Column:
    """The repositories whose bare name, of four characters or more, stands in a text as a word."""
    low, out = F.lower(F.coalesce(value, F.lit(""))), []
    for repo in repos:
        name = repo.lower().rsplit("/", 1)[-1]
        if len(name) >= 4:
            out.append(F.when(low.rlike(rf"\b{re.escape(name)}\b"), repo))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def fingerprint(inventory: DataFrame) -> DataFrame:
    """One row: the SHA-256 of a tag inventory (tag, normalised, count, entity_kinds) as sorted canonical JSON; its rows are distinct tags."""
    kinds = F.array_sort(F.coalesce("entity_kinds", F.array().cast("array<string>")))
    item = F.struct(F.col("count").cast("long").alias("count"), kinds.alias("entity_kinds"), F.col("normalised").alias("normalised"), F.col("tag").alias("tag"))
    rows = inventory.select(F.struct(F.coalesce("normalised", F.lit("")).alias("n"), F.coalesce("tag", F.lit("")).alias("t"), F.to_json(item, {"ignoreNullFields": "false"}).alias("j")).alias("r"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), ",")
    return rows.agg(F.sha2(F.concat(F.lit("["), held, F.lit("]")).cast("binary"), 256).alias("fingerprint"))


def system_brief(entities: DataFrame) -> DataFrame:
    """(system, n_components, runtimes, repos): what each system consists of; entities have system, kind, runtime and repo."""
    told = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}s")
    return entities.where("kind = 'Component' and system <> ''").groupBy("system").agg(F.count("*").alias("n_components"), told("runtime"), told("repo"))


def verifier_totals(records: DataFrame) -> DataFrame:
    """One row: sums of matched, partial and missing over records, and how many have any of each."""
    names = ("matched", "partial", "missing")
    return records.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), *(F.count_if(F.col(n) > 0).alias(f"repos_{n}") for n in names))


def glossary_lines(components: DataFrame, most: int = 80) -> DataFrame:
    """(name, line) of the first components, sourced ones before others, by name: six aliases and 80 characters of what it is."""
    sourced = F.size(F.coalesce("source_repos", F.array().cast("array<string>"))) > 0
    first = components.orderBy(F.when(sourced, 0).otherwise(1), "name").limit(most)
    known = F.array_sort(F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")))
    about = F.substring(F.coalesce("description", F.lit("")), 1, 80)
    bits = F.concat_ws(" ", F.concat(F.lit("  - "), F.coalesce("name", F.lit(""))), F.when(F.size(known) > 0, F.concat(F.lit("  aliases: "), F.array_join(F.slice(known, 1, 6), ", "))),
                       F.when(about != "", F.concat(F.lit("  ("), about, F.lit(")"))))
    return first.select("name", bits.alias("line"))


def dataset(name: Column, schema: Column, host: Column, technology: Column) -> tuple[Column, Column]:
    """(namespace, name) of a resource in lineage events: its host, its technology or 'catalog'; its schema before its name."""
    given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(given(host), F.lower(given(technology)), F.lit("catalog")), F.coalesce(F.concat(given(schema), F.lit("."), given(name)), given(name), F.lit(""))


def remote_repository(url: Column) -> tuple[Column, Column]:
    """(organisation, repository) of a remote's address, null where it is none."""
    pattern = r"github\.com[:/]([\w-]+)/([\w.-]+?)(?:\.git)?/?$"
    return tuple(F.nullif(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))


def node_order(nodes: DataFrame, degrees: DataFrame, limit: int) -> DataFrame:
    """(ref, degree) of the first nodes (ref, name) by degree, lower-case name and ref; a node without edges has degree 0."""
    joined = nodes.join(degrees.select("ref", "degree"), "ref", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.orderBy(F.desc("degree"), F.lower("name"), "ref").limit(limit).select("ref", "degree")
