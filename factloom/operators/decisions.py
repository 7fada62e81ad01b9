"""People's decisions on entities, applied to a catalog: the last one of each entity holds.

Eleven actions: mark_external, link, merge, skip, set_tagline, set_owner, set_lifecycle, add_alias,
remove_alias, add_dependency and remove_dependency.  Merges are followed to the end of their chain
before entities are folded and edges rewired; then edges are removed, then added.  Applying a log
again to what it has made changes nothing.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence
from factloom.operators.graph import cut

# Actions on an entity itself, on its edges, and the lifecycles that can be set.
OWN_ACTIONS = ("mark_external", "link", "skip", "set_tagline", "set_owner", "set_lifecycle", "add_alias", "remove_alias")
EDGE_ACTIONS = ("merge", "add_dependency", "remove_dependency")
LIFECYCLES = ("production", "experimental", "deprecated")
FIELDS = ("action", "value", "target", "relation_type", "into", "repo", "category", "reason")
REASON_CHARS = 160


class Decided(NamedTuple):
    entities: DataFrame
    relations: DataFrame
    outcomes: DataFrame


def last_decisions(log: DataFrame) -> DataFrame:
    """The last decision of each entity by `ord`, without those that name none; at one `ord` the one with the greatest fields, so the order of rows is of no account."""
    named = log.where(F.coalesce("entity", F.lit("")) != "")
    return named.groupBy("entity").agg(F.max(F.struct("ord", *FIELDS)).alias("d")).select("entity", "d.*")


def _followed(pairs: DataFrame) -> DataFrame:
    """(old, to, oldest, open): where each pair leads after as many steps as there are pairs, the oldest decision on the way, and whether that is no end.

    Each round doubles how far a row has come, and the rounds end as soon as all rows have."""
    found = cut(pairs.select("old", F.col("new").alias("to"), F.struct("ord", "old").alias("oldest"), F.lit(True).alias("open")))
    for _ in range(math.ceil(math.log2(found.count() + 1)) + 1):
        ahead = found.select(F.col("old").alias("to"), F.col("to").alias("next"), F.col("oldest").alias("theirs"))
        met = found.join(ahead, "to", "left")
        older = F.when(F.col("theirs") < F.col("oldest"), F.col("theirs")).otherwise(F.col("oldest"))
        found = cut(met.select("old", F.coalesce("next", "to").alias("to"), older.alias("oldest"), F.col("next").isNotNull().alias("open")))
        if found.where("open").isEmpty():
            break
    return found


def merge_ends(pairs: DataFrame) -> DataFrame:
    """(old, new) of (old, new, ord), one row for each old: the end of each chain of merges.  In a circle the oldest decision is void."""
    found = _followed(pairs)
    rounds = found.where("open")
    if not rounds.isEmpty():
        # after so many steps a row that is still under way stands in a circle, whose oldest decision its own row there knows
        void = rounds.select(F.col("to").alias("on")).distinct().join(found.select(F.col("old").alias("on"), "oldest"), "on")
        found = _followed(pairs.join(void.select(F.col("oldest")["old"].alias("old")).distinct(), "old", "left_anti"))
    return found.select("old", F.col("to").alias("new"))


def _given(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def outcomes(decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """The decisions with `outcome`: applied, unchanged, missing (no such entity), invalid (nothing usable given), done (merged before) or unknown."""
    known = entities.select(F.col("ref").alias("entity"), F.lit(True).alias("known"), F.col("aliases").alias("_aliases"))
    into = entities.select(F.col("ref").alias("_into"), F.lit(True).alias("reachable"))
    rows = decisions.withColumn("_into", _given("into")).join(known, "entity", "left").join(into, "_into", "left")
    known, reachable = F.col("known").isNotNull(), F.col("reachable").isNotNull()
    has = F.array_contains(F.coalesce("_aliases", F.array().cast("array<string>")), _given("value"))
    is_one = lambda *names: F.coalesce(F.col("action").isin(*names), F.lit(False))
    own = F.when(is_one("set_tagline", "set_owner", "add_alias", "remove_alias") & (_given("value") == ""), "invalid")
    own = own.when(is_one("set_lifecycle") & ~_given("value").isin(*LIFECYCLES), "invalid")
    own = own.when((is_one("add_alias") & has) | (is_one("remove_alias") & ~has), "unchanged")
    merging = F.when((_given("into") == "") | (_given("into") == F.col("entity")), "invalid").when(~known, "done").when(~reachable, "invalid")
    edge = F.when(is_one("merge"), merging).when(is_one("add_dependency", "remove_dependency") & (_given("target") == ""), "invalid")
    outcome = F.when(~known & ~is_one(*EDGE_ACTIONS), "missing").when(~is_one(*OWN_ACTIONS, *EDGE_ACTIONS), "unknown")
    return rows.withColumn("outcome", F.coalesce(outcome, own, edge, F.lit("applied"))).select("entity", "ord", *FIELDS, "outcome")


def decide_entities(entities: DataFrame, decided: DataFrame) -> DataFrame:
    """Entities with what applied decisions say of them; external, category, source_repos, source_location, tagline, owner, lifecycle and aliases may change."""
    rows = entities.join(decided.select(F.col("entity").alias("ref"), "action", "value", "repo", F.col("category").alias("_category")), "ref", "left")
    on = lambda name: F.coalesce(F.col("action") == name, F.lit(False))
    linked = on("link") & (_given("repo") != "")
    aliases, alias = F.coalesce("aliases", F.array().cast("array<string>")), _given("value")
    put = lambda name: F.when(on(f"set_{name}"), alias).otherwise(F.col(name))
    changed = {
        "external": F.when(on("mark_external"), True).when(on("link"), False).otherwise(F.col("external")),
        "category": F.when(on("mark_external"), F.coalesce(F.nullif("_category", F.lit("")), F.lit("other"))).otherwise(F.col("category")),
        "source_repos": F.when(linked, F.array("repo")).otherwise(F.col("source_repos")),
        "source_location": F.when(linked & F.col("source_location").isNull(), F.concat(F.lit("url:https://github.com/"), "repo", F.lit("/"))).otherwise(F.col("source_location")),
        "tagline": put("tagline"), "owner": put("owner"), "lifecycle": put("lifecycle"),
        "aliases": F.when(on("add_alias"), F.array_sort(F.array_distinct(F.concat(aliases, F.array(alias))))).when(on("remove_alias"), F.array_remove(aliases, alias)).otherwise(F.col("aliases")),
    }
    return rows.withColumns(changed).select(*entities.columns)


def fold_entities(entities: DataFrame, ends: DataFrame) -> DataFrame:
    """Entities without those that are merged, whose names and aliases, tags and evidence go to where they end; a description only where there is none.

    Names and tags are made distinct before they meet, so repeated ones don't add up under an entity that many are merged into."""
    moved = entities.join(ends.select(F.col("old").alias("ref"), F.col("new").alias("into")), "ref")
    kept = entities.join(ends.select(F.col("old").alias("ref")), "ref", "left_anti")
    none = F.array().cast("array<string>")
    names = moved.select("into", F.explode(F.array_append(F.coalesce("aliases", none), F.col("name"))).alias("alias")).where(F.coalesce("alias", F.lit("")) != "").distinct()
    tags = moved.select("into", F.explode(F.coalesce("tags", none)).alias("tag")).where(F.coalesce("tag", F.lit("")) != "").distinct()
    names, tags = names.groupBy("into").agg(F.collect_list("alias").alias("_aliases")), tags.groupBy("into").agg(F.collect_list("tag").alias("_tags"))
    told = F.col("description").isNotNull() & (F.col("description") != "")
    rest = moved.groupBy("into").agg(F.sum("n_evidence").alias("_evidence"), F.min_by("description", F.when(told, F.col("ref"))).alias("_description"))
    rows = kept.join(rest.join(names, "into", "left").join(tags, "into", "left").withColumnRenamed("into", "ref"), "ref", "left")
    union = lambda own, theirs: F.array_sort(F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce(theirs, none))))
    folded = F.col("_evidence").isNotNull()
    return rows.withColumns({
        "aliases": F.when(folded, union("aliases", "_aliases")).otherwise(F.col("aliases")), "tags": F.when(folded, union("tags", "_tags")).otherwise(F.col("tags")),
        "n_evidence": F.col("n_evidence") + F.coalesce("_evidence", F.lit(0)), "description": F.coalesce(F.nullif("description", F.lit("")), "_description", "description"),
    }).select(*entities.columns)


def rewire(relations: DataFrame, ends: DataFrame, highest: bool = False) -> DataFrame:
    """Relations (src, type, dst, n_evidence, confidence, source) between the ends of merges: no self-loops among them, equal ones one with all evidence and the first's other fields.

    With `highest` their confidence is the highest of theirs.

    An end that many were merged into takes part in a join on names that are still apart, and meets others only in a sum that tasks begin by themselves."""
    moved = relations
    for end in ("src", "dst"):
        side = ends.select(F.col("old").alias(end), F.col("new").alias(f"_{end}"))
        moved = moved.join(side, end, "left")
    first = F.struct("src", "type", "dst")
    moved = moved.select(first.alias("first"), F.coalesce("_src", "src").alias("src"), "type", F.coalesce("_dst", "dst").alias("dst"), "n_evidence", "confidence", "source")
    own = F.min(F.struct("first", "confidence", "source")).alias("own")
    best = confidence.from_rank(F.max(confidence.build_rank(F.col("confidence")))).alias("best")
    merged = moved.where("src <> dst").groupBy("src", "type", "dst").agg(F.sum("n_evidence").alias("n_evidence"), own, best)
    return merged.select("src", "type", "dst", "n_evidence", (F.col("best") if highest else F.col("own.confidence")).alias("confidence"), F.col("own.source").alias("source"))


def decide_relations(relations: DataFrame, decided: DataFrame) -> DataFrame:
    """Relations without those that decisions remove (no type stands for all), with those they add, for review and without evidence, where they aren't there."""
    gone = decided.where("action = 'remove_dependency'").select(F.col("entity").alias("src"), _given("relation_type").alias("type"), _given("target").alias("dst")).distinct()
    left = relations.join(gone.where("type = ''").select("src", "dst"), ["src", "dst"], "left_anti").join(gone, ["src", "type", "dst"], "left_anti")
    kind = F.coalesce(F.nullif(_given("relation_type"), F.lit("")), F.lit("dependsOn"))
    added = decided.where("action = 'add_dependency'").select(F.col("entity").alias("src"), kind.alias("type"), _given("target").alias("dst"))
    fresh = added.join(left, ["src", "type", "dst"], "left_anti").select("src", "type", "dst", F.lit(0).cast("long").alias("n_evidence"), F.lit("review").alias("confidence"), F.lit("triage").alias("source"))
    return left.select("src", "type", "dst", "n_evidence", "confidence", "source").unionByName(fresh)


def merge_pairs(entities: DataFrame, relations: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) with the first of each pair (old, new), as of twins by their names, folded into the second and its edges rewired at the highest confidence."""
    ends = merge_ends(pairs.withColumn("ord", F.lit(0)))
    return fold_entities(entities, ends), rewire(relations, ends, highest=True)


def decide(entities: DataFrame, relations: DataFrame, log: DataFrame) -> Decided:
    """A catalog after the decisions of a log (ord, entity and FIELDS), and what became of each entity's last decision.

    `entities` has ref, name, description, tagline, owner, lifecycle, category, external, source_repos, source_location,
    aliases, tags and n_evidence, and keeps other columns; `relations` has src, type, dst, n_evidence, confidence and source.
    """
    told = cut(outcomes(last_decisions(log), entities))
    applied = told.where("outcome = 'applied'")
    ends = merge_ends(applied.where("action = 'merge'").select(F.col("entity").alias("old"), _given("into").alias("new"), "ord"))
    rewired = relations if ends.isEmpty() else rewire(relations, ends)
    return Decided(fold_entities(decide_entities(entities, applied), ends), decide_relations(rewired, applied), told)
