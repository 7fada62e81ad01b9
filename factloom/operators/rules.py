"""Rules over facts: staleness, kinds of targets, confidence of dependencies, confinement, edge decisions, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import confidence, text

# Texts that tell of a target known at run time only; prices in USD for a million tokens (input, cached input, output) and that of other models.
DYNAMIC = ("caller-supplied", "request body", "runtime-supplied", "runtime supplied", "user-supplied", "user supplied")
PRICES = {"gpt-5.4-mini": (0.75, 0.075, 4.5), "gpt-5.4": (5.0, 0.5, 25.0)}
OTHER_PRICE = 5.0


def stale_reason(found: Column, stored: Column, current: Column, at: Column, now: str, hours: float) -> Column:
    """Why a record has to be made again: missing, commit_changed, no_timestamp, bad_timestamp or stale; null where it is fresh."""
    when = at.try_cast("timestamp")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(when)
    changed = (F.coalesce(stored, F.lit("")) != "") & (F.coalesce(current, F.lit("")) != "") & (stored != current)
    none = F.coalesce(at, F.lit("")) == ""
    return F.when(~found, "missing").when(changed, "commit_changed").when(none, "no_timestamp").when(when.isNull(), "bad_timestamp").when(age > hours * 3600, "stale")


def is_dynamic(kind: Column, told: Column, aliases: Column) -> Column:
    """Whether an API's target is known at run time only, by its notes or by an alias that begins with 'item.'."""
    marked = F.lower(F.coalesce(told, F.lit(""))).rlike("|".join(DYNAMIC))
    items = F.exists(F.split(F.lower(F.array_join(aliases, " ")), r"\s+"), lambda a: a.startswith("item."))
    return (F.coalesce(kind, F.lit("")) == "consumesApi") & (marked | items)


def target_kinds(explicit: Column, kind: Column, dynamic: Column) -> Column:
    """Kinds in which a dependency's target is looked for, in order."""
    names = lambda *kinds: F.array(*map(F.lit, kinds))
    told, api = text.canonical_key(explicit), kind == "consumesApi"
    out = F.when(dynamic, names("API", "Component"))
    for one in ("Resource", "Provider", "API", "Component"):
        out = out.when(told == one.lower(), names(one))
    out = out.when((told == "external") & api, names("Component", "API", "Provider")).when(told == "external", names("Provider"))
    out = out.when(kind.isin("producesMessage", "consumesMessage", "readsResource", "writesResource"), names("Resource"))
    return out.when(api, names("Component", "API")).otherwise(names("Component", "Provider", "Resource", "API"))


def dependency_confidence(own: Column, target: Column, explicit: Column, kind: Column, protocol: Column, dynamic: Column) -> Column:
    """The lesser confidence of a dependency and its target; review where the target is dynamic, or external without a protocol."""
    rank = confidence.build_rank(F.coalesce(F.nullif(own, F.lit("")), F.lit("medium")))
    least = confidence.from_rank(F.least(rank, F.when(F.coalesce(target, F.lit("")) != "", confidence.build_rank(target))))
    vague = (text.canonical_key(explicit) == "external") & (kind == "dependsOn") & text.canonical_key(protocol).isin("", "unknown")
    return F.when(dynamic | vague, "review").otherwise(least)


def confined(paths: Column | str) -> Column:
    """The paths of an array that lie within their repository: not empty, without a part '..'."""
    bare = lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+", "")
    return F.filter(paths, lambda p: (bare(p) != "") & ~F.array_contains(F.split(bare(p), "/"), ".."))


def new_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst) of `after` that `before` doesn't have."""
    return after.select("src", "dst").distinct().join(before.select("src", "dst"), ["src", "dst"], "left_anti")


def decide_edges(relations: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """Relations (src, type, dst) without those that decisions remove (an empty type stands for all), with those they add once."""
    left = relations.join(gone.where("type = ''").select("src", "dst"), ["src", "dst"], "left_anti").join(gone, ["src", "type", "dst"], "left_anti")
    fresh = added.select("src", "type", "dst").distinct().join(left, ["src", "type", "dst"], "left_anti")
    return left.select("src", "type", "dst").unionByName(fresh)


def usage_cost(model: Column, tokens: Column, cached: Column, output: Column, digits: int | None = 6) -> Column:
    """USD of a model call: input without what was cached, cached input and output at the model's prices; others at one price."""
    price = (tokens + output) * F.lit(OTHER_PRICE)
    for name, (fresh, kept, made) in PRICES.items():
        own = F.greatest(tokens - cached, F.lit(0)) * F.lit(fresh) + cached * F.lit(kept) + output * F.lit(made)
        price = F.when(F.coalesce(model, F.lit("")) == name, own).otherwise(price)
    return price / 1e6 if digits is None else F.round(price / 1e6, digits)


def mentions_any(value: Column | str, words: list[str]) -> Column:
    low = F.lower(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    out = F.lit(False)
    for word in filter(None, words):
        out = out | low.contains(word.lower())
    return out


def mentions_all(value: Column | str, words: list[str]) -> Column:
    low = F.lower(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    out = low != ""
    for word in filter(None, words):
        out = out & low.contains(word.lower())
    return out


def worker_ids(active: DataFrame, started: str, run: str) -> DataFrame:
    """Active workers with W1, W2, ... by start and name.  One window over the workers that are active now, a list that people read."""
    return active.withColumn("worker", F.concat(F.lit("W"), F.row_number().over(Window.orderBy(started, run))))
