"""APIs that extraction found, enriched by what specifications in the same repository say of them.

An index from the telling words of a name to the one API of the repository that has them; a name that two APIs share is left alone, and a
specification that no API has adds none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text

API = ["repo", "pos"]


def operation_place(operation: Column) -> Column:
    """What makes an operation one: its method and its path, or its name where it has no path."""
    blank = lambda c: F.coalesce(operation[c], F.lit(""))
    return F.struct(blank("method").alias("method"), F.coalesce(F.nullif(operation["path"], F.lit("")), blank("name")).alias("place"))


def evidence_place(evidence: Column) -> Column:
    return F.struct(evidence["path"], evidence["line"], evidence["snippet"])


def targets(apis: DataFrame) -> DataFrame:
    """(repo, key, pos): names of a repository that exactly one of its APIs has, by telling words."""
    found = apis.groupBy("repo", text.api_key("name").alias("key")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return found.where("n = 1").drop("n")


def matched(apis: DataFrame, specs: DataFrame) -> DataFrame:
    """Specifications (repo, ord, name, rule, operations, evidence) with `pos`, the API that each is of."""
    return specs.withColumn("key", text.api_key("name")).join(targets(apis), ["repo", "key"]).drop("key")


def additions(apis: DataFrame, specs: DataFrame, column: str, place: Callable[[Column], Column]) -> DataFrame:
    """(repo, pos, ord, k, item): items of matched specifications that their API doesn't have, each once, from the first specification that has it."""
    items = specs.select(*API, "ord", F.posexplode(column).alias("k", "item")).where("item is not null").withColumn("place", F.to_json(place(F.col("item"))))
    first = items.groupBy(*API, "place").agg(F.min(F.struct("ord", "k", "item")).alias("by"))
    held = apis.select(*API, F.explode(column).alias("item")).where("item is not null").select(*API, F.to_json(place(F.col("item"))).alias("place"))
    return first.join(held, [*API, "place"], "left_anti").select(*API, "by.*")


def _listed(added: DataFrame, column: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", "k", "item")))
    return added.groupBy(*API).agg(F.transform(ordered, lambda x: x["item"]).alias(f"new_{column}"))


def enriched(apis: DataFrame, specs: DataFrame) -> DataFrame:
    """`apis` (repo, pos, name, operations, evidence, emitted_by, ...), one per repo and pos, with what matched `specs` add behind their own lists.

    Operations are one per method and path or name, evidence one per path, line and snippet, rules one per name, in order of the specifications, of equal `ord` by place and value;
    lists that are null and get nothing stay null.  Names without a telling word match as one."""
    # a rule is known by its name, once
    found = matched(apis, specs).withColumn("emitted_by", F.array("rule"))
    out = apis
    for column, place in {"operations": operation_place, "evidence": evidence_place, "emitted_by": lambda rule: F.struct(rule.alias("rule"))}.items():
        out = out.join(_listed(additions(apis, found, column, place), column), API, "left")
        none = F.array().cast(apis.schema[column].dataType)
        whole = F.concat(F.coalesce(column, none), F.coalesce(f"new_{column}", none))
        out = out.withColumn(column, F.when(F.col(column).isNotNull() | F.col(f"new_{column}").isNotNull(), whole)).drop(f"new_{column}")
    return out.select(*apis.columns)


def enrichment(apis: DataFrame, specs: DataFrame) -> DataFrame:
    """(repo, facts, merged_apis, operations_added): specifications of a repository, those that added an operation, and how many were added."""
    added = additions(apis, matched(apis, specs), "operations", operation_place)
    counts = added.groupBy("repo").agg(F.count_distinct("pos", "ord").alias("merged_apis"), F.count("*").alias("operations_added"))
    return specs.groupBy("repo").agg(F.count("*").alias("facts")).join(counts, "repo", "left").fillna(0, ["merged_apis", "operations_added"])
