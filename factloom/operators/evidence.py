"""Merges that keep what speaks for a fact: its first evidence, unions of lists, first-won properties.

Evidence and list values are made different in shuffles of their own, so an entity or edge that every repository names is spread over tasks; of each
part of a fact's evidence only the first places go on, so no row grows with the number of its facts.  Lists grow with their different values alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import merge
from factloom.operators.graph import kept

# Evidence that a merged fact keeps, that a queue and an embedding text show, and how many characters of each there; properties that are united.
KEPT, QUEUED, EMBEDDED, EMBEDDED_CHARS = 8, 5, 6, 200
UNITED = ("aliases", "endpoints", "transports", "mechanisms", "via_edges")
EVIDENCE = "array<struct<path:string,line:int,snippet:string>>"
#: Hashes by which the facts of edges are counted, facts of one beyond which its edges are spread, and facts of a part of the others, on average.
HASHES, HOT, PART_ROWS = 262_144, 5_000, 200_000


def first_places(facts: DataFrame, keys: list[str], most: int = KEPT) -> DataFrame:
    """(keys, n_evidence, evidence, evidence_file) of facts (keys, ord, evidence): evidence is one per path and line, the first by `ord` and place in its list.

    n_evidence counts all of it, evidence holds the first `most`, evidence_file is the first path.  Keys without evidence have no row."""
    items = facts.select(*keys, "ord", F.posexplode("evidence").alias("k", "e")).where("e is not null")
    by = F.struct("ord", "k", F.col("e.snippet").alias("snippet"))
    # one shuffle by key and part: equal places meet in it, and the parts' first places and counts are told from it
    items = items.withColumn("salt", F.pmod(F.xxhash64("e.path", "e.line"), F.lit(16))).repartition(*keys, "salt")
    one = items.groupBy(*keys, "salt", F.col("e.path").alias("path"), F.col("e.line").alias("line")).agg(F.min(by).alias("by"))
    of = lambda *parts: Window.partitionBy(*keys, *parts)
    rank = lambda *parts: F.row_number().over(of(*parts).orderBy("p"))
    spread = one.select(*keys, "salt", F.struct("by", "path", "line").alias("p")).withColumns({"k": rank("salt"), "of_part": F.count("*").over(of("salt"))})
    firsts = spread.where(F.col("k") <= most).withColumn("n", rank())
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.col("p")))), lambda p: F.struct(p["path"].alias("path"), p["line"].alias("line"), p["by"]["snippet"].alias("snippet")))
    listed = firsts.groupBy(*keys).agg(F.sum(F.when(F.col("k") == 1, F.col("of_part"))).alias("n_evidence"), shown.alias("evidence"))
    return listed.withColumn("evidence_file", F.get("evidence", F.lit(0))["path"])


def with_evidence(merged: DataFrame, facts: DataFrame, keys: list[str], most: int = KEPT) -> DataFrame:
    """Merged rows with n_evidence (0 without any), evidence (empty without any) and evidence_file of their facts."""
    out = merged.join(first_places(facts, keys, most), keys, "left")
    return out.withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "evidence": F.coalesce("evidence", F.array().cast(facts.schema["evidence"].dataType))})


def united(facts: DataFrame, keys: list[str], lists: tuple[str, ...]) -> DataFrame:
    """(keys, lists): each list column of facts as one sorted list of its different values; nulls are no values.  Keys without any value have no row."""
    tagged = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(c).alias("list"), v.alias("value")))
    every = F.concat(*map(tagged, lists))
    values = facts.select(*keys, F.explode(every).alias("v")).select(*keys, "v.*").where("value is not null").distinct()
    return values.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.col("value")))).alias(c) for c in lists))


def first_items(facts: DataFrame, keys: list[str], column: str, field: str) -> DataFrame:
    """(keys, column): items of a list column, one per value of `field`, the first by `ord` and place; in that order.  Items without the field are none."""
    items = facts.select(*keys, "ord", F.posexplode(column).alias("k", "i")).where(F.coalesce(F.col(f"i.{field}"), F.lit("")) != "")
    one = items.groupBy(*keys, F.col(f"i.{field}").alias("_of")).agg(F.min(F.struct("ord", "k", "i")).alias("by"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("by")), lambda b: b["i"]).alias(column))


def merged_properties(facts: DataFrame, keys: list[str], united_names: tuple[str, ...] = UNITED) -> DataFrame:
    """(keys, properties) of facts (keys, ord, properties map<string, array<string>>): the values of `united_names` united and sorted, of other names those of the first fact that has the name."""
    rows = facts.select(*keys, "ord", F.explode("properties").alias("name", "values"))
    union = F.col("name").isin(*united_names)
    values = rows.where(union).select(*keys, "name", F.explode_outer("values").alias("value")).distinct()
    together = values.groupBy(*keys, "name").agg(F.array_sort(F.collect_list("value")).alias("values"))
    firsts = rows.where(~union).groupBy(*keys, "name").agg(F.min(F.struct("ord", "values"))["values"].alias("values"))
    entry = F.struct("name", "values")
    return together.unionByName(firsts).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("properties"))


def parts(spark: SparkSession, facts: int) -> int:
    """Into how many parts so many facts are dealt out: a shuffle's own number, or more, so that the writer of a shuffle and a task behind it hold about PART_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), facts // PART_ROWS + 1)


def _dealt(facts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Facts of keys that are bounded, all of a key in one of several parts, and those whose keys may have more than HOT; none without any.

    Facts are counted by a hash of their key, of which there are few: a busy one takes keys along that have few facts themselves."""
    facts = facts.withColumn("_of", F.pmod(F.xxhash64(*keys), F.lit(HASHES)).cast("int"))
    sizes = kept(facts.groupBy("_of").agg(F.count("*").alias("size")))
    n = parts(facts.sparkSession, sizes.agg(F.sum("size")).first()[0] or 0)
    hot = F.broadcast(sizes.where(F.col("size") > HOT).select("_of"))
    part = lambda how: facts.join(hot, "_of", how).drop("_of")
    if hot.isEmpty():
        return facts.drop("_of").repartition(n, *keys), None
    # they are read several times
    return part("left_anti").repartition(n, *keys), kept(part("left_semi"))


def _once(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """`rows` with the columns `keep` and new ones; an explode keeps these columns of their own, that no later step works out again."""
    new = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select(*keep, F.explode(F.array(new)).alias("_new")).select(*keep, "_new.*")


def _folded(facts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """What `_merged` makes, of facts that are dealt out by their keys: a key's are listed, so that they need no other shuffle."""
    places = F.transform("evidence", lambda e, k: F.when(e.isNotNull(), F.struct(F.col("ord").alias("ord"), k.alias("k"), e["snippet"].alias("snippet"), e["path"].alias("path"), e["line"].alias("line"))))
    said = F.transform(F.map_entries("properties"), lambda p: F.struct(p["key"].alias("name"), F.col("ord").alias("ord"), p["value"].alias("values")))
    rows = facts.select(*keys, "confidence", places.alias("places"), said.alias("said"))
    listed = rows.groupBy(*keys).agg(merge.highest(F.col("confidence")).alias("confidence"), F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("said")).alias("said"))
    rows = _once(listed, *keys, "confidence", "said", places=F.sort_array(F.array_compact("places")))
    # a place as one text, a null apart from any other: equal texts are found by hash
    at = lambda p: F.concat(F.coalesce(p["line"].cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.concat(F.lit("p"), p["path"]), F.lit("")))
    rows = _once(rows, *keys, "confidence", "said", "places", at=F.transform("places", at))
    rows = _once(rows, *keys, "confidence", "said", "places", "at", different=F.array_distinct("at"))
    first = F.transform(F.slice("different", 1, most), lambda a: F.get("places", (F.array_position("at", a) - 1).cast("int")))
    shown = F.transform(first, lambda p: F.struct(p["path"].alias("path"), p["line"].alias("line"), p["snippet"].alias("snippet")))
    of = lambda n: F.filter("said", lambda s: s["name"] == n)
    together = lambda n: F.sort_array(F.array_distinct(F.array_compact(F.flatten(F.transform(F.filter(of(n), lambda s: s["values"].isNotNull()), lambda s: s["values"])))))
    earliest = lambda n: F.array_min(F.transform(of(n), lambda s: F.struct(s["ord"].alias("ord"), s["values"].alias("values"))))["values"]
    names = F.sort_array(F.array_distinct(F.transform("said", lambda s: s["name"])))
    properties = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.when(n.isin(*UNITED), together(n)).otherwise(earliest(n)))))
    rows = _once(rows, *keys, "confidence", "different", evidence=shown, properties=properties)
    return rows.select(*keys, "confidence", F.size("different").cast("long").alias("n_evidence"), "evidence", F.get("evidence", F.lit(0))["path"].alias("evidence_file"), "properties")


def _merged(facts: DataFrame, keys: list[str], most: int) -> DataFrame:
    edges = facts.groupBy(*keys).agg(merge.highest(F.col("confidence")).alias("confidence"))
    out = with_evidence(edges, facts, keys, most).join(merged_properties(facts, keys), keys, "left")
    return out.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,array<string>>")))


def merge_relations(facts: DataFrame, most: int = KEPT) -> DataFrame:
    """One row per (src, type, dst) of facts (src, type, dst, ord, confidence, evidence, properties): evidence, merged properties, the highest confidence (null where none is given).

    Most edges have few facts, which meet in one shuffle; those of busy ones are spread.  Facts are counted first, and not written in between: tasks that read
    files take so many that the shuffle's writer spills all of them."""
    keys = ["src", "type", "dst"]
    few, busy = _dealt(facts.select(*keys, "ord", "confidence", "evidence", "properties"), keys)
    out = _folded(few, keys, most)
    return out if busy is None else out.unionByName(_merged(busy, keys, most))


def merge_entities(facts: DataFrame, most: int = KEPT) -> DataFrame:
    """One row per ref of facts (ref, ord, kind, title, description, tags, aliases, source_repos, attributes, glossary, confidence, evidence).

    First non-empty texts, united lists, domain attributes and glossary one per attribute and term, evidence, the highest confidence; lists are empty where there is nothing."""
    keys, lists, items = ["ref"], ("tags", "aliases", "source_repos"), {"attributes": "attribute", "glossary": "term"}
    out = facts.groupBy(*keys).agg(*(merge.first_of(F.col(c), F.col("ord")).alias(c) for c in ("kind", "title", "description")), merge.highest(F.col("confidence")).alias("confidence"))
    out = with_evidence(out, facts, keys, most).join(united(facts, keys, lists), keys, "left")
    for column, field in items.items():
        out = out.join(first_items(facts, keys, column, field), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(facts.schema[c].dataType)) for c in (*lists, *items)})


def queued(evidence: Column) -> Column:
    """The evidence that a queue shows of a fact."""
    return F.slice(evidence, 1, QUEUED)


def embedded(evidence: Column) -> Column:
    """The snippets of a fact's evidence for its embedding text, cut."""
    return F.transform(F.slice(evidence, 1, EMBEDDED), lambda e: F.substring(F.coalesce(e["snippet"], F.lit("")), 1, EMBEDDED_CHARS))

