"""Operator 1: secret scans in SQL functions alone.

Three base patterns give spans of whole matches.  The method adds entropy spans:
over each candidate string (a long run of token characters) a window of WINDOW
characters slides, whose Shannon entropy per character class is kept up by
incremental counts (one character enters, one leaves); a string with a window at or
above its class's threshold is a span, unless an allow-list suppresses it.  A
candidate that touches a base span is no entropy span; what of it lies outside the
base spans is judged by itself and gives spans of kind "rest".
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of ties, and their patterns.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy", "rest")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of a window, and bits a character from which a string of a class is a secret.
WINDOW = 20
#: Characters of a block of text, from which redaction takes what stays.
TEXT_BLOCK = 4096
BITS = {"hex": 3.0, "upper": 3.4, "mixed": 3.8}
#: Strings that are never entropy spans: words and identifiers of letters alone, digits alone, paths, UUIDs, dashes and rules; and
#: examples by name, where too little else is left for a window on either side of the name.
ALLOWED = (
    r"^[A-Za-z_=+/-]+$",
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?(?:[a-z][a-z_-]*+/)++[a-z_-]*[0-9]{0,4}/?$",
    r"^(?:sha(?:1|256|512)|md5)-",
    r"(?i)^(?:.{0,18}[/+=_-])?(?:example|placeholder|dummy)(?:[/+=_-].{0,18})?$",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def swept(items: Column, zero: Column, state: Callable[[Column, Column], Column], emitted: Callable[[Column, Column], Column], none: Column) -> Column:
    """What `emitted(state, item)` gives for each item, in one array, while `state(state, item)` moves on from `zero`.

    Arrays can only grow by being copied, so the items go through in about sqrt(n) runs of sqrt(n).
    """

    def through(found: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(found))).cast("int"), F.lit(1))
        runs = let(size, lambda n: F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / n).cast("int")), lambda k: F.slice(found, k * n + 1, n)))
        step = lambda acc, x: F.struct(state(acc["state"], x).alias("state"), F.concat(acc["out"], emitted(acc["state"], x)).alias("out"))

        def run(acc: Column, part: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), none.alias("out"))
            return F.aggregate(part, begin, step, lambda own: F.struct(own["state"].alias("state"), F.concat(acc["out"], own["out"]).alias("out")))

        return F.aggregate(runs, F.struct(zero.alias("state"), none.alias("out")), run, lambda acc: acc["out"])

    return let(items, lambda found: F.when(F.size(found) > 0, through(found)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, word>> of the leftmost non-overlapping matches, in code points from 0: what lies between them gives their starts."""
    gaps = lambda n: F.transform(F.slice(F.split(text, pattern, -1), 1, n), F.length)
    zipped = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.arrays_zip(gaps(F.size(found)).alias("gap"), found.alias("word")))
    found = lambda at, x: F.array(F.struct((at + x["gap"]).alias("start"), x["word"].alias("word")))
    return swept(zipped, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["word"]), found, F.array().cast("array<struct<start:int,word:string>>"))


def spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + F.length(x["word"])).alias("end"), F.lit(kind).alias("kind")))


def class_of(word: Column) -> Column:
    """The character class whose alphabet a string keeps to."""
    return F.when(word.rlike("^[0-9a-f]+$") | word.rlike("^[0-9A-F]+$"), "hex").when(word.rlike("^[0-9A-Z_=+/-]+$") | word.rlike("^[0-9a-z_=+/-]+$"), "upper").otherwise("mixed")


#: Change of the sum of n * log2(n) when n becomes n + 1, by n.
_GAIN = [(n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)]


def highest_entropy(word: Column, enough: Column | None = None) -> Column:
    """Highest Shannon entropy, in bits a character, of any WINDOW consecutive characters; once `enough` is reached, no more are looked at.

    The state holds the window's characters and the sum of n * log2(n) over their counts; a step changes the two counts that
    a shift changes, so it costs the same wherever it is.  Entropy is log2(WINDOW) - sum / WINDOW.
    """
    # split leaves an empty string at the end
    codes = F.transform(F.slice(F.split(word, "(?!^)"), 1, F.length(word)), F.ascii)
    gain = lambda n: F.get(F.lit(_GAIN), n)
    # a hair below, as the sum is made of rounded terms
    target = F.lit(-1.0) if enough is None else (math.log2(WINDOW) - enough) * WINDOW - 1e-6
    begin = F.struct(F.array().cast("array<int>").alias("window"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), target.alias("target"))
    full = lambda acc: F.size(acc["window"]) == WINDOW
    least = lambda acc: F.when(full(acc), F.least(acc["least"], acc["sum"])).otherwise(acc["least"])
    count = lambda window, c: F.size(F.filter(window, lambda w: w == c))

    def shifted(acc: Column, c: Column) -> Column:
        window = F.when(full(acc), F.slice(acc["window"], 2, WINDOW - 1)).otherwise(acc["window"])
        left = F.when(full(acc), acc["sum"] - gain(count(acc["window"], F.get(acc["window"], F.lit(0))) - 1)).otherwise(acc["sum"])
        entered = lambda rest: F.struct(F.concat(rest, F.array(c)).alias("window"), (left + gain(count(rest, c))).alias("sum"), least(acc).alias("least"), acc["target"].alias("target"))
        return let(window, entered)

    step = lambda acc, c: F.when(least(acc) <= acc["target"], acc).otherwise(shifted(acc, c))
    return F.aggregate(codes, begin, step, lambda acc: F.log2(F.lit(float(WINDOW))) - least(acc) / WINDOW)


def allowed(word: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | word.rlike(pattern)
    return out


def pieces(base: Column, longer: Column) -> Column:
    """array<struct<start, word, whole>>: what the base spans leave of the candidates, WINDOW characters at least; whole where they leave all.

    Spans and candidates go by in order of their starts; the state is the candidate that is open and how far it is done.
    """
    one = lambda x, kind, end, word: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), word.alias("word"))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(1).alias("kind"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("word")))
    of_base = F.transform(base, lambda x: one(x, 0, x["end"], F.lit("")))
    of_longer = F.transform(longer, lambda x: one(x, 1, x["start"] + F.length(x["word"]), x["word"]))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("word"))
    none = F.array().cast("array<struct<start:int,word:string,whole:boolean>>")

    def state(acc: Column, x: Column) -> Column:
        opens = x["kind"] == 1
        kept = lambda name: F.when(opens, x[name]).otherwise(acc[name]).alias(name)
        return F.struct(F.greatest(acc["at"], F.when(opens, x["start"]).otherwise(x["end"])).alias("at"), kept("start"), kept("end"), kept("word"))

    def emitted(acc: Column, x: Column) -> Column:
        to = F.when(x["kind"] == 1, acc["end"]).otherwise(F.least(x["start"], acc["end"]))
        piece = F.struct(acc["at"].alias("start"), F.substring(acc["word"], acc["at"] - acc["start"] + 1, to - acc["at"]).alias("word"), ((acc["at"] == acc["start"]) & (to == acc["end"])).alias("whole"))
        return F.when(to - acc["at"] >= WINDOW, F.array(piece)).otherwise(none)

    return swept(F.array_sort(F.concat(of_base, of_longer, last)), begin, state, emitted, none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (all columns of the input) and spans: array<struct<start, order, end, kind>> by start, then kind.

    One row per input row; null texts are empty.
    Only texts that hold a match are looked at beyond a first test; repeated rows and ids are scanned each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.struct("*").alias("row"))
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,word:string>>")
    assign = F.when(text.rlike(ASSIGN), F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["word"], ASSIGN, 2)) >= 6)).otherwise(none)
    access = F.when(text.contains("AKIA"), F.filter(matches(text, ACCESS), lambda x: F.length(x["word"]) >= 20)).otherwise(none)
    hexes = F.when(text.rlike(HEX[:-1] + "{24}"), matches(text, HEX[:-1] + "{24,}")).otherwise(none)
    longer = F.when(text.rlike(CANDIDATE), matches(text, CANDIDATE)).otherwise(none)
    base = docs.select("doc_id", "text", "row", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), longer.alias("longer"))
    base = base.withColumn("base", F.array_sort(F.concat(spans(F.col("assign"), "assign"), spans(F.col("access"), "access"), spans(F.col("hex"), "hex"))))
    limit = F.create_map(*(F.lit(x) for pair in BITS.items() for x in pair))
    strong = lambda x: ~allowed(x["word"]) & let(limit[class_of(x["word"])], lambda bits: highest_entropy(x["word"], bits) >= bits)
    left = F.when(F.size("longer") > 0, F.filter(pieces(F.col("base"), F.col("longer")), strong)).otherwise(F.array().cast("array<struct<start:int,word:string,whole:boolean>>"))
    base = base.withColumn("left", left)
    whole, rest = F.filter("left", lambda x: x["whole"]), F.filter("left", lambda x: ~x["whole"])
    return base.select("doc_id", "text", "row", F.array_sort(F.concat("base", spans(whole, "entropy"), spans(rest, "rest"))).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and all spans as text: base ones, strings of high entropy and what of them stands beside base spans."""
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with every span of the text (overlapping ones as one) replaced by `mark`; other texts stay, null ones are empty.

    Parts of a text are taken from blocks of it, as a substring of the whole would be counted from the start each time.
    """
    found = scan(docs)
    none = F.array().cast("array<struct<start:int,end:int>>")
    gap = lambda at, to: F.array(F.struct(at.alias("start"), to.alias("end")))
    gaps = swept(F.col("spans"), F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at, gap(at, s["start"])).otherwise(none), none)
    every = F.concat(gaps, gap(F.array_max(F.transform("spans", lambda s: s["end"])), F.length("text")))

    def part(blocks: Column, g: Column) -> Column:
        first = (g["start"] / TEXT_BLOCK).cast("int")
        own = F.slice(blocks, first + 1, ((g["end"] - 1) / TEXT_BLOCK).cast("int") - first + 1)
        return F.when(g["end"] > g["start"], F.substring(F.array_join(own, ""), g["start"] - first * TEXT_BLOCK + 1, g["end"] - g["start"])).otherwise(F.lit(""))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    cut = let(blocks, lambda b: F.array_join(F.transform(every, lambda g: part(b, g)), mark))
    clean = F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
