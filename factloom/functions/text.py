"""Keys, labels and tags as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that say nothing of a name, broker markers, words that are no part of an API's key, comment marks.
SUFFIXES = ("serviceapi", "apiservice", "service", "api", "backend", "frontend", "client", "gateway")
BROKERS = {
    "rabbitmq": "RabbitMQ", "kafka": "Kafka", "activemq": "ActiveMQ", "nats": "NATS", "redisstreams": "Redis Streams", "kinesis": "Kinesis", "pubsub": "Pub/Sub",
    "servicebus": "Service Bus",
}
GENERIC_ENDPOINTS = (*BROKERS, "googlepubsub", "messagebroker", "broker", "queue", "topic")
HOST_ENDS = ("com", "net", "org", "io", "local", "cloud", "app", "dev", "co", "me", "us", "gslb", "svc", "ai", "google")
API_STOP = ("api", "apis", "rest", "http", "https", "openapi", "swagger", "resource", "resources", "service", "services", "contract", "and")
COMMENTS = ("//", "#", ";", "--", "/*", "*", "<!--", "%", "'", '"""', "rem ", "rem\t")
GENERIC_RESOURCE = ("database", "datastore", "data", "store", "mongodb", "mysql", "postgres", "redis")


def _col(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def squashed(value: Column | str) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]+", "")


def canonical_key(value: Column | str) -> Column:
    """Squashed name without its uninformative suffixes while three characters are left; null gives ''."""
    return F.regexp_replace(squashed(value), f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})+$", "$1")


def host_label(value: Column | str) -> Column:
    """First host label of a URL or host: scheme, path, port and domain are dropped."""
    bare = F.regexp_replace(F.lower(_col(value)), "^https?://", "")
    return F.regexp_extract(bare, "^([^/:.]*)", 1)


def host_key(value: Column | str) -> Column:
    return canonical_key(host_label(value))


def canonical_name(value: Column | str) -> Column:
    """A name fit for a reference: other characters become '-', runs are one; nothing left gives 'unknown'."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(_col(value)), "[^A-Za-z0-9_.-]+", "-"), "-+", "-")
    kept = F.regexp_replace(kept, "^-+|-+$", "")
    return F.when(kept == "", "unknown").otherwise(kept)


def domain_label(value: Column | str) -> Column:
    """A domain's label with spelling variants as one; '' where there is none."""
    words = F.trim(F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]+", " "))
    shop = (F.regexp_replace(words, " ", "") == "ecommerce") | words.startswith("e commerce ") | words.startswith("ecommerce ")
    return F.when(words == "", "").when(shop, "e-commerce").otherwise(canonical_name(F.regexp_replace(words, " ", "-")))


def api_key(value: Column | str) -> Column:
    """Words of an API's name that tell it from others, joined."""
    words = F.split(F.lower(_col(value)), "[^a-z0-9]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*API_STOP)), "")


def looks_like_url(value: Column | str) -> Column:
    """Whether a value has a scheme of letters, or is a host with one of the usual ends."""
    return F.trim(F.lower(_col(value))).rlike(rf"^[a-z]+://|^[a-z0-9][a-z0-9.-]*\.(?:{'|'.join(HOST_ENDS)})(?:[:/].*)?$")


def host_name(value: Column | str) -> Column:
    """The whole host of an address as a name; of a placeholder with a default that default's; '' where there is none."""
    raw = F.trim(_col(value))
    default = F.regexp_extract(raw, r"\$\{[^:}]+:([^}]+)\}", 1)
    raw = F.when(default != "", default).otherwise(raw)
    bare = F.regexp_replace(raw, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    return F.when(raw == "", "").otherwise(canonical_name(F.regexp_extract(bare, "^([^/:]*)", 1)))


def preferred_name(name: Column, host: Column, components: Column | None = None) -> Column:
    """The host's name in place of a generic store name, unless it is one of the `components` (an array of names)."""
    current = canonical_name(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown-resource")))
    label = host_name(host)
    taken = F.lit(False) if components is None else F.array_contains(components, label)
    generic = canonical_key(current).rlike("|".join(GENERIC_RESOURCE))
    return F.when(generic & (label != "") & ~taken, label).otherwise(current)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^a-z0-9:+-]+", "-"), "-+", "-"), "^-+|-+$", "")


def tag(value: Column | str) -> Column:
    """Normal form of a tag: lower case and '-' between words, before and after its first ':' apart; schedules keep their words apart by one space."""
    raw = F.regexp_replace(F.lower(_col(value)), r"^\s+|\s+$", "")
    kind, rest = slug(F.substring_index(raw, ":", 1)), F.regexp_replace(raw, "^[^:]*:", "")
    rest = F.when(kind == "schedule", F.trim(F.regexp_replace(rest, r"\s+", " "))).otherwise(slug(rest))
    return F.when(~raw.contains(":"), slug(raw)).when(rest == "", kind).otherwise(F.concat(kind, F.lit(":"), rest))


def broker(*values: Column) -> Column:
    """The broker that the first telling field names by a marker in its canonical key; null without one."""
    out = F.lit(None).cast("string")
    for value in reversed(values):
        for marker, name in reversed(BROKERS.items()):
            out = F.when(canonical_key(value).contains(marker), name).otherwise(out)
    return out


def is_generic_endpoint(value: Column | str) -> Column:
    """Whether an endpoint names a broker or a kind of endpoint only, so that meeting there says nothing."""
    return squashed(value).isin(*GENERIC_ENDPOINTS)


def ref_kind(ref: Column | str) -> Column:
    return F.regexp_extract(_col(ref), "^([^:]*):", 1)


def ref_name(ref: Column | str) -> Column:
    return F.regexp_replace(_col(ref), "^[^:]*:", "")


def edge_signature(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, kind, dst)


def short_repo(value: Column | str) -> Column:
    """The last part of a repository's id."""
    return F.regexp_extract(_col(value), "([^/]*)/*$", 1)


def source_location(value: Column | str) -> Column:
    """The address of the repository that an id's first two parts name; '' for fewer."""
    parts = F.filter(F.split(_col(value), "/"), lambda p: p != "")
    return F.when(F.size(parts) < 2, "").otherwise(F.concat(F.lit("https://github.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1))))


def evidence_url(repo: Column | str, path: Column, line: Column) -> Column:
    return F.concat(source_location(repo), F.lit("/blob/main/"), path, F.lit("#L"), line.cast("string"))


def record_name(repo_id: Column, name: Column) -> Column:
    """The name of a repository's record: its id without the organisation, '__' between parts, or else its name."""
    inner = F.regexp_replace(F.regexp_replace(_col(repo_id), "^[^/]*/", ""), "/", "__")
    return F.when(_col(repo_id) == "", _col(name)).otherwise(inner)


def owner_name(value: Column | str) -> Column:
    """An owner without its namespace and kind."""
    return F.regexp_replace(F.regexp_replace(_col(value), "^[^/]*/", ""), "^[^:]*:", "")


def endpoint(name: Column, subscribes_to: Column | None = None) -> Column:
    """The endpoint that a resource stands for: what it subscribes to, or the shared topic behind a consumer's own queue."""
    topic = F.regexp_extract(name, r"^Consumer\..*?\.VirtualTopic\.(.*)$", 1)
    own = F.when(topic != "", F.concat(F.lit("VirtualTopic."), topic)).otherwise(name)
    return own if subscribes_to is None else F.coalesce(F.nullif(subscribes_to, F.lit("")), own)


def transport(protocol: Column, technology: Column, ref: Column) -> Column:
    """A relation's protocol unless unknown, its end's technology, or the kind of its end."""
    told = F.when(protocol != "unknown", F.nullif(protocol, F.lit("")))
    return F.coalesce(told, F.nullif(technology, F.lit("")), F.nullif(F.lower(ref_kind(ref)), F.lit("")), F.lit("unknown"))


#: Words of a query that bring in others: (what a term must be, the words it brings).
_MESSAGING = {"message", "messages", "queue", "queues", "topic", "topics", "broker", "brokers"}
RELATED = (
    (re.compile("async.*"), {"async", "asynchronous", "asynchronously", "message", "messages", "queue", "broker"}),
    (re.compile("|".join(sorted(_MESSAGING))), (_MESSAGING - {"brokers"}) | {"publish", "consume", "broker"}),
)


def search_terms(query: str) -> list[str]:
    """Terms of a query: three characters or more, lower-cased, sorted, with the words of messaging for one another."""
    own = {m.lower() for m in re.findall(r"[A-Za-z0-9_-]{3,}", query)}
    return sorted(own.union(*(more for told, more in RELATED if any(map(told.fullmatch, own)))))


def line_shape(value: Column | str) -> Column:
    """blank, comment or code."""
    bare = F.lower(F.ltrim(_col(value)))
    comment = F.lit(False)
    for mark in COMMENTS:
        comment = comment | bare.startswith(mark)
    return F.when(F.trim(bare) == "", "blank").when(comment, "comment").otherwise("code")


def squeezed(value: Column | str) -> Column:
    """Lower case with single spaces: how snippets and lines are compared."""
    # single spaces, the most of white space, stay where they are
    return F.trim(F.regexp_replace(F.lower(_col(value)), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; 0 where one is empty or zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x)))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))
