"""Catalog queries: scalar functions, merges, lookups and facets over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import merge, resolve
from factloom.plans.binding import documents, entities, facts, table, with_ctes
from factloom.plans.registry import query

_CANON = r"regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g'), '^(.{{3,}}?)(?:serviceapi|apiservice|service|api|backend|frontend|client|gateway)+$', '\1')"
_SLUG = "regexp_replace(regexp_replace(regexp_replace({0}, '[^a-z0-9:+-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
_KIND, _REST = _SLUG.format("split_part({0}, ':', 1)"), "substr({0}, strpos({0}, ':') + 1)"
_VALUE = f"CASE WHEN {_KIND} = 'schedule' THEN trim(regexp_replace({_REST}, '\\s+', ' ', 'g')) ELSE {_SLUG.format(_REST)} END"
_TAG = f"CASE WHEN NOT contains({{0}}, ':') THEN {_SLUG} WHEN {_VALUE} = '' THEN {_KIND} ELSE {_KIND} || ':' || {_VALUE} END"
_RAW_TAG = """CASE p_size % 7 WHEN 0 THEN concat(' Schedule: 0  ', p_size, ' * *') WHEN 1 THEN 'Lang: Node.js ' WHEN 2 THEN 'C#' WHEN 3 THEN upper(p_type) WHEN 4 THEN replace(p_type, ' ', '_/')
    WHEN 5 THEN concat(p_type, ':') ELSE p_type END"""
_NAME = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[^A-Za-z0-9_.-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


@query("canonical_key", f"SELECT c_custkey, {_CANON.format('''c_name || ' ' || c_mktsegment || ' Service API' ''')} AS key FROM customer")
def canonical_key(spark, sf_dir):
    name = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" Service API "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.canonical_key(name).alias("key"))


_HOST_LIKE = r"regexp_matches(trim(lower({0})), '^[a-z]+://|^[a-z0-9][a-z0-9.-]*\.(com|net|org|io|local|cloud|app|dev|co|me|us|gslb|svc|ai|google)([:/].*)?$')"
_ADDRESS = "CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') WHEN page_id % 7 = 1 THEN 'app.config.value' ELSE url END"


@query("host_key", rf"SELECT page_id, {_CANON.format('''regexp_extract(regexp_replace(lower(u), '^https?://', ''), '^([^/:.]*)', 1)''')} AS key, {_HOST_LIKE.format('u')} AS is_url FROM (SELECT page_id, {_ADDRESS} AS u FROM pages)")
def host_key(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_ADDRESS).alias("u"))
    return rows.select("page_id", text.host_key("u").alias("key"), text.looks_like_url("u").alias("is_url"))


@query("slug_name", f"SELECT p_partkey, {_NAME.format('''p_name || ' /' || p_type || '- ' ''')} AS slug FROM part")
def slug_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_name(F.concat("p_name", F.lit(" /"), "p_type", F.lit("- "))).alias("slug"))


@query("domain_label", f"""SELECT n_nationkey, CASE WHEN w = '' THEN '' WHEN replace(w, ' ', '') = 'ecommerce' OR starts_with(w, 'e commerce ') OR starts_with(w, 'ecommerce ') THEN 'e-commerce'
    ELSE {_NAME.format("replace(w, ' ', '-')")} END AS label FROM (SELECT n_nationkey, trim(regexp_replace(lower(CASE WHEN n_nationkey % 5 = 0 THEN 'E_Commerce ' ELSE '' END || n_name || ' / Core'), '[^a-z0-9]+', ' ', 'g')) AS w FROM nation)""")
def domain_label(spark, sf_dir):
    name = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "E_Commerce ").otherwise(""), "n_name", F.lit(" / Core"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.domain_label(name).alias("label"))


@query("api_key", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_name || ' REST api and ' || p_type), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('api','apis','rest','http','https','openapi','swagger','resource','resources','service','services','contract','and')), '') AS key FROM part")
def api_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.api_key(F.concat("p_name", F.lit(" REST api and "), "p_type")).alias("key"))


@query("tag_normalize", f"SELECT tag, {_TAG.format('trim(lower(tag))')} AS normal, count(*) AS n FROM (SELECT {_RAW_TAG} AS tag FROM part) GROUP BY tag")
def tag_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.expr(_RAW_TAG).alias("tag")).agg(F.count("*").alias("n")).select("tag", text.tag("tag").alias("normal"), "n")


@query("tag_inventory", "SELECT p_type AS tag, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands, array_to_string(list_slice(list_sort(list(p_partkey)), 1, 5), ',') AS samples FROM part GROUP BY p_type")
def tag_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("tag"), "p_brand", "p_partkey")
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("p_partkey"))
    first = rows.where("p_partkey is not null").select("tag", "p_partkey", F.pmod(F.xxhash64("p_partkey"), F.lit(64)).alias("salt"))
    first = first.withColumn("n", least("tag", "salt")).where("n <= 5").withColumn("n", least("tag")).where("n <= 5")
    samples = F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("samples")
    first = first.groupBy(F.col("tag").alias("of")).agg(samples)
    every = rows.groupBy("tag").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))
    return every.join(first, F.expr("tag <=> of"), "left").select("tag", "n", "brands", F.coalesce("samples", F.lit("")).alias("samples"))


@query("spelling_groups", f"SELECT normal, count(*) AS n_raw FROM (SELECT DISTINCT raw, {_TAG.format('trim(lower(raw))')} AS normal FROM (SELECT {_RAW_TAG} AS raw FROM part)) GROUP BY normal HAVING count(*) > 1 OR max(raw) <> normal")
def spelling_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(_RAW_TAG).alias("raw")).distinct().select("raw", text.tag("raw").alias("normal"))
    return rows.groupBy("normal").agg(F.count("*").alias("n_raw"), F.max("raw").alias("m")).where("n_raw > 1 or m <> normal").drop("m")


@query("line_shape", r"""SELECT page_id, count(*) FILTER (WHERE s = 'blank') AS n_blank, count(*) FILTER (WHERE s = 'comment') AS n_comment, count(*) FILTER (WHERE s = 'code') AS n_code FROM
    (SELECT page_id, CASE WHEN trim(l) = '' THEN 'blank' WHEN regexp_matches(lower(ltrim(l)), '^(//|#|;|--|/\*|\*|<!--|%|''|"{3}|rem |rem\t)') THEN 'comment' ELSE 'code' END AS s
    FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l FROM pages)) GROUP BY page_id""")
def line_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("l")).select("page_id", text.line_shape("l").alias("s"))
    return rows.groupBy("page_id").agg(*(F.count_if(F.col("s") == k).alias(f"n_{k}") for k in ("blank", "comment", "code")))


@query("summary_counts", with_ctes("SELECT kind, count(*) AS n FROM entities GROUP BY kind", "entities"))
def summary_counts(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("list_entities", with_ctes("SELECT ref, name, owner FROM entities WHERE kind = 'Component' ORDER BY pos LIMIT 50", "entities"))
def list_entities(spark, sf_dir):
    return entities(spark, sf_dir).where("kind = 'Component'").orderBy("pos").limit(50).select("ref", "name", "owner")


@query("describe", with_ctes("SELECT ref, kind, name, owner, coalesce(confidence, 'review') AS confidence FROM entities WHERE ref IN ('component:7', 'system:3')", "entities"))
def describe(spark, sf_dir):
    return entities(spark, sf_dir).where("ref in ('component:7', 'system:3')").select("ref", "kind", "name", "owner", F.coalesce("confidence", F.lit("review")).alias("confidence"))


@query("entities_filter", with_ctes("SELECT ref, kind, confidence FROM entities WHERE kind IN ('Component', 'Resource') AND confidence IN ('high', 'medium') AND (contains(lower(name), '1') OR contains(lower(owner), '1'))", "entities"))
def entities_filter(spark, sf_dir):
    rows = entities(spark, sf_dir).where(F.col("kind").isin("Component", "Resource") & F.col("confidence").isin("high", "medium"))
    return rows.where(F.lower("name").contains("1") | F.lower("owner").contains("1")).select("ref", "kind", "confidence")


@query("facets", with_ctes("""SELECT facet, value, count(*) AS n FROM (SELECT 'kind' AS facet, kind AS value FROM entities UNION ALL SELECT 'owner', owner FROM entities UNION ALL SELECT 'tag', tag FROM entities
    UNION ALL SELECT 'confidence', confidence FROM entities) WHERE value <> '' AND value <> 'unknown' GROUP BY facet, value""", "entities"))
def facets(spark, sf_dir):
    return resolve.facets(entities(spark, sf_dir), ["kind", "owner", "tag", "confidence"])


@query("entity_merge", """SELECT ref, min_by(owner, ord) FILTER (WHERE owner <> '') AS owner, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags,
    CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence, count(*) AS n_facts
    FROM (SELECT concat('provider:', o_custkey) AS ref, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('owner-', o_orderkey % 7) END AS owner, o_orderpriority AS tag,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'review' END AS confidence, o_orderkey AS ord FROM orders) GROUP BY ref""")
def entity_merge(spark, sf_dir):
    from factloom.plans.binding import PRIORITY

    owner = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('owner-', o_orderkey % 7) END")
    rows = table(spark, sf_dir, "orders").select(
        F.expr("concat('provider:', o_custkey)").alias("ref"), F.lit("Provider").alias("kind"), F.lit("").alias("name"), owner.alias("owner"), F.lit("").alias("description"),
        F.col("o_orderpriority").alias("tag"), F.expr(PRIORITY).alias("confidence"), F.col("o_orderkey").alias("ord"),
    )
    return merge.merge_entities(rows).select("ref", "owner", F.array_join("tags", ",").alias("tags"), "confidence", "n_facts")


@query("relation_merge", with_ctes("SELECT src, type, dst, n_evidence, first_evidence, confidence, protocol FROM relations", "facts", "relations"))
def relation_merge(spark, sf_dir):
    first = (F.col("evidence.path") * 10 + F.col("evidence.line")).alias("first_evidence")
    return merge.merge_relations(facts(spark, sf_dir)).select("src", "type", "dst", "n_evidence", first, "confidence", "protocol")


@query("evidence_required", with_ctes("SELECT type, count(*) AS n FROM (SELECT type, confidence, CASE WHEN first_evidence % 2 = 0 THEN 0 ELSE n_evidence END AS n_evidence FROM relations) WHERE NOT (confidence = 'high' AND n_evidence = 0) GROUP BY type", "facts", "relations"))
def evidence_required(spark, sf_dir):
    rows = relation_merge(spark, sf_dir).withColumn("n_evidence", F.when(F.col("first_evidence") % 2 == 0, 0).otherwise(F.col("n_evidence")))
    return merge.require_evidence(rows).groupBy("type").agg(F.count("*").alias("n"))


@query("evidence_lookup", with_ctes("SELECT path, line, confidence FROM facts WHERE src = 'component:3' AND type = 'producesMessage'", "facts"))
def evidence_lookup(spark, sf_dir):
    return facts(spark, sf_dir).where("src = 'component:3' and type = 'producesMessage'").select("path", "line", "confidence")


_ALIASES = "SELECT concat('provider:', c_custkey) AS ref, lower(c_mktsegment) AS key, c_custkey % 3 AS priority FROM customer UNION ALL SELECT concat('component:', s_suppkey), concat('nation-', s_nationkey), s_suppkey % 4 FROM supplier UNION ALL SELECT concat('provider:', c_custkey), concat('nation-', c_nationkey), c_custkey % 2 FROM customer"
_INDEX = f"SELECT key, kind, arg_max(e.ref, priority * 1000000000000 - pos) AS ref FROM ({_ALIASES}) a JOIN entities e ON a.ref = e.ref WHERE key <> '' GROUP BY key, kind"


def _aliases(spark, sf_dir):
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    ref = F.expr("concat('provider:', c_custkey)").alias("ref")
    return (
        customers.select(ref, F.lower("c_mktsegment").alias("key"), F.expr("c_custkey % 3").alias("priority"))
        .unionByName(suppliers.select(F.expr("concat('component:', s_suppkey)").alias("ref"), F.expr("concat('nation-', s_nationkey)").alias("key"), F.expr("s_suppkey % 4").alias("priority")))
        .unionByName(customers.select(ref, F.expr("concat('nation-', c_nationkey)").alias("key"), F.expr("c_custkey % 2").alias("priority")))
    )


@query("alias_index", with_ctes(_INDEX, "entities"))
def alias_index(spark, sf_dir):
    return merge.alias_index(entities(spark, sf_dir), _aliases(spark, sf_dir))


@query("alias_resolve", with_ctes(f"SELECT n_nationkey, r.ref AS resolved FROM nation LEFT JOIN (SELECT key, arg_min(ref, CASE kind WHEN 'Component' THEN 1 ELSE 2 END) AS ref FROM ({_INDEX}) WHERE kind IN ('Component', 'Provider') GROUP BY key) r ON r.key = concat('nation-', n_nationkey * 2)", "entities"))
def alias_resolve(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("concat('nation-', n_nationkey * 2)").alias("key"))
    return merge.resolve(wanted, alias_index(spark, sf_dir), ["Component", "Provider"]).select("n_nationkey", "resolved")


@query("unresolved_anti", with_ctes(f"SELECT n_nationkey FROM nation WHERE concat('nation-', n_nationkey * 2) NOT IN (SELECT key FROM ({_INDEX}))", "entities"))
def unresolved_anti(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("concat('nation-', n_nationkey * 2)").alias("key"))
    return wanted.join(alias_index(spark, sf_dir), "key", "left_anti").select("n_nationkey")


@query("merge_candidates", "SELECT concat('ext:', s_suppkey) AS ref, count(DISTINCT c_custkey) AS n_matches, CASE WHEN count(DISTINCT c_custkey) = 1 THEN min(concat('provider:', c_custkey)) END AS \"into\" FROM supplier JOIN customer ON s_suppkey % 50 = c_custkey % 997 AND s_acctbal < 0 GROUP BY s_suppkey")
def merge_candidates(spark, sf_dir):
    external = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.expr("concat('ext:', s_suppkey)").alias("ref"), F.expr("s_suppkey % 50").alias("key"))
    real = table(spark, sf_dir, "customer").select(F.expr("concat('provider:', c_custkey)").alias("ref"), F.expr("c_custkey % 997").alias("key"))
    return merge.merge_candidates(external, real)


_FUZZY = """SELECT ref, CASE WHEN lower(name) = {0} THEN 2 ELSE 3 END AS tier FROM entities WHERE contains(lower(name), {0})
    ORDER BY tier, CASE kind WHEN 'Component' THEN 0 WHEN 'Provider' THEN 1 WHEN 'Resource' THEN 2 WHEN 'System' THEN 4 ELSE 5 END, CASE WHEN lower(name) = {0} THEN 0 ELSE length(name) END, pos LIMIT 1"""


@query("fuzzy_lookup", with_ctes(_FUZZY.format("'01'"), "entities"))
def fuzzy_lookup(spark, sf_dir):
    return resolve.fuzzy(entities(spark, sf_dir).withColumn("aliases", F.array("owner")), "01")


@query("owners", with_ctes("SELECT kind, count(*) AS n, count(*) FILTER (WHERE owner = 'unknown') AS n_unknown FROM entities GROUP BY kind", "entities"))
def owners(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("owner") == "unknown").alias("n_unknown"))


@query("glossary_lookup", """SELECT conv_id, turn, CASE WHEN lower(role) = 'system' THEN 3 WHEN contains(lower(role), 'us') THEN 2 ELSE 1 END AS score FROM conversations
    WHERE contains(lower(concat(role, ' ', text)), 'the') ORDER BY score DESC, conv_id, turn LIMIT 20""")
def glossary_lookup(spark, sf_dir):
    score = F.when(F.lower("role") == "system", 3).when(F.lower("role").contains("us"), 2).otherwise(1)
    rows = table(spark, sf_dir, "conversations").where(F.lower(F.concat("role", F.lit(" "), "text")).contains("the"))
    return rows.select("conv_id", "turn", score.alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(20)


@query("haystack_lengths", with_ctes("SELECT ref, length(haystack) AS n FROM docs", "docs"))
def haystack_lengths(spark, sf_dir):
    return documents(spark, sf_dir).select("ref", F.length("haystack").cast("long").alias("n"))
