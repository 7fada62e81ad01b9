"""Graph queries, derivation rules and search over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import derive, graph, merge, search
from factloom.plans.binding import depends, documents, entities, facts, table, with_ctes
from factloom.plans.registry import query


def relations(spark, sf_dir):
    return merge.merge_relations(facts(spark, sf_dir))


@query("degree", with_ctes("SELECT ref, count(*) AS degree FROM (SELECT src AS ref FROM relations UNION ALL SELECT dst FROM relations) GROUP BY ref", "facts", "relations"))
def degree(spark, sf_dir):
    return graph.degrees(relations(spark, sf_dir))


@query("inbound_counts", with_ctes("SELECT dst AS ref, count(*) AS inbound FROM relations GROUP BY dst", "facts", "relations"))
def inbound_counts(spark, sf_dir):
    return relations(spark, sf_dir).groupBy(F.col("dst").alias("ref")).agg(F.count("*").alias("inbound"))


@query("endpoint_types", with_ctes("SELECT dst AS ref, count(*) FILTER (WHERE type = 'readsResource') AS reads, count(*) FILTER (WHERE type = 'writesResource') AS writes FROM relations GROUP BY dst", "facts", "relations"))
def endpoint_types(spark, sf_dir):
    return relations(spark, sf_dir).groupBy(F.col("dst").alias("ref")).agg(F.count_if(F.col("type") == "readsResource").alias("reads"), F.count_if(F.col("type") == "writesResource").alias("writes"))


def _start(spark, ref):
    return spark.createDataFrame([(ref,)], "ref string")


_OUT = "SELECT src, type, dst, 'out' AS way, 1 AS depth FROM relations WHERE src = 'component:1'"


@query("neighbors_out", with_ctes(_OUT, "facts", "relations"))
def neighbors_out(spark, sf_dir):
    return graph.neighbors(relations(spark, sf_dir), _start(spark, "component:1"))


@query("neighbors_in", with_ctes("SELECT src, type, dst, 'in' AS way, 1 AS depth FROM relations WHERE dst = 'resource:5' AND confidence IN ('medium', 'high')", "facts", "relations"))
def neighbors_in(spark, sf_dir):
    return graph.neighbors(relations(spark, sf_dir), _start(spark, "resource:5"), "in", least="medium")


_BOTH = f"""{_OUT} UNION ALL SELECT r.src, r.type, r.dst, 'in', 2 FROM relations r JOIN (SELECT DISTINCT dst FROM relations WHERE src = 'component:1') f ON r.dst = f.dst"""


@query("neighbors_both_d2", with_ctes(_BOTH, "facts", "relations"))
def neighbors_both_d2(spark, sf_dir):
    return graph.neighbors(relations(spark, sf_dir), _start(spark, "component:1"), "both", 2)


@query("ego_graph", with_ctes(f"""SELECT ref, count(*) AS degree, ref = 'component:1' AS is_center FROM (SELECT unnest([src, dst]) AS ref FROM (SELECT DISTINCT src, type, dst FROM ({_BOTH}))) GROUP BY ref""", "facts", "relations"))
def ego_graph(spark, sf_dir):
    return graph.ego(relations(spark, sf_dir), _start(spark, "component:1"), 2)


@query("trace_paths", with_ctes("""SELECT path, type, depth FROM (
    SELECT concat(a.src, '>', a.dst) AS path, a.type, 1 AS depth FROM e a WHERE a.src = 'component:1'
    UNION ALL SELECT concat(a.src, '>', a.dst, '>', b.dst), b.type, 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 'component:1' AND b.dst <> a.src
    UNION ALL SELECT concat(a.src, '>', a.dst, '>', b.dst, '>', c.dst), c.type, 3 FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src = 'component:1' AND b.dst <> a.src AND c.dst NOT IN (a.src, a.dst))""", "facts", "relations").replace(
    " SELECT path, type, depth FROM (", """, both_ways AS (SELECT src, type, dst FROM relations UNION SELECT dst, 'usedBy', src FROM relations),
    e AS (SELECT src, type, dst FROM (SELECT *, row_number() OVER (PARTITION BY src, type ORDER BY dst) AS n FROM both_ways) WHERE n <= 3) SELECT path, type, depth FROM (""", 1))
def trace_paths(spark, sf_dir):
    edges = relations(spark, sf_dir).select("src", "type", "dst", "confidence")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.lit("usedBy").alias("type"), F.col("src").alias("dst"), "confidence"))
    return graph.trace(both, _start(spark, "component:1"), hops=3, fanout=3)


@query("balanced_topk", with_ctes("""SELECT ref, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, ref) AS rn FROM (SELECT ref, kind, length(name) + pos % 7 AS score FROM entities))
    ORDER BY CASE WHEN rn <= 12 THEN 0 ELSE 1 END, score DESC, ref LIMIT 60""", "entities"))
def balanced_topk(spark, sf_dir):
    nodes = entities(spark, sf_dir).select("ref", "kind", (F.length("name") + F.col("pos") % 7).alias("score"))
    return graph.balanced_top(nodes, 60, 5)


_TOP = "SELECT ref, degree FROM (SELECT ref, count(*) AS degree FROM (SELECT src AS ref FROM relations UNION ALL SELECT dst FROM relations) GROUP BY ref) ORDER BY row_number() OVER (PARTITION BY split_part(ref, ':', 1) ORDER BY degree DESC, ref) > 20, degree DESC, ref LIMIT 40"


@query("graph_overview", with_ctes(f"SELECT src, type, dst FROM relations WHERE src IN (SELECT ref FROM ({_TOP})) AND dst IN (SELECT ref FROM ({_TOP}))", "facts", "relations"))
def graph_overview(spark, sf_dir):
    edges = relations(spark, sf_dir)
    nodes = graph.degrees(edges).select("ref", F.substring_index("ref", ":", 1).alias("kind"), F.col("degree").alias("score"))
    top = graph.balanced_top(nodes, 40, 2).select("ref")
    return merge.without_dangling(edges, F.broadcast(top)).select("src", "type", "dst")


_FLOW = """SELECT w.src, r.src AS dst, count(DISTINCT w.dst) AS n_via, sum(w.n_evidence + r.n_evidence)::BIGINT AS n_evidence,
    CASE min(least(CASE w.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, CASE r.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence,
    '{2}' AS mechanism FROM relations w JOIN relations r ON w.dst = r.dst AND w.type = '{0}' AND r.type = '{1}' AND w.src <> r.src GROUP BY w.src, r.src"""
_SHARED, _MESSAGES = _FLOW.format("writesResource", "readsResource", "shared_resource"), _FLOW.format("producesMessage", "consumesMessage", "message")
_SHARED = f"SELECT * REPLACE ('low' AS confidence) FROM ({_SHARED})"


@query("api_flow", with_ctes(f"SELECT * FROM ({_FLOW.format('readsResource', 'writesResource', 'api')})", "facts", "relations"))
def api_flow(spark, sf_dir):
    """Readers as consumers and writers as providers of an API."""
    edges = relations(spark, sf_dir).where("type in ('readsResource', 'writesResource')")
    return derive.api_calls(edges.withColumn("type", F.when(F.col("type") == "readsResource", "consumesApi").otherwise("providesApi")))


@query("shared_resource_flow", with_ctes(_SHARED, "facts", "relations"))
def shared_resource_flow(spark, sf_dir):
    return derive.shared_resources(relations(spark, sf_dir))


@query("broker_rendezvous", with_ctes(f"SELECT * FROM ({_MESSAGES.replace('AND w.src <> r.src', '''AND w.src <> r.src AND w.dst NOT IN ('resource:1', 'resource:2', 'resource:3')''')})", "facts", "relations"))
def broker_rendezvous(spark, sf_dir):
    ignore = spark.createDataFrame([("resource:1",), ("resource:2",), ("resource:3",)], "dst string")
    return derive.messages(relations(spark, sf_dir), F.broadcast(ignore))


@query("communication_merge", with_ctes(f"""SELECT src, dst, array_to_string(list_sort(list(DISTINCT mechanism)), ',') AS mechanisms, sum(n_evidence)::BIGINT AS n_evidence,
    CASE min(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence
    FROM ({_SHARED} UNION ALL {_MESSAGES}) GROUP BY src, dst""", "facts", "relations"))
def communication_merge(spark, sf_dir):
    edges = relations(spark, sf_dir)
    return derive.merge_flows(derive.shared_resources(edges), derive.messages(edges))


@query("api_collapse", "SELECT concat(p_brand, p_partkey % 997) AS provider, count(*) AS n_apis, sum(p_size % 5)::BIGINT AS n_operations FROM part GROUP BY 1 HAVING count(*) >= 2 AND max(p_size % 5) <= 2")
def api_collapse(spark, sf_dir):
    apis = table(spark, sf_dir, "part").select(F.expr("concat(p_brand, p_partkey % 997)").alias("provider"), F.expr("p_size % 5").alias("n_operations"))
    return derive.collapse_fragments(apis, least=2)


@query("broker_derive", "SELECT p_partkey, CASE WHEN contains(k, 'kafka') THEN 'Kafka' WHEN contains(k, 'nats') THEN 'NATS' END AS broker FROM (SELECT p_partkey, regexp_replace(lower(CASE WHEN p_size % 4 = 0 THEN 'Apache Kafka ' WHEN p_size % 4 = 1 THEN 'NA-TS ' ELSE '' END || p_name), '[^a-z0-9]+', '', 'g') AS k FROM part)")
def broker_derive(spark, sf_dir):
    name = F.expr("concat(CASE WHEN p_size % 4 = 0 THEN 'Apache Kafka ' WHEN p_size % 4 = 1 THEN 'NA-TS ' ELSE '' END, p_name)")
    return table(spark, sf_dir, "part").select("p_partkey", text.broker(name).alias("broker"))


@query("remap_edges", with_ctes("""SELECT src, type, dst, sum(n_evidence)::BIGINT AS n_evidence, CASE min(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence
    FROM (SELECT coalesce(a.new, src) AS src, type, coalesce(b.new, dst) AS dst, n_evidence, confidence FROM relations LEFT JOIN m a ON a.old = src LEFT JOIN m b ON b.old = dst) WHERE src <> dst GROUP BY src, type, dst""", "facts", "relations").replace(
    " SELECT src, type, dst, sum(", ", m AS (SELECT concat('component:', s_suppkey) AS old, concat('component:', s_suppkey - 1) AS new FROM supplier WHERE s_suppkey % 2 = 0) SELECT src, type, dst, sum(", 1))
def remap_edges(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.expr("concat('component:', s_suppkey)").alias("old"), F.expr("concat('component:', s_suppkey - 1)").alias("new"))
    return merge.remap(relations(spark, sf_dir), names)


@query("dangling_filter", with_ctes("SELECT type, count(*) AS n FROM relations WHERE src IN (SELECT ref FROM entities WHERE confidence <> 'review') AND dst IN (SELECT ref FROM entities) GROUP BY type", "facts", "relations", "entities"))
def dangling_filter(spark, sf_dir):
    edges, known = relations(spark, sf_dir), entities(spark, sf_dir)
    kept = merge.without_dangling(edges, known.where("kind = 'Resource' or confidence <> 'review'"))
    return kept.groupBy("type").agg(F.count("*").alias("n"))


@query("system_edge_split", """SELECT s_nationkey AS system, count(*) FILTER (WHERE s_nationkey = c_nationkey) AS n_internal, count(*) FILTER (WHERE s_nationkey <> c_nationkey) AS n_inbound FROM
    (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey GROUP BY s_nationkey""")
def system_edge_split(spark, sf_dir):
    pairs = depends(spark, sf_dir).select("src", "dst").distinct()
    suppliers = table(spark, sf_dir, "supplier").select(F.expr("concat('component:', s_suppkey)").alias("dst"), F.col("s_nationkey").alias("system"))
    customers = table(spark, sf_dir, "customer").select(F.expr("concat('provider:', c_custkey)").alias("src"), "c_nationkey")
    joined = pairs.join(suppliers, "dst").join(customers, "src")
    same = F.col("system") == F.col("c_nationkey")
    return joined.groupBy("system").agg(F.count_if(same).alias("n_internal"), F.count_if(~same).alias("n_inbound"))


@query("lineage_datasets", with_ctes("""SELECT src AS job, count(*) FILTER (WHERE type = 'readsResource') AS n_inputs, count(*) FILTER (WHERE type = 'writesResource') AS n_outputs,
    min(dst) FILTER (WHERE type = 'readsResource') AS first_input FROM relations WHERE type IN ('readsResource', 'writesResource') GROUP BY src""", "facts", "relations"))
def lineage_datasets(spark, sf_dir):
    rows = relations(spark, sf_dir).where("type in ('readsResource', 'writesResource')")
    reads = F.col("type") == "readsResource"
    return rows.groupBy(F.col("src").alias("job")).agg(F.count_if(reads).alias("n_inputs"), F.count_if(~reads).alias("n_outputs"), F.min(F.when(reads, F.col("dst"))).alias("first_input"))


@query("communications_list", with_ctes("""SELECT src, dst, s_name AS src_name, p_name AS dst_name, n_evidence FROM relations JOIN supplier ON src = concat('component:', s_suppkey) LEFT JOIN part ON dst = concat('resource:', p_partkey)
    WHERE type = 'producesMessage' ORDER BY n_evidence DESC, src, dst LIMIT 100""", "facts", "relations"))
def communications_list(spark, sf_dir):
    rows = relations(spark, sf_dir).where("type = 'producesMessage'")
    names = entities(spark, sf_dir).select("ref", "name")
    named = rows.join(names.select(F.col("ref").alias("src"), F.col("name").alias("src_name")), "src").join(names.select(F.col("ref").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
    return named.orderBy(F.desc("n_evidence"), "src", "dst").limit(100).select("src", "dst", "src_name", "dst_name", "n_evidence")


QUESTION = "password license version message"
TERMS = text.search_terms(QUESTION)
_LEXICAL = (
    "SELECT ref, round(score, 9) AS score FROM (SELECT ref, "
    + " + ".join(f"contains(haystack, '{t}')::INT * ln((n - d{k} + 0.5::DOUBLE) / (d{k} + 0.5::DOUBLE) + 1.0::DOUBLE)" for k, t in enumerate(TERMS))
    + " AS score FROM docs CROSS JOIN (SELECT count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE contains(haystack, '{t}')) AS d{k}" for k, t in enumerate(TERMS))
    + " FROM docs)) WHERE round(score, 9) > 0"
)
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DENSE = f"SELECT vec_id AS ref, round(score, 9) AS score FROM (SELECT vec_id, coalesce(list_dot_product(embedding::DOUBLE[], {_Q}::DOUBLE[]) / nullif(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_Q}::DOUBLE[], {_Q}::DOUBLE[])), 0), 0) AS score FROM embeddings) WHERE round(score, 9) > 0"


def _query_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), "embedding")


@query("search_terms", "SELECT unnest(" + str(TERMS) + ") AS term")
def search_terms(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in text.search_terms(QUESTION)], "term string")


@query("lexical_idf", with_ctes(f"SELECT ref, round(score, 6) AS score FROM ({_LEXICAL})", "docs"))
def lexical_idf(spark, sf_dir):
    return search.lexical(documents(spark, sf_dir), TERMS).select("ref", F.round("score", 6).alias("score"))


@query("cosine_topk", f"SELECT ref, round(score, 6) AS score FROM ({_DENSE}) ORDER BY score DESC, ref LIMIT 50")
def cosine_topk(spark, sf_dir):
    found = search.dense(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("ref", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "ref").limit(50)


_RANKED = "SELECT ref, row_number() OVER (ORDER BY score DESC, ref) - 1 AS rank FROM ({})"
_FUSED = f"SELECT ref, sum(part) AS score FROM (SELECT ref, 0.6::DOUBLE / (rank + 61) AS part FROM ({_RANKED.format(_LEXICAL)}) UNION ALL SELECT ref, 1.0::DOUBLE / (rank + 61) FROM ({_RANKED.format(_DENSE)})) GROUP BY ref"


@query("rrf_fusion", with_ctes(f"SELECT ref, round(score, 6) AS score FROM ({_FUSED})", "docs"))
def rrf_fusion(spark, sf_dir):
    lists = {"lexical": search.top(search.lexical(documents(spark, sf_dir), TERMS)), "vector": search.top(search.dense(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)))}
    return search.fuse(lists).select("ref", F.round("score", 6).alias("score"))


_ENTRIES = "len(list_filter(list_slice({0}, 1, {1}), lambda x: " + " OR ".join(f"contains(x, '{t}')" for t in TERMS) + "))"
_METADATA = f"SELECT ref, score FROM (SELECT ref, {_ENTRIES.format('attributes', 30)} + {_ENTRIES.format('glossary', 40)} AS score FROM named) WHERE score > 0"
_NAMED = "SELECT ref, string_split(haystack, chr(10)) AS attributes, string_split(haystack, '. ') AS glossary, list_slice(string_split(haystack, ' '), 1, 6) AS names FROM docs"
_BOOST = f"CASE WHEN list_has_any(list_concat(names, list_transform(names, lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g'))), {[t for t in TERMS if t not in search.GENERIC_TERMS]}) THEN 1.0 ELSE 0.0 END"


def _named(spark, sf_dir):
    """Documents with their lines as attributes, their sentences as glossary entries and their first six words as names."""
    words = F.slice(F.split("haystack", " "), 1, 6)
    return documents(spark, sf_dir).withColumns({"attributes": F.split("haystack", "\n"), "glossary": F.split("haystack", r"\. "), "names": words})


@query("metadata_hits", with_ctes(_METADATA, "docs").replace(" SELECT ref, score", f", named AS ({_NAMED}) SELECT ref, score", 1))
def metadata_hits(spark, sf_dir):
    return search.metadata(_named(spark, sf_dir), TERMS).select("ref", F.col("score").cast("long").alias("score"))


@query("hybrid_search", with_ctes(f"""SELECT f.ref, round(score * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 WHEN 'review' THEN 0.1 ELSE 0.5 END::DOUBLE + {_BOOST}, 6) AS score, confidence
    FROM (SELECT ref, sum(score) AS score FROM ({_FUSED} UNION ALL SELECT ref, 0.6::DOUBLE / (rank + 61) FROM ({_RANKED.format(_METADATA)})) GROUP BY ref) f
    JOIN docs ON docs.ref = f.ref JOIN named ON named.ref = f.ref ORDER BY 2 DESC, 1 LIMIT 8""", "docs").replace(" SELECT f.ref", f", named AS ({_NAMED}) SELECT f.ref", 1))
def hybrid_search(spark, sf_dir):
    return search.hybrid(_named(spark, sf_dir), _vectors(spark, sf_dir), QUESTION, _query_vector(spark, sf_dir))


_W = "list_filter(string_split_regex(haystack, '[^a-z0-9]+'), lambda w: w <> '')"


@query("bm25", with_ctes(f"""SELECT ref, round(s, 6) AS score FROM (SELECT ref, ln((docs - d0 + 0.5) / (d0 + 0.5) + 1) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)) AS s
    FROM w CROSS JOIN (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, (count(*) FILTER (WHERE f0 > 0))::DOUBLE AS d0, (count(*) FILTER (WHERE f1 > 0))::DOUBLE AS d1 FROM w)) WHERE round(s, 6) > 0""", "docs").replace(
    " SELECT ref, round(s", f", w AS (SELECT ref, len(ws)::DOUBLE AS n, len(list_filter(ws, lambda x: x = 'license'))::DOUBLE AS f0, len(list_filter(ws, lambda x: x = 'password'))::DOUBLE AS f1 FROM (SELECT ref, {_W} AS ws FROM docs)) SELECT ref, round(s", 1))
def bm25(spark, sf_dir):
    return search.bm25(documents(spark, sf_dir), ["license", "password"])
