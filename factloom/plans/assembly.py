"""Catalog assembly over extraction documents that are built from the suppliers, one repository each."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import assemble
from factloom.plans.binding import table
from factloom.plans.registry import query

_DOCUMENT = """to_json(named_struct(
    'repo', named_struct('id', concat('acme/svc-', s_suppkey), 'system', concat('Shop ', s_nationkey % 5), 'domain', CASE s_nationkey % 3 WHEN 0 THEN 'E_Commerce' WHEN 1 THEN 'Core / Data' ELSE '' END,
        'owner', CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('team ', s_nationkey) END, 'summary', named_struct('purpose', concat('does ', s_suppkey), 'primary_language', 'java')),
    'components', CASE WHEN s_suppkey % 3 <> 0 THEN array(named_struct('name', 'x', 'type', '', 'subcomponent_of', '', 'tags', array('web')),
        named_struct('name', concat('worker ', s_suppkey), 'type', 'job', 'subcomponent_of', concat('svc-', s_suppkey), 'tags', array())) END,
    'providers', array(named_struct('name', 'Pay Pal', 'aliases', array(concat('paypal-', s_nationkey)))),
    'apis', array(named_struct('name', concat('orders api ', s_nationkey))),
    'resources', array(named_struct('name', concat('db ', s_nationkey), 'access', CASE s_suppkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'publish' ELSE '' END,
        'confidence', CASE WHEN s_suppkey % 2 = 0 THEN 'low' ELSE 'high' END)),
    'dependencies', array(named_struct('target', concat('svc-', s_suppkey + 1), 'kind', CASE WHEN s_suppkey % 2 = 0 THEN 'dependsOn' ELSE 'consumesApi' END, 'target_kind', '', 'confidence', 'high'),
        named_struct('target', concat('mystery ', s_nationkey), 'kind', 'producesMessage', 'target_kind', 'queue', 'confidence', '')))) AS d"""
_S = """s AS (SELECT s_suppkey AS k, concat('acme/svc-', s_suppkey) AS repo, s_nationkey AS n, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE concat('team ', s_nationkey) END AS owner,
    CASE s_nationkey % 3 WHEN 0 THEN 'e-commerce' WHEN 1 THEN 'core-data' END AS domain, max(s_suppkey) OVER () AS last FROM supplier)"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.expr(_DOCUMENT)).select(F.from_json("d", assemble.DOCUMENT).alias("d")).select("d.*")


@query("assembled_entities", f"""WITH {_S}, facts AS (
    SELECT concat('Component:svc-', k) AS ref, 'service' AS type, owner, repo, CASE WHEN k % 3 <> 0 THEN ['java', 'web'] ELSE ['java'] END AS tags, []::VARCHAR[] AS aliases, [repo] AS repos, false AS ext, 3 AS c FROM s
    UNION ALL SELECT concat('Component:worker-', k), 'job', owner, repo, ['java'], [], [repo], false, 3 FROM s WHERE k % 3 <> 0
    UNION ALL SELECT concat('System:Shop-', n % 5), NULL, owner, repo, [], [], [], false, 2 FROM s
    UNION ALL SELECT concat('Domain:', domain), NULL, owner, repo, [], [CASE domain WHEN 'e-commerce' THEN 'E_Commerce' ELSE 'Core / Data' END], [], false, 2 FROM s WHERE domain IS NOT NULL
    UNION ALL SELECT concat('Group:team-', n), 'team', NULL, repo, [], [], [], false, 2 FROM s WHERE owner <> 'unknown'
    UNION ALL SELECT 'Provider:Pay-Pal', 'provider', 'external', repo, [], [concat('paypal-', n)], [repo], true, 3 FROM s
    UNION ALL SELECT concat('API:orders-api-', n), 'rest', 'unknown', repo, [], [], [repo], false, 3 FROM s
    UNION ALL SELECT concat('Resource:db-', n), 'unknown', 'unknown', repo, [], [], [repo], false, CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END FROM s
    UNION ALL SELECT concat('Component:svc-', k + 1), 'service', 'unknown', repo, ['external'], [concat('svc-', k + 1)], [], true, 2 FROM s WHERE k = last
    UNION ALL SELECT concat('Resource:mystery-', n), 'queue', 'unknown', repo, [], [concat('mystery ', n)], [repo], false, 0 FROM s)
    SELECT ref, split_part(ref, ':', 1) AS kind, min(type) AS type, arg_min(owner, repo) AS owner, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags,
    array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') AS aliases, len(list_distinct(flatten(list(repos))))::INT AS n_repos, bool_and(ext) AS external,
    CASE max(c) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence FROM facts GROUP BY ref""")
def assembled_entities(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return assemble.catalog(_documents(spark, sf_dir))[0].select("ref", "kind", "type", "owner", joined("tags"), joined("aliases"), F.size("source_repos").alias("n_repos"), "external", "confidence")


@query("assembled_relations", f"""WITH {_S}, u AS (SELECT *, concat('Component:svc-', k) AS ref FROM s UNION ALL SELECT *, concat('Component:worker-', k) FROM s WHERE k % 3 <> 0), facts AS (
    SELECT concat('Component:worker-', k) AS src, 'subcomponentOf' AS type, concat('Component:svc-', k) AS dst, 3 AS c FROM s WHERE k % 3 <> 0
    UNION ALL SELECT ref, 'partOf', concat('System:Shop-', n % 5), 2 FROM u
    UNION ALL SELECT concat('System:Shop-', n % 5), 'partOf', concat('Domain:', domain), 2 FROM s WHERE domain IS NOT NULL
    UNION ALL SELECT ref, 'ownedBy', concat('Group:team-', n), 2 FROM u WHERE owner <> 'unknown'
    UNION ALL SELECT concat('Component:svc-', k), 'dependsOn', 'Provider:Pay-Pal', 3 FROM s
    UNION ALL SELECT concat('Component:svc-', k), 'providesApi', concat('API:orders-api-', n), 3 FROM s
    UNION ALL SELECT concat('Component:svc-', k), CASE k % 4 WHEN 0 THEN 'readsResource' WHEN 1 THEN 'writesResource' WHEN 2 THEN 'producesMessage' ELSE 'dependsOn' END, concat('Resource:db-', n), CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END FROM s
    UNION ALL SELECT concat('Component:svc-', k), CASE WHEN k % 2 = 0 THEN 'dependsOn' ELSE 'consumesApi' END, concat('Component:svc-', k + 1), CASE WHEN k = last THEN 2 ELSE 3 END FROM s
    UNION ALL SELECT concat('Component:svc-', k), 'producesMessage', concat('Resource:mystery-', n), 0 FROM s)
    SELECT src, type, dst, CASE max(c) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'review' END AS confidence FROM facts GROUP BY src, type, dst""")
def assembled_relations(spark, sf_dir):
    return assemble.catalog(_documents(spark, sf_dir))[1].select("src", "type", "dst", "confidence")
