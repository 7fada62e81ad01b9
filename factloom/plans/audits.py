"""Catalog audit over the driver tables: documents are a workspace of twenty repositories and, with suppliers, parts and customers, the entities; line items are the relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import audit
from factloom.plans.binding import EDGE, table
from factloom.plans.discovery import _KEY
from factloom.plans.registry import query

EVIDENCE = "array<struct<path:string,line:int,snippet:string>>"
_FILE = "concat(source, '/docs/', doc_id, '.txt')"
_PATH = f"CASE doc_id % 7 WHEN 3 THEN {_FILE} WHEN 4 THEN concat(doc_id, '.txt') WHEN 6 THEN concat('docs/', doc_id, '.md') ELSE concat('docs/', doc_id, '.txt') END"
_SNIPPET = "concat(CASE WHEN doc_id % 7 = 5 THEN 'not in the text: ' ELSE '' END, substr(text, 1, 80))"
_KINDS = "CASE doc_id % 3 WHEN 0 THEN 'API' WHEN 1 THEN 'Component' ELSE 'Resource' END"
_NAMESAKE = "concat('Customer#', lpad(concat({0}, ''), 9, '0'))"
_SUPPLIER = f"CASE WHEN s_acctbal < 0 THEN {_NAMESAKE.format('s_suppkey')} ELSE s_name END"
_TARGET = f"""CASE l_linenumber WHEN 1 THEN concat('Provider:', {_NAMESAKE.format('l_suppkey')}) WHEN 2 THEN concat('Component:', {_NAMESAKE.format('l_suppkey')})
    ELSE concat('Resource:part ', l_partkey + CASE WHEN l_linenumber = 5 THEN 500 ELSE 0 END) END"""


def _even(value: str) -> str:
    return f"trim(regexp_replace(coalesce({value}, ''), '{audit.WHITE}', ' ', 'g'))"


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.expr(_FILE).alias("path"), "text")


def entities(spark, sf_dir):
    cite = lambda *pairs: "array(" + ", ".join(f"named_struct('path', {p}, 'line', 1, 'snippet', {s})" for p, s in pairs) + ")"
    none = f"CAST(array() AS {EVIDENCE})"
    both = cite((_PATH, _SNIPPET), ("concat('docs/', doc_id, '.txt')", "substr(text, 40, 50)"))
    own = f"CASE WHEN doc_id % 11 = 0 THEN {none} ELSE {both} END"
    parts = {
        "documents": (_KINDS, "concat('doc ', doc_id)", "doc_id % 2 = 0", "CASE doc_id % 7 WHEN 2 THEN CAST(array() AS array<string>) WHEN 1 THEN array('acme/none') ELSE array(concat('acme/', source)) END", own),
        "supplier": ("'Component'", _SUPPLIER, "false", "array(concat('acme/src', s_suppkey % 20))", none),
        "customer": ("'Provider'", "c_name", "true", "CASE WHEN c_acctbal < 0 THEN CAST(array() AS array<string>) ELSE array('acme/x', 'acme/y') END", none),
        "part": ("'Resource'", "concat('part ', p_partkey)", "false", "array('acme/src3')", cite(("concat('docs/', p_partkey, '.txt')", "'a'"))),
    }
    out = None
    for name, columns in parts.items():
        rows = table(spark, sf_dir, name).select(*(F.expr(x).alias(c) for x, c in zip(columns, ("kind", "name", "external", "source_repos", "evidence"), strict=True)))
        out = rows if out is None else out.unionByName(rows)
    return out


def relations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return rows.select(
        F.expr(f"concat('Component:', {_SUPPLIER})").alias("src"), F.expr(EDGE).alias("type"), F.expr(_TARGET).alias("dst"), F.expr("CASE l_returnflag WHEN 'R' THEN 'Resource' END").alias("target_kind"),
        F.expr("CASE l_linestatus WHEN 'O' THEN array('acme/src1') ELSE CAST(array() AS array<string>) END").alias("source_repos"),
        F.expr(f"CASE WHEN l_linenumber < 6 THEN array(named_struct('path', concat('docs/', l_suppkey, '.txt'), 'line', 1, 'snippet', 'a')) ELSE CAST(array() AS {EVIDENCE}) END").alias("evidence"),
    )


_NO_CITES, _NO_REPOS = "[]::STRUCT(p VARCHAR, s VARCHAR)[]", "[]::VARCHAR[]"
_FACTS = f"""ents AS (SELECT {_KINDS} AS kind, concat('doc ', doc_id) AS name, doc_id % 2 = 0 AS external, CASE doc_id % 7 WHEN 2 THEN {_NO_REPOS} WHEN 1 THEN ['acme/none'] ELSE [concat('acme/', source)] END AS repos,
        CASE WHEN doc_id % 11 = 0 THEN {_NO_CITES} ELSE [{{'p': {_PATH}, 's': {_SNIPPET}}}, {{'p': concat('docs/', doc_id, '.txt'), 's': substr(text, 40, 50)}}] END AS cites FROM documents
    UNION ALL SELECT 'Component', {_SUPPLIER}, false, [concat('acme/src', s_suppkey % 20)], {_NO_CITES} FROM supplier
    UNION ALL SELECT 'Provider', c_name, true, CASE WHEN c_acctbal < 0 THEN {_NO_REPOS} ELSE ['acme/x', 'acme/y'] END, {_NO_CITES} FROM customer
    UNION ALL SELECT 'Resource', concat('part ', p_partkey), false, ['acme/src3'], [{{'p': concat('docs/', p_partkey, '.txt'), 's': 'a'}}] FROM part),
rels AS (SELECT concat('Component:', {_SUPPLIER}) AS src, {EDGE} AS type, {_TARGET} AS dst, CASE l_returnflag WHEN 'R' THEN 'resource' ELSE '' END AS told, CASE l_linestatus WHEN 'O' THEN ['acme/src1'] ELSE {_NO_REPOS} END AS repos,
    CASE WHEN l_linenumber < 6 THEN [{{'p': concat('docs/', l_suppkey, '.txt'), 's': 'a'}}] ELSE {_NO_CITES} END AS cites FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_STATUS = f"""files AS (SELECT {_FILE} AS file, source AS base, concat('docs/', doc_id, '.txt') AS rel, concat(doc_id, '.txt') AS leaf, {_even('text')} AS whole FROM documents),
sets AS (SELECT DISTINCT repos, cites FROM (SELECT repos, cites FROM ents UNION ALL SELECT repos, cites FROM rels) WHERE len(cites) > 0),
asks AS (SELECT repos, cites, k, cites[k].p AS p, {_even('cites[k].s')} AS s, list_intersect(list_transform(repos, lambda r: split_part(r, '/', 2)), tops) AS bases FROM sets, (SELECT list(DISTINCT base) AS tops FROM files), unnest(range(1, len(cites) + 1)) t(k)),
near AS (SELECT a.repos, a.cites, a.k, s, whole FROM (SELECT *, unnest(bases) AS b FROM asks) a JOIN files f ON f.base = b AND f.rel = p
    UNION ALL SELECT repos, cites, k, s, whole FROM asks JOIN files ON file = p UNION ALL SELECT repos, cites, k, s, whole FROM asks JOIN files ON rel = p WHERE len(bases) = 0),
rest AS (SELECT * FROM asks a WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.repos = a.repos AND n.cites = a.cites AND n.k = a.k)),
met AS (SELECT * FROM near UNION ALL SELECT repos, cites, k, s, whole FROM rest JOIN files ON rel = p UNION ALL SELECT repos, cites, k, s, whole FROM rest JOIN files ON leaf = p),
counts AS (SELECT repos, cites, count(*) AS there, count(*) FILTER (WHERE held) AS held FROM (SELECT repos, cites, k, bool_or(s <> '' AND contains(whole, s)) AS held FROM met GROUP BY ALL) GROUP BY ALL),
judged AS (SELECT repos, cites, CASE WHEN held = n THEN 'matched' WHEN held > 0 THEN 'partial' WHEN there > 0 THEN 'unmatched' ELSE 'missing_paths' END AS status,
    CASE WHEN held = n OR (held = 0 AND there > 0) THEN concat(held, '/', n, ' citation(s) matched') WHEN held > 0 THEN concat(held, '/', n, ' citation(s) matched; ', n - there, ' missing path(s)') ELSE concat(held, '/', n, ' citation path(s) found') END AS detail
    FROM (SELECT repos, cites, coalesce(there, 0) AS there, coalesce(held, 0) AS held, len(cites) AS n FROM sets LEFT JOIN counts USING (repos, cites))),
names AS (SELECT {_KEY.format('name')} AS key, list_sort(list(DISTINCT kind)) AS kinds FROM ents WHERE kind IN ('Resource', 'Provider') GROUP BY 1), refs AS (SELECT DISTINCT concat(kind, ':', name) AS ref FROM ents)"""
_EVIDENCE_SQL = """CASE WHEN status IN ('unmatched', 'missing_paths') THEN {{'s': 'high', 'm': concat('bad-evidence: ', detail)}} END, CASE WHEN status = 'partial' THEN {{'s': 'medium', 'm': concat('partial-evidence: ', detail)}} END,
    CASE WHEN status = 'missing' AND NOT ({0}) THEN {{'s': 'medium', 'm': concat('missing-evidence: ', detail)}} END"""
_WITH_STATUS = "coalesce(status, 'missing') AS status, coalesce(detail, 'no cited evidence') AS detail"
_SQL = f"""WITH {_FACTS}, {_STATUS},
e AS (SELECT ents.*, {_WITH_STATUS}, array_to_string(kinds, ', ') AS clash FROM ents LEFT JOIN judged USING (repos, cites) LEFT JOIN names ON key = {_KEY.format('name')}),
r AS (SELECT rels.*, {_WITH_STATUS}, array_to_string(kinds, ', ') AS clash, split_part(dst, ':', 1) AS kind, src IN (SELECT ref FROM refs) AS has_src, dst IN (SELECT ref FROM refs) AS has_dst FROM rels LEFT JOIN judged USING (repos, cites) LEFT JOIN names ON key = {_KEY.format("split_part(dst, ':', 2)")}),
found AS (SELECT 'entity' AS scope, concat(kind, ':', name) AS fact, concat(kind, '; source_repos=', CASE WHEN len(repos) = 0 THEN '-' ELSE concat('[''', array_to_string(repos, ''', '''), ''']') END, '; evidence=', len(cites)) AS actual, detail, [
        CASE WHEN kind = 'Component' AND clash IS NOT NULL THEN {{'s': 'high', 'm': concat('wrong-kind-duplicate: component name also emitted as ', clash)}} END,
        CASE WHEN kind IN ('API', 'Resource') AND len(repos) = 0 THEN {{'s': 'high', 'm': concat('missing-provenance: ', kind, ' has no source_repos annotation')}} END,
        CASE WHEN kind = 'Provider' AND len(repos) = 0 THEN {{'s': 'medium', 'm': 'missing-provenance: provider has no source_repos annotation'}} END, {_EVIDENCE_SQL.format('external')}] AS fs FROM e
    UNION ALL SELECT 'relation', concat(src, ' -[', type, ']-> ', dst), concat(type, '; source_repo=', coalesce(repos[1], '-'), '; evidence=', len(cites)), detail, [
        CASE WHEN NOT has_src THEN {{'s': 'high', 'm': concat('missing-endpoint: source endpoint does not exist: ', src)}} END, CASE WHEN NOT has_dst THEN {{'s': 'high', 'm': concat('missing-endpoint: target endpoint does not exist: ', dst)}} END,
        CASE WHEN kind <> 'Resource' THEN {{'s': 'high', 'm': concat('target-kind-mismatch: ', type, ' target is ', kind, ', expected Resource')}} END,
        CASE WHEN told <> '' AND told <> lower(kind) THEN {{'s': 'high', 'm': concat('target-kind-property-mismatch: property target_kind=', told, ', target ref kind=', lower(kind))}} END,
        CASE WHEN kind = 'Component' AND clash IS NOT NULL THEN {{'s': 'high', 'm': concat('wrong-kind-target: relation points to Component but same name exists as ', clash)}} END,
        CASE WHEN len(repos) = 0 THEN {{'s': 'medium', 'm': 'missing-relation-provenance: code relation has no properties.source_repo'}} END, {_EVIDENCE_SQL.format('false')}] FROM r),
worst AS (SELECT *, coalesce(list_filter(fs, lambda f: f.s = 'high')[1], list_filter(fs, lambda f: f.s = 'medium')[1]) AS w FROM found),
audited AS (SELECT scope, fact, actual, CASE WHEN w IS NULL THEN 'PASS' WHEN w.s = 'high' THEN 'FAIL' ELSE 'REVIEW' END AS verdict, coalesce(w.s, '-') AS severity, detail AS source_evidence, coalesce(w.m, '{audit.PASSED}') AS recommended_fix FROM worst)"""
_SHOWN = ("scope", "fact", "actual", "verdict", "severity", "source_evidence", "recommended_fix")


def _audited(spark, sf_dir):
    return audit.audit(entities(spark, sf_dir), relations(spark, sf_dir), files(spark, sf_dir))


@query("catalog_audit", f"{_SQL} SELECT {', '.join(_SHOWN)} FROM audited")
def catalog_audit(spark, sf_dir):
    return _audited(spark, sf_dir).select(*_SHOWN)


@query("audit_gates", f"""{_SQL} SELECT gate, CASE WHEN n = 0 THEN 'PASS' WHEN gate LIKE 'Cited%' THEN 'REVIEW' ELSE 'FAIL' END AS status FROM (SELECT unnest(['No Resource-as-Component or Provider-as-Component duplicates',
    'APIs and Resources carry source provenance', 'Resource relation target kinds are respected', 'Relation endpoints exist', 'Cited evidence resolves in workspace']) AS gate,
    unnest([count(*) FILTER (WHERE severity = 'high' AND contains(recommended_fix, 'wrong-kind')), count(*) FILTER (WHERE severity = 'high' AND scope = 'entity' AND contains(recommended_fix, 'missing-provenance')),
    count(*) FILTER (WHERE contains(recommended_fix, 'target-kind')), count(*) FILTER (WHERE contains(recommended_fix, 'missing-endpoint')), count(*) FILTER (WHERE contains(recommended_fix, '-evidence') AND NOT contains(recommended_fix, 'missing-evidence'))]) AS n FROM audited)""")
def audit_gates(spark, sf_dir):
    return audit.gates(_audited(spark, sf_dir))


@query("audit_summary", f"""{_SQL} SELECT count(*) AS facts_audited, count(*) FILTER (WHERE scope = 'entity') AS entities_audited, count(*) FILTER (WHERE scope = 'relation') AS relations_audited,
    count(*) FILTER (WHERE severity = 'high') AS high_findings, count(*) FILTER (WHERE severity = 'medium') AS medium_findings, count(*) FILTER (WHERE severity = 'low') AS low_findings,
    count(*) FILTER (WHERE verdict = 'PASS') AS "pass", count(*) FILTER (WHERE verdict = 'REVIEW') AS review, count(*) FILTER (WHERE verdict = 'FAIL') AS fail FROM audited""")
def audit_summary(spark, sf_dir):
    return audit.summary(_audited(spark, sf_dir))
