"""Queries over service dependencies (source files of ``v_files``, raw matches of ``v_deps``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS_CLASS
from ..operators import deps as D
from ..sources.tables import table
from .registry import register
from .views import duck_view_sql, view


def _repos(spark, sf):
    """Repositories: the repos of v_files plus pay<size % 10> client libraries."""
    f = view(spark, sf, "v_files").select(F.col("repo").alias("name"))
    p = table(spark, sf, "part").select(F.concat(F.lit("pay"), (F.col("p_size") % 10).cast("string")).alias("name"))
    return f.unionByName(p).distinct().withColumn("id", F.concat(F.lit("id-"), F.col("name")))


def _rx(rx: str) -> str:
    """RE2 form: drop the Unicode flag (ASCII inputs) and escape quotes for SQL."""
    return rx.replace("U)", ")").replace("(?)", "").replace("'", "''")


_NORM = f"""(CASE WHEN len(nt) < 3 OR nt IN ({', '.join(repr(x) for x in D.IGNORED_TARGETS)}) THEN NULL ELSE nt END)"""
_NT = (f"translate(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(raw, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')),"
       f" '^https?://', ''), ':[0-9]+$', ''), '[_-](?:url|host|endpoint|service|addr)$', ''), '_.', '--')")

_MATCH_SQL = "\nUNION ALL\n".join(
    f"""SELECT repo, file_path, {i} AS rule, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, '{kind}' AS dependency_type,
       unnest(m).g1 AS raw, substr(unnest(m).g0, 1, 200) AS source_pattern
FROM (SELECT repo, file_path, list_transform(list_zip(regexp_extract_all(content, '{_rx(rx)}', 0),
      regexp_extract_all(content, '{_rx(rx)}', 1)), lambda z: {{'g0': z[1], 'g1': z[2]}}) AS m FROM f)"""
    for i, (kind, rx) in enumerate(D.RULES))

_EXTRACT_SQL = f"""
WITH f AS ({duck_view_sql('v_files')}),
known AS (SELECT DISTINCT lower(name) AS name FROM (SELECT repo AS name FROM f
          UNION SELECT 'pay' || CAST(p_size % 10 AS VARCHAR) FROM part)),
mm AS ({_MATCH_SQL}),
nt0 AS (SELECT *, {_NT} AS nt FROM mm),
nt1 AS (SELECT * EXCLUDE (nt), {_NORM} AS target_name FROM nt0),
x AS (SELECT * FROM nt1 WHERE target_name IS NOT NULL
      AND (dependency_type <> 'import' OR len(list_intersect(string_split_regex(lower(raw), '[./]'),
                                                            (SELECT list(name) FROM known))) > 0)
      AND target_name <> lower(repo))"""


@register("extract_dependencies", _EXTRACT_SQL + """
SELECT repo, file_path, rule, pos, dependency_type, target_name, source_pattern FROM x""")
def extract_dependencies(spark, sf):
    """SD1-SD4: 13 rules over whole source files -> normalised, filtered targets."""
    f = view(spark, sf, "v_files", spread=True)
    d = D.extract_dependencies(f, _repos(spark, sf))
    return d.select("repo", "file_path", "rule", "pos", "dependency_type", "target_name", "source_pattern")


@register("rollup_file_dependencies", _EXTRACT_SQL + """
SELECT repo AS source_repo, target_name, dependency_type, file_path AS source_file, count(*) AS call_count,
       arg_min(source_pattern, (rule, pos)) AS source_pattern,
       CASE WHEN target_name IN (SELECT name FROM known) THEN 'id-' || target_name END AS target_repo_id
FROM x GROUP BY ALL""")
def rollup_file_dependencies(spark, sf):
    """SD5 + SD6 over extracted matches: call counts, first pattern, resolved target id."""
    f = view(spark, sf, "v_files", spread=True)
    d = D.extract_dependencies(f, _repos(spark, sf)).withColumnRenamed("repo", "source_repo") \
         .withColumnRenamed("file_path", "source_file")
    r = D.resolve_target(D.rollup_dependencies(d), _repos(spark, sf))
    return r.select("source_repo", "target_name", "dependency_type", "source_file", "call_count", "source_pattern",
                    "target_repo_id")


def _dep_rollup(spark, sf):
    v = view(spark, sf, "v_deps").withColumnRenamed("target_repo", "target_name")
    v = D.drop_self(v)
    repos = v.select(F.col("source_repo").alias("name")).distinct().withColumn("id", F.concat(F.lit("id-"), F.col("name")))
    r = D.resolve_target(D.rollup_dependencies(v), repos)
    return repos, r.withColumn("source_repo_id", F.concat(F.lit("id-"), F.col("source_repo")))


_DEP_SQL = f"""
WITH v AS ({duck_view_sql('v_deps')}),
repos AS (SELECT DISTINCT source_repo AS name, 'id-' || source_repo AS id FROM v),
r AS (SELECT source_repo, target_repo AS target_name, dependency_type, source_file, count(*) AS call_count
      FROM v WHERE target_repo <> lower(source_repo) GROUP BY ALL),
rr AS (SELECT r.*, repos.id AS target_repo_id, 'id-' || source_repo AS source_repo_id
       FROM r LEFT JOIN repos ON repos.name = r.target_name)"""


@register("rollup_dependencies", _DEP_SQL + """
SELECT source_repo, target_name, dependency_type, source_file, call_count, target_repo_id FROM rr""")
def rollup_dependencies(spark, sf):
    """SD4-SD6 over raw matches of the whole lineitem-derived view."""
    _, r = _dep_rollup(spark, sf)
    return r.select("source_repo", "target_name", "dependency_type", "source_file", "call_count", "target_repo_id")


@register("dependency_graph_edges", _DEP_SQL + """
SELECT source_repo_id, coalesce(target_repo_id, '') AS target, target_name, dependency_type, source_file, call_count
FROM rr WHERE target_repo_id IS NULL OR target_repo_id IN (SELECT id FROM repos)""")
def dependency_graph_edges(spark, sf):
    """SD7: graph edges (unresolved targets as "")."""
    repos, r = _dep_rollup(spark, sf)
    _, e = D.dependency_graph(repos, r)
    return e.select("source_repo_id", "target", "target_name", "dependency_type", "source_file", "call_count")


@register("node_degrees", _DEP_SQL + """,
o AS (SELECT source_repo_id AS id, count(*) AS n_out,
        list_slice(list_sort(list((target_name, dependency_type, source_file))), 1, 3) AS ol FROM rr GROUP BY 1),
i AS (SELECT target_repo_id AS id, count(*) AS n_in,
        list_slice(list_sort(list((source_repo, dependency_type, source_file))), 1, 2) AS il FROM rr
      WHERE target_repo_id IS NOT NULL GROUP BY 1)
SELECT repos.id, repos.name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in,
       array_to_string(list_transform(coalesce(ol, []), lambda x: x[1] || ' (' || x[2] || ')'), ', ') AS outbound,
       array_to_string(list_transform(coalesce(il, []), lambda x: x[1]), ', ') AS inbound,
       greatest(coalesce(n_out, 0) + coalesce(n_in, 0) - 5, 0) AS more
FROM repos LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def node_degrees(spark, sf):
    """SD8: per repository node: in / out degree, first targets and sources, overflow."""
    repos, r = _dep_rollup(spark, sf)
    _, e = D.dependency_graph(repos, r)
    return D.node_degrees(repos, e)


@register("blast_radius", _DEP_SQL + """,
s AS (SELECT DISTINCT target_name AS service_name FROM rr UNION SELECT name FROM repos),
c AS (SELECT target_name, count(*) AS n FROM rr GROUP BY 1)
SELECT service_name, coalesce(n, 0) AS blast_radius,
       CASE WHEN coalesce(n, 0) >= 5 THEN 'high' WHEN coalesce(n, 0) >= 2 THEN 'medium' ELSE 'low' END AS blast_radius_level
FROM s LEFT JOIN c ON lower(s.service_name) = c.target_name""")
def blast_radius(spark, sf):
    """SD9: dependency rows targeting each service and the blast level."""
    repos, r = _dep_rollup(spark, sf)
    services = r.select(F.col("target_name").alias("service_name")).unionByName(repos.select(F.col("name").alias("service_name")))
    return D.blast_radius(r, services).select("service_name", "blast_radius", "blast_radius_level")
