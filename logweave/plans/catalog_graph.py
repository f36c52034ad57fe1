"""Queries over the causal graph (edges rolled up from ``v_edges``) and the
entity registry (entities derived from ``supplier`` / ``nation`` / ``orders``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import table
from .registry import ntz, r4, register
from .views import duck_view_sql, view

_K = "source_entity, target_entity"


def _r2(x: str) -> str:
    """Half-even rounding of the shortest decimal form of a double (as Spark's bround)."""
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 10)), 2) AS DOUBLE)"


def _sd_sql(l: str) -> str:
    """Two-pass sample standard deviation with a left-to-right sum (same order as the Spark fold)."""
    mean = f"(list_reduce({l}, lambda a, x: a + x) / len({l}))"
    ss = f"list_reduce(list_transform({l}, lambda x: (x - {mean}) * (x - {mean})), lambda a, x: a + x)"
    return f"(CASE WHEN len({l}) < 2 THEN 0.0 ELSE sqrt({ss} / (len({l}) - 1)) END)"


_LADDER_SQL = f"""
e AS ({duck_view_sql('v_edges')}),
x AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY ts, lag_ms) AS i,
             count(lag_ms) OVER (PARTITION BY {_K} ORDER BY ts, lag_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
      FROM e),
s AS (SELECT *, list_sort(list(CAST(lag_ms AS DOUBLE)) OVER (PARTITION BY {_K} ORDER BY ts, lag_ms
             ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS win FROM x WHERE lag_ms IS NOT NULL),
s2 AS (SELECT *, CASE WHEN len(win) % 2 = 1 THEN win[len(win) // 2 + 1]
                      ELSE (win[len(win) // 2] + win[len(win) // 2 + 1]) / 2 END AS med,
              {_sd_sql('win')} AS sd FROM s),
corr AS (SELECT {_K}, min(i) AS ci, arg_min(med, i) AS cmed, arg_min(sd, i) AS csd FROM s2 WHERE med >= 0 GROUP BY ALL),
third AS (SELECT {_K}, min(i) AS i3 FROM s2 WHERE k = 3 GROUP BY ALL),
lastw AS (SELECT {_K}, list_sort(list(CAST(lag_ms AS DOUBLE))) AS lst FROM (
            SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY ts DESC, lag_ms DESC) AS r FROM s) WHERE r <= 50
          GROUP BY ALL),
agg AS (SELECT {_K}, count(*) AS incident_count, max(ts) AS last_seen_at FROM e GROUP BY ALL),
j AS (SELECT agg.*, ci, cmed, csd, CASE WHEN i3 IS NOT NULL THEN greatest(i3, 3) END AS pi, coalesce(lst, []) AS lst
      FROM agg LEFT JOIN corr USING ({_K}) LEFT JOIN third USING ({_K}) LEFT JOIN lastw USING ({_K})),
edges AS (SELECT {_K}, incident_count, last_seen_at,
  CASE WHEN pi IS NOT NULL THEN 'probable_cause' WHEN ci IS NOT NULL AND (pi IS NULL OR ci <= pi) THEN 'correlates_with'
       ELSE 'observed' END AS promotion_level,
  CASE WHEN pi IS NOT NULL THEN least(0.85, 0.4 + 0.15 + least(pi * 0.02, 0.1))
       WHEN ci IS NOT NULL THEN least(0.4, 0.1 + ci * 0.05) ELSE 0.1 END AS confidence,
  CASE WHEN ci IS NOT NULL AND (pi IS NULL OR ci <= pi) THEN {_r2('cmed')} END AS temporal_precedence_ms,
  CASE WHEN ci IS NOT NULL AND (pi IS NULL OR ci <= pi) THEN {_r2('csd')} END AS temporal_std_ms,
  len(lst) AS n_lag_samples,
  {_r2("CASE WHEN len(lst) = 0 THEN 0.0 WHEN len(lst) % 2 = 1 THEN lst[len(lst) // 2 + 1] "
        "ELSE (lst[len(lst) // 2] + lst[len(lst) // 2 + 1]) / 2 END")} AS median_lag_ms,
  {_r2(_sd_sql('lst'))} AS stdev_lag_ms
  FROM j)"""

_EDGE_COLS = ("source_entity, target_entity, incident_count, last_seen_at, promotion_level, "
              "round(CAST(confidence AS DOUBLE), 4) AS confidence, temporal_precedence_ms, temporal_std_ms, n_lag_samples, "
              "median_lag_ms, stdev_lag_ms")


def _edges(spark, sf, materialise: bool = False):
    e = G.lag_stats(G.rollup_edges(view(spark, sf, "v_edges")))
    # queries that read the edge table several times (paths, chains) take it once
    return G._cut(e) if materialise else e


def _edge_out(e):
    return e.select("source_entity", "target_entity", "incident_count", ntz("last_seen_at").alias("last_seen_at"),
                    "promotion_level", r4("confidence").alias("confidence"), "temporal_precedence_ms",
                    "temporal_std_ms", "n_lag_samples", "median_lag_ms", "stdev_lag_ms")


@register("edge_rollup", f"WITH {_LADDER_SQL} SELECT {_EDGE_COLS} FROM edges")
def edge_rollup(spark, sf):
    """CG1 + CG3-CG5: co-occurrences -> edges with counts, lag statistics and promotion."""
    return _edge_out(_edges(spark, sf))


@register("edges_at_least", f"WITH {_LADDER_SQL} SELECT {_EDGE_COLS} FROM edges WHERE promotion_level IN "
          "('probable_cause', 'confirmed_cause')")
def edges_at_least(spark, sf):
    """CG10: edges at or above probable_cause."""
    return _edge_out(G.edges_at_least(_edges(spark, sf), "probable_cause"))


@register("pair_events", """
SELECT * FROM (SELECT lag(event_type || '-' || CAST(event_id % 6 AS VARCHAR)) OVER w AS source_entity,
       event_type || '-' || CAST(event_id % 6 AS VARCHAR) AS target_entity,
       CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS DOUBLE) / 1000 AS lag_ms, ts
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE source_entity IS NOT NULL AND source_entity <> target_entity AND lag_ms <= 86400000""")
def pair_events(spark, sf):
    """CG2: consecutive events of a user within one day form a co-occurrence."""
    ev = table(spark, sf, "events").withColumn(
        "entity", F.concat_ws("-", "event_type", (F.col("event_id") % 6).cast("string"))) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    p = G.pair_events(ev, "entity", "ts", 86400, partition="user_id", order="event_id")
    return p.withColumn("ts", ntz("ts"))


_CONF = """,
cf AS (SELECT source_entity, target_entity, 'oncall@example.org' AS confirmed_by FROM edges
       WHERE source_entity LIKE 'error-%'
       UNION SELECT target_entity, source_entity, 'oncall@example.org' FROM edges WHERE source_entity LIKE 'error-%'
       UNION SELECT source_entity, 'gone-' || target_entity, 'oncall@example.org' FROM edges WHERE source_entity LIKE 'error-%'),
cj AS (SELECT e.*, cf.confirmed_by AS cby FROM edges e LEFT JOIN cf USING (source_entity, target_entity))"""


@register("confirm_edges", f"WITH {_LADDER_SQL}{_CONF}" + """
SELECT source_entity, target_entity,
  CASE WHEN cby IS NOT NULL AND promotion_level IN ('observed', 'correlates_with', 'probable_cause') THEN 'confirmed_cause'
       ELSE promotion_level END AS promotion_level,
  round(CAST(CASE WHEN cby IS NOT NULL AND promotion_level IN ('observed', 'correlates_with', 'probable_cause') THEN 1.0
       ELSE confidence END AS DOUBLE), 4) AS confidence,
  CASE WHEN cby IS NOT NULL AND promotion_level IN ('observed', 'correlates_with', 'probable_cause') THEN cby END AS confirmed_by
FROM cj""")
def confirm_edges(spark, sf):
    """CG8: confirm edges out of error entities (and their reverses, which may not exist)."""
    e = _edges(spark, sf)
    c = _confirmations(e)
    out, _ = G.confirm(e, c)
    return out.select("source_entity", "target_entity", "promotion_level", r4("confidence").alias("confidence"),
                      "confirmed_by")


def _confirmations(e):
    err = e.filter(F.col("source_entity").startswith("error-"))
    fwd = err.select("source_entity", "target_entity")
    rev = err.select(F.col("target_entity").alias("source_entity"), F.col("source_entity").alias("target_entity"))
    gone = err.select("source_entity", F.concat(F.lit("gone-"), "target_entity").alias("target_entity"))
    return fwd.unionByName(rev).unionByName(gone).distinct().withColumn("confirmed_by", F.lit("oncall@example.org"))


@register("confirm_not_found", f"WITH {_LADDER_SQL}{_CONF}" + """
SELECT source_entity, target_entity, confirmed_by FROM cf WHERE NOT EXISTS (
  SELECT 1 FROM edges e WHERE e.source_entity = cf.source_entity AND e.target_entity = cf.target_entity
  AND e.promotion_level IN ('observed', 'correlates_with', 'probable_cause'))""")
def confirm_not_found(spark, sf):
    """CG8: confirmations that match no confirmable edge."""
    e = _edges(spark, sf)
    _, nf = G.confirm(e, _confirmations(e))
    return nf.select("source_entity", "target_entity", "confirmed_by")


_PATH_SQL = f"""WITH RECURSIVE {_LADDER_SQL},
und AS (SELECT source_entity AS a, target_entity AS b FROM edges UNION SELECT target_entity, source_entity FROM edges),
pr AS (SELECT DISTINCT source_entity AS src, target_entity AS dst FROM edges WHERE source_entity LIKE 'error-%'),
reach(src, dst, node, d) AS (
  SELECT src, dst, src, 0 FROM pr
  UNION
  SELECT r.src, r.dst, u.b, r.d + 1 FROM reach r JOIN und u ON u.a = r.node
  WHERE r.node <> r.dst AND r.d < (SELECT count(DISTINCT a) FROM und)
    AND NOT ((r.node = r.src AND u.b = r.dst) OR (r.node = r.dst AND u.b = r.src))),
dist AS (SELECT src, dst, node, min(d) AS d FROM reach GROUP BY ALL),
way(src, dst, node, d, path) AS (
  SELECT src, dst, src, 0, [src] FROM pr
  UNION ALL
  SELECT w.src, w.dst, u.b, w.d + 1, min(list_append(w.path, u.b)) FROM way w JOIN und u ON u.a = w.node
  JOIN dist n ON n.src = w.src AND n.dst = w.dst AND n.node = u.b AND n.d = w.d + 1
  WHERE w.node <> w.dst AND NOT ((w.node = w.src AND u.b = w.dst) OR (w.node = w.dst AND u.b = w.src))
  GROUP BY w.src, w.dst, u.b, w.d),
best AS (SELECT src, dst, path FROM way WHERE node = dst)
SELECT pr.src AS source_entity, pr.dst AS target_entity, array_to_string(best.path, '>') AS path,
       best.path IS NOT NULL AS has_path FROM pr LEFT JOIN best USING (src, dst)"""


@register("topology_path", _PATH_SQL)
def topology_path(spark, sf):
    """CG7: shortest undirected path for edges out of error entities, the direct
    edge excluded, of any length."""
    e = _edges(spark, sf, materialise=True)
    pairs = e.filter(F.col("source_entity").startswith("error-"))
    p = G.topology_path(e, pairs, exclude_self_edge=True)
    return p.select("source_entity", "target_entity", F.array_join("path", ">").alias("path"), "has_path")


_CHAIN_SQL = f"""WITH RECURSIVE {_LADDER_SQL},
ce AS (SELECT * FROM edges WHERE promotion_level IN ('correlates_with', 'probable_cause', 'confirmed_cause')),
st AS (SELECT DISTINCT source_entity AS start FROM edges WHERE source_entity LIKE 'error-%'),
reach(start, node, d) AS (
  SELECT start, start, 0 FROM st
  UNION
  SELECT r.start, c.source_entity, r.d + 1 FROM reach r JOIN ce c ON c.target_entity = r.node WHERE r.d < 3),
dist AS (SELECT start, node, min(d) AS d FROM reach GROUP BY ALL),
cand AS (SELECT n.start, n.node AS nbr, n.d AS hop, c.source_entity, c.target_entity, c.promotion_level, c.confidence,
                c.target_entity AS via
         FROM dist n JOIN ce c ON c.source_entity = n.node
         JOIN dist u ON u.start = n.start AND u.node = c.target_entity AND u.d = n.d - 1
         WHERE n.d >= 1)
SELECT start, hop, arg_min(source_entity, (via, source_entity, target_entity)) AS source_entity,
       arg_min(target_entity, (via, source_entity, target_entity)) AS target_entity,
       arg_min(promotion_level, (via, source_entity, target_entity)) AS promotion_level
FROM cand GROUP BY start, nbr, hop"""


@register("causal_chain", _CHAIN_SQL)
def causal_chain(spark, sf):
    """CG9: upstream chains (depth 3, >= correlates_with) of every error entity."""
    e = _edges(spark, sf, materialise=True)
    starts = e.filter(F.col("source_entity").startswith("error-")).select(F.col("source_entity").alias("start"))
    ch = G.causal_chain(e, starts, "upstream", "correlates_with", 3)
    return ch.select("start", "hop", "source_entity", "target_entity", "promotion_level")


# ------------------------------------------------------------------ registry

def _entities(spark, sf):
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    base = s.select(F.col("s_name").alias("canonical_name"),
                    F.when(F.col("s_nationkey") % 2 == 0, F.lit("Service")).otherwise(F.lit("Team")).alias("entity_type"),
                    F.array(F.lower("s_name")).alias("aliases"),
                    F.array(F.concat(F.lit("repo"), (F.col("s_suppkey") % 10).cast("string"))).alias("repos"),
                    F.lit(None).cast("string").alias("description"),
                    F.create_map(F.lit("tier"), F.lit("base")).alias("metadata_json"),
                    F.lit(False).alias("deprecated"))
    batch = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_name").alias("canonical_name"), F.lit("Service").alias("entity_type"),
        F.array(F.col("n_name"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string"))).alias("aliases"),
        F.array(F.concat(F.lit("repo"), (F.col("s_suppkey") % 3).cast("string"))).alias("repos"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("balance "), F.col("s_acctbal").cast("string"))).alias("description"),
        F.create_map(F.lit("nation"), F.col("n_name")).alias("metadata_json"))
    return G.merge_entities(base, batch)


def _meta_text(c):
    m = F.col(c)
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), m[k])), ";")


_ENT_SQL = """
WITH base AS (SELECT s_name AS canonical_name, CASE WHEN s_nationkey % 2 = 0 THEN 'Service' ELSE 'Team' END AS entity_type,
        [lower(s_name)] AS aliases, ['repo' || CAST(s_suppkey % 10 AS VARCHAR)] AS repos FROM supplier),
b AS (SELECT s_name AS canonical_name, [n_name, 'sup-' || CAST(s_suppkey AS VARCHAR)] AS aliases,
        ['repo' || CAST(s_suppkey % 3 AS VARCHAR)] AS repos,
        CASE WHEN s_acctbal > 0 THEN 'balance ' || CAST(s_acctbal AS VARCHAR) END AS description, n_name
      FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT canonical_name, coalesce(base.entity_type, 'Service') AS entity_type,
        list_sort(list_distinct(list_concat(coalesce(base.aliases, []), coalesce(b.aliases, [])))) AS aliases,
        list_sort(list_distinct(list_concat(coalesce(base.repos, []), coalesce(b.repos, [])))) AS repos,
        b.description, 'nation=' || b.n_name || ';tier=base' AS metadata
      FROM base FULL JOIN b USING (canonical_name))"""


@register("merge_entities", _ENT_SQL + """
SELECT canonical_name, entity_type, array_to_string(aliases, ',') AS aliases, array_to_string(repos, ',') AS repos,
       description, metadata FROM m""")
def merge_entities(spark, sf):
    """CG13: entity upsert: alias / repo set unions, description and metadata merge."""
    e = _entities(spark, sf)
    return e.select("canonical_name", "entity_type", F.array_join("aliases", ",").alias("aliases"),
                    F.array_join("repos", ",").alias("repos"), "description", _meta_text("metadata_json").alias("metadata"))


@register("list_entities", _ENT_SQL + """
SELECT canonical_name, entity_type, row_number() OVER (ORDER BY canonical_name) AS rank FROM m
WHERE entity_type = 'Team' AND canonical_name NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 7 = 0)""")
def list_entities(spark, sf):
    """CG14 + CG15: deprecate every 7th supplier entity, then list active teams by name."""
    e = _entities(spark, sf)
    names = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 7 == 0).select(F.col("s_name").alias("canonical_name"))
    d = G.deprecate(e, names)
    return G.list_entities(d, "Team", False).select("canonical_name", "entity_type", "rank")


@register("deprecated_entities", _ENT_SQL + """
SELECT canonical_name, true AS deprecated FROM m WHERE canonical_name IN (SELECT s_name FROM supplier WHERE s_suppkey % 7 = 0)""")
def deprecated_entities(spark, sf):
    """CG15: the deprecated entities (edges untouched)."""
    e = _entities(spark, sf)
    names = table(spark, sf, "supplier").filter(F.col("s_suppkey") % 7 == 0).select(F.col("s_name").alias("canonical_name"))
    return G.deprecate(e, names).filter("deprecated").select("canonical_name", "deprecated")


@register("resolve_aliases", _ENT_SQL + """,
al AS (SELECT alias, min(canonical_name) AS canon FROM (SELECT canonical_name, unnest(aliases) AS alias FROM m) GROUP BY alias),
ed AS (SELECT lower(s_name) AS source_entity, 'sup-' || CAST(s_suppkey AS VARCHAR) AS target_entity, s_suppkey FROM supplier)
SELECT s_suppkey, coalesce(a1.canon, ed.source_entity) AS source_entity, coalesce(a2.canon, ed.target_entity) AS target_entity
FROM ed LEFT JOIN al a1 ON a1.alias = ed.source_entity LEFT JOIN al a2 ON a2.alias = ed.target_entity""")
def resolve_aliases(spark, sf):
    """CG16: edges named by aliases (lower-case name, sup-<key>) resolved to canonical names."""
    e = _entities(spark, sf)
    s = table(spark, sf, "supplier")
    ed = s.select("s_suppkey", F.lower("s_name").alias("source_entity"),
                  F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("target_entity"))
    return G.resolve_aliases(ed, e).select("s_suppkey", "source_entity", "target_entity")


def _deploys(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("svc-"), (F.col("o_custkey") % 20).cast("string")).alias("service_name"),
                    F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("environment"),
                    F.concat(F.lit("repo"), (F.col("o_orderkey") % 10).cast("string")).alias("repo_id"),
                    F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("order"))


_DEP_SQL = """
WITH d AS (SELECT 'svc-' || CAST(o_custkey % 20 AS VARCHAR) AS service_name, o_orderpriority AS version,
              o_orderstatus AS environment, 'repo' || CAST(o_orderkey % 10 AS VARCHAR) AS repo_id, o_orderdate AS ts,
              o_orderkey AS ord FROM orders)"""


@register("deployment_entities", _DEP_SQL + """,
f AS (SELECT service_name, repo_id, min((ts, ord)) AS f FROM d GROUP BY ALL),
r AS (SELECT service_name, string_agg(repo_id, ',' ORDER BY f) AS repos FROM f GROUP BY ALL),
l AS (SELECT service_name, arg_max(version, (ts, ord)) AS last_version, arg_max(environment, (ts, ord)) AS environment,
             count(*) AS deployments FROM d GROUP BY ALL)
SELECT service_name AS canonical_name, 'Service' AS entity_type, repos, last_version, environment, deployments
FROM l JOIN r USING (service_name)""")
def deployment_entities(spark, sf):
    """CG12: deployments (orders) -> service entities with latest version and repos in first-seen order."""
    ent, _ = G.ingest_deployments(_deploys(spark, sf))
    return ent.select("canonical_name", "entity_type", F.array_join("repos", ",").alias("repos"), "last_version",
                      "environment", "deployments")


@register("deployment_edges", _DEP_SQL + """
SELECT 'deployment:' || service_name || ':' || coalesce(version, 'unknown') AS source_entity, service_name AS target_entity,
       count(*) AS incident_count, CASE WHEN count(*) >= 3 THEN 'probable_cause' ELSE 'correlates_with' END AS promotion_level,
       round(CAST(CASE WHEN count(*) >= 3 THEN least(0.85, 0.55 + least(3 * 0.02, 0.1)) ELSE 0.15 END AS DOUBLE), 4) AS confidence
FROM d GROUP BY ALL""")
def deployment_edges(spark, sf):
    """CG12 -> CG1: lag-0 deployment edges rolled up with the promotion ladder."""
    _, pairs = G.ingest_deployments(_deploys(spark, sf))
    e = G.rollup_edges(pairs)
    return e.select("source_entity", "target_entity", "incident_count", "promotion_level", r4("confidence").alias("confidence"))


_STRICT_SQL = "WITH RECURSIVE " + _LADDER_SQL[1:].replace("edges AS (SELECT", "edges0 AS (SELECT") + f""",
und AS (SELECT source_entity AS a, target_entity AS b FROM edges0 UNION SELECT target_entity, source_entity FROM edges0),
pr AS (SELECT DISTINCT source_entity AS src, target_entity AS dst FROM edges0),
walk(src, dst, node) AS (
  SELECT src, dst, src FROM pr
  UNION
  SELECT w.src, w.dst, u.b FROM walk w JOIN und u ON u.a = w.node
  WHERE w.node <> w.dst
    AND NOT ((w.node = w.src AND u.b = w.dst) OR (w.node = w.dst AND u.b = w.src))),
hp AS (SELECT DISTINCT src, dst FROM walk WHERE node = dst)
SELECT e.source_entity, e.target_entity, e.incident_count,
  CASE WHEN hp.src IS NOT NULL THEN e.promotion_level
       WHEN j.ci IS NOT NULL THEN 'correlates_with' ELSE 'observed' END AS promotion_level,
  round(CAST(CASE WHEN hp.src IS NOT NULL THEN e.confidence WHEN j.ci IS NOT NULL THEN least(0.4, 0.1 + j.ci * 0.05)
       ELSE 0.1 END AS DOUBLE), 4) AS confidence
FROM edges0 e JOIN j USING ({_K}) LEFT JOIN hp ON hp.src = e.source_entity AND hp.dst = e.target_entity"""


@register("edge_rollup_strict", _STRICT_SQL)
def edge_rollup_strict(spark, sf):
    """CG5 / Q3 meaningful mode: probable_cause needs a path between the two
    entities that does not use the edge itself (undirected, of any length)."""
    e0 = G._cut(G.rollup_edges(view(spark, sf, "v_edges")))
    topo = G.topology_path(e0, e0, exclude_self_edge=True)
    e = G.rollup_edges(view(spark, sf, "v_edges"), topology=topo)
    return e.select("source_entity", "target_entity", "incident_count", "promotion_level",
                    r4("confidence").alias("confidence"))


@register("edge_rollup_granger")
def edge_rollup_granger(spark, sf):
    """CG5 with the statistical signal: Granger p-values of hourly entity counts."""
    from ..operators import granger as GR
    ev = table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", (F.col("event_id") % 6).cast("string")).alias("entity"),
        F.col("ts").cast("timestamp").alias("ts"))
    pairs = view(spark, sf, "v_edges")
    p = GR.granger(GR.hourly_series(ev, G.rollup_edges(pairs)))
    e = G.rollup_edges(pairs, p_values=p)
    return e.select("source_entity", "target_entity", "promotion_level", r4("confidence").alias("confidence"),
                    r4("p_value").alias("p_value"))
