"""Evidence-gated causal graph: co-occurrence pairing, edge rollup with the
promotion ladder, lag statistics, BFS paths and causal chains, confirmation,
and the entity registry.

Promotion follows the incident order of each (source, target) pair:
observed -> correlates_with (lag samples present and their median >= 0,
confidence frozen at min(.4, .1 + .05 * incidents) at that moment) ->
probable_cause (>= 3 samples, >= 3 incidents and a statistical or topological
signal) -> confirmed_cause (only by a human confirmation).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed values (must equal the reference).
LEVELS = ["observed", "correlates_with", "probable_cause", "confirmed_cause"]
MAX_LAG_SAMPLES = 50
MIN_INCIDENTS = 3
P_THRESHOLD = 0.05
CO_OCCURRENCE_WINDOW_S = 300


def level_rank(c: Column) -> Column:
    m = F.create_map(*[x for i, lv in enumerate(LEVELS) for x in (F.lit(lv), F.lit(i))])
    return F.coalesce(F.element_at(m, c), F.lit(0))


def pair_events(df: DataFrame, entity: str, ts: str, window_s: float = CO_OCCURRENCE_WINDOW_S,
                partition: str | None = None, order: str | None = None) -> DataFrame:
    """CG2: co-occurrence rows (source, target, lag_ms, ts): each event paired with
    the previous event of its partition when that one is of another entity and at
    most ``window_s`` seconds older. One pass of ``lag``, no pair explosion; the
    lag is taken per (key, minute) with the previous minute's last event carried
    over, so a hot key is not one task."""
    from .ordering import chunked_lag
    keys = [partition] if partition else []
    x = df.select(*keys, F.col(entity).alias("target_entity"), F.col(ts).alias("ts"),
                  F.unix_micros(F.col(ts)).alias("_us"), *([F.col(order).alias("_o")] if order else []))
    okeys = ["_us"] + (["_o"] if order else [])
    x = chunked_lag(x, keys, okeys, F.date_trunc("minute", F.col("ts")), ["target_entity", "_us"])
    lag_ms = (F.col("_us") - F.col("prev__us")).cast("double") / 1000
    return x.filter(F.col("prev_target_entity").isNotNull() & (F.col("prev_target_entity") != F.col("target_entity"))
                    & (F.col("_us") - F.col("prev__us") <= int(window_s * 1_000_000))) \
            .select(F.col("prev_target_entity").alias("source_entity"), "target_entity", lag_ms.alias("lag_ms"), "ts")


def _median_sorted(a: Column) -> Column:
    n = F.size(a)
    mid = (n / 2).cast("int")
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.element_at(a, mid + 1)) \
            .otherwise((F.element_at(a, mid) + F.element_at(a, mid + 1)) / 2)


def _stdev(a: Column) -> Column:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / n
    ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(ss / (n - 1)))


def rollup_edges(pairs: DataFrame, p_values: DataFrame | None = None, topology: DataFrame | None = None,
                 lag: str = "lag_ms", ts: str = "ts") -> DataFrame:
    """CG1 + CG3 + CG4 + CG5: one row per (source, target), cumulative.

    ``p_values`` (source_entity, target_entity, p_value) feeds the statistical
    test (null -> not met, as in the reference); ``topology`` (source_entity,
    target_entity, has_path) feeds the path test. Without it a path always
    exists, since the edge itself is part of the graph it is checked against.
    """
    from .ordering import running_sums
    key = ["source_entity", "target_entity"]
    # incident index and running sample count, per (pair, minute) with offsets
    x = running_sums(pairs, key, [ts, lag], F.date_trunc("minute", F.col(ts)),
                     {"_i": F.lit(1), "_k": F.col(lag).isNotNull().cast("int")})
    # the numbered incidents feed the branches below: materialise them once
    x = _cut(x.select(*key, ts, lag, "_i", "_k"))
    has_lag = F.col(lag).isNotNull()
    # one aggregation: counts, first / last seen, the first lag sample, the 3rd sample
    # (probable needs >= 3 samples and >= 3 incidents)
    agg = x.groupBy(*key).agg(
        F.count(F.lit(1)).alias("incident_count"), F.max(ts).alias("last_seen_at"), F.min(ts).alias("first_seen_at"),
        F.min_by(F.struct(F.col("_i").alias("i"), F.col(lag).cast("double").alias("med"), F.lit(0.0).alias("sd")),
                 F.when(has_lag, F.col("_i"))).alias("_first"),
        F.min(F.when(has_lag & (F.col("_k") == MIN_INCIDENTS), F.col("_i"))).alias("_i3"))
    s = x.filter(has_lag)
    # First incident at which the running median of the last 50 samples is >= 0.
    # When a pair's first sample is >= 0 that sample is the answer (median of one
    # value, deviation 0); only pairs starting with a negative lag need the
    # running window of medians.
    hard = s.join(agg.filter(F.col("_first.med") < 0).select(*key), key, "left_semi")
    hard_c = _first_median(hard, key, ts, lag)
    # final sample window (last 50 non-null lags); the rank filter is applied per partition first
    wl = Window.partitionBy(*key).orderBy(F.col(ts).desc(), F.col(lag).desc())
    last = s.withColumn("_r", F.row_number().over(wl)).filter(F.col("_r") <= MAX_LAG_SAMPLES) \
            .groupBy(*key).agg(F.array_sort(F.collect_list(F.col(lag).cast("double"))).alias("_last"))
    e = agg.join(hard_c, key, "left").join(last, key, "left")
    e = e.withColumn("_c", F.when(F.col("_first.med") >= 0, F.col("_first")).otherwise(F.col("_hc"))) \
         .drop("_first", "_hc")
    return _promoted(e, p_values, topology)


def _first_median(hard: DataFrame, key: list[str], ts: str, lag: str) -> DataFrame:
    """(key, _hc) the first sample at which the median of the last ``MAX_LAG_SAMPLES`` is not negative:
    its incident, that median and the deviation. Signs and the two values next to zero decide
    where it is; only that one window is sorted."""
    v = F.col(lag).cast("double")
    ws = Window.partitionBy(*key).orderBy(ts, lag).rowsBetween(-(MAX_LAG_SAMPLES - 1), 0)
    hard = hard.select(*key, "_i", "_k", v.alias("_v"), F.count(F.lit(1)).over(ws).alias("_n"), F.count_if(v < 0).over(ws).alias("_neg"),
                       F.max(F.when(v < 0, v)).over(ws).alias("_below"), F.min(F.when(v >= 0, v)).over(ws).alias("_above"))
    ok = (2 * F.col("_neg") < F.col("_n")) | ((2 * F.col("_neg") == F.col("_n")) & (F.col("_below") + F.col("_above") >= 0))
    hit = hard.filter(ok).groupBy(*key).agg(F.min(F.struct("_k", "_i")).alias("_hit"))
    win = hard.select(*key, "_k", "_v").join(hit, key) \
              .filter((F.col("_k") <= F.col("_hit._k")) & (F.col("_k") > F.col("_hit._k") - MAX_LAG_SAMPLES)) \
              .groupBy(*key).agg(F.first("_hit._i").alias("_i"), F.array_sort(F.collect_list("_v")).alias("_win"))
    return win.select(*key, F.struct(F.col("_i").alias("i"), _median_sorted(F.col("_win")).alias("med"),
                                     _stdev(F.col("_win")).alias("sd")).alias("_hc"))


def summarize_edges(pairs: DataFrame, lag: str = "lag_ms", ts: str = "ts") -> DataFrame:
    """What of an edge's co-occurrences can be merged with other parts of them in any order: a
    row for each edge with the number of incidents and of those without a lag, first and last
    time, the earliest incident and the last ``MAX_LAG_SAMPLES`` samples with their times."""
    key = ["source_entity", "target_entity"]
    at = F.struct(F.col(ts).alias("t"), F.col(lag).cast("double").alias("lag"))
    agg = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("incident_count"), F.count_if(F.col(lag).isNull()).alias("n_bare"),
                                  F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"), F.min(at).alias("first"))
    wl = Window.partitionBy(*key).orderBy(F.col(ts).desc(), F.col(lag).desc())
    last = pairs.filter(F.col(lag).isNotNull()).withColumn("_r", F.row_number().over(wl)).filter(F.col("_r") <= MAX_LAG_SAMPLES) \
                .groupBy(*key).agg(F.collect_list(at).alias("last"))
    none = F.array().cast(last.schema["last"].dataType)
    return agg.join(last, key, "left").withColumn("last", F.coalesce("last", none))


def merge_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """The summary of the co-occurrences of two summaries of :func:`summarize_edges`."""
    last = F.slice(F.sort_array(F.flatten(F.collect_list("last")), asc=False), 1, MAX_LAG_SAMPLES)
    return a.unionByName(b).groupBy("source_entity", "target_entity").agg(
        F.sum("incident_count").alias("incident_count"), F.sum("n_bare").alias("n_bare"), F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"), F.min("first").alias("first"), last.alias("last"))


def summary_tells() -> Column:
    """Whether a summary says all of its edge: every incident has a lag and the earliest one is not negative,
    so that sample alone is the first median that is not. Other edges need their rows."""
    return (F.col("n_bare") == 0) & (F.col("first.lag") >= 0)


def edges_of_summaries(summaries: DataFrame) -> DataFrame:
    """The rows of :func:`rollup_edges` of the edges whose summary tells all (:func:`summary_tells`)."""
    e = summaries.filter(summary_tells()).select(
        "source_entity", "target_entity", "incident_count", "last_seen_at", "first_seen_at",
        F.when(F.col("incident_count") >= MIN_INCIDENTS, F.lit(MIN_INCIDENTS).cast("long")).alias("_i3"),
        F.array_sort(F.transform("last", lambda x: x["lag"])).alias("_last"),
        F.struct(F.lit(1).cast("long").alias("i"), F.col("first.lag").alias("med"), F.lit(0.0).alias("sd")).alias("_c"))
    return _promoted(e)


def _promoted(e: DataFrame, p_values: DataFrame | None = None, topology: DataFrame | None = None) -> DataFrame:
    """Level, confidence and lag statistics of edges with their counts, times, ``_i3`` (incident of
    the third sample), ``_c`` (of the first median that is not negative) and ``_last`` samples."""
    key = ["source_entity", "target_entity"]
    if p_values is not None:
        e = e.join(p_values.select(*key, "p_value"), key, "left")
    else:
        e = e.withColumn("p_value", F.lit(None).cast("double"))
    if topology is not None:
        e = e.join(topology.select(*key, "has_path"), key, "left") \
             .withColumn("has_path", F.coalesce(F.col("has_path"), F.lit(False)))
    else:
        e = e.withColumn("has_path", F.lit(True))
    stat = F.coalesce(F.col("p_value") < P_THRESHOLD, F.lit(False))
    prob_i = F.when(F.col("_i3").isNotNull() & (stat | F.col("has_path")), F.greatest(F.col("_i3"), F.lit(MIN_INCIDENTS)))
    e = e.withColumn("_pi", prob_i)
    corr_ok = F.col("_c").isNotNull() & (F.col("_pi").isNull() | (F.col("_c.i") <= F.col("_pi")))
    conf_prob = F.least(F.lit(0.85), F.lit(0.4) + F.when(stat, 0.2).otherwise(0.0)
                        + F.when(F.col("has_path"), 0.15).otherwise(0.0)
                        + F.least(F.col("_pi") * 0.02, F.lit(0.1)))
    conf_corr = F.least(F.lit(0.4), F.lit(0.1) + F.col("_c.i") * 0.05)
    last = F.coalesce(F.col("_last"), F.array().cast("array<double>"))
    return e.select(
        *key, "incident_count", "first_seen_at", "last_seen_at",
        F.when(F.col("_pi").isNotNull(), F.lit("probable_cause")).when(corr_ok, F.lit("correlates_with"))
         .otherwise(F.lit("observed")).alias("promotion_level"),
        F.when(F.col("_pi").isNotNull(), conf_prob).when(corr_ok, conf_corr).otherwise(F.lit(0.1)).alias("confidence"),
        F.when(corr_ok, F.bround(F.col("_c.med"), 2)).alias("temporal_precedence_ms"),
        F.when(corr_ok, F.bround(F.col("_c.sd"), 2)).alias("temporal_std_ms"),
        F.size(last).alias("n_lag_samples"), last.alias("lag_samples_ms"), "p_value")


def lag_stats(edges: DataFrame, samples: str = "lag_samples_ms") -> DataFrame:
    """CG3: median and sample standard deviation of the kept lag samples (n < 2 -> 0), 2 dp."""
    a = F.array_sort(F.col(samples))
    return edges.withColumn("median_lag_ms", F.bround(_median_sorted(a), 2)) \
                .withColumn("stdev_lag_ms", F.bround(_stdev(a), 2))


def edges_at_least(edges: DataFrame, level: str = "observed") -> DataFrame:
    """CG10: edges at or above a promotion level (unknown level -> observed)."""
    lv = LEVELS.index(level) if level in LEVELS else 0
    return edges.filter(level_rank(F.col("promotion_level")) >= lv)


def confirm(edges: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CG8: edges not yet confirmed (observed, correlates_with, probable_cause) that a
    confirmation names become confirmed_cause with confidence 1; returns (edges,
    not_found confirmations)."""
    key = ["source_entity", "target_entity"]
    c = confirmations.dropDuplicates(key).select(*key, F.col("confirmed_by").alias("_by"))
    eligible = F.col("promotion_level").isin("observed", "correlates_with", "probable_cause")
    j = edges.join(c, key, "left").withColumn("_hit", eligible & F.col("_by").isNotNull())
    hit = F.col("_hit")
    out = j.withColumn("promotion_level", F.when(hit, F.lit("confirmed_cause")).otherwise(F.col("promotion_level"))) \
           .withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence"))) \
           .withColumn("confirmed_by", F.when(hit, F.col("_by"))).drop("_by", "_hit")
    found = edges.filter(eligible).select(*key)
    not_found = confirmations.join(found, key, "left_anti")
    return out, not_found


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage between hops: reliable checkpoint to the shared checkpoint dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def topology_path(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None, exclude_self_edge: bool = False) -> DataFrame:
    """CG7: shortest undirected path between two entities, as a node list
    (the lexicographically smallest among equally short ones). Level-synchronous
    BFS for all pairs at once; visited rows are removed with an anti join and
    each hop is checkpointed. The search ends when the frontier is empty, or after
    ``max_depth`` hops if that is given. ``exclude_self_edge`` ignores the direct edge of
    the pair being tested."""
    und = edges.select(F.col("source_entity").alias("a"), F.col("target_entity").alias("b")) \
        .unionByName(edges.select(F.col("target_entity").alias("a"), F.col("source_entity").alias("b"))).distinct()
    und = _cut(und)  # the adjacency is joined once per hop: materialise it once
    p = _cut(pairs.select(F.col("source_entity").alias("src"), F.col("target_entity").alias("dst")).distinct())
    frontier = p.select("src", "dst", F.col("src").alias("node"), F.array(F.col("src")).alias("path"))
    visited = frontier.select("src", "dst", "node")
    found = None
    for _ in itertools.count() if max_depth is None else range(max_depth):
        step = frontier.join(und, frontier["node"] == und["a"])
        if exclude_self_edge:
            step = step.filter(~(((F.col("node") == F.col("src")) & (F.col("b") == F.col("dst")))
                                 | ((F.col("node") == F.col("dst")) & (F.col("b") == F.col("src")))))
        nxt = step.select("src", "dst", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path")) \
                  .join(visited, ["src", "dst", "node"], "left_anti") \
                  .groupBy("src", "dst", "node").agg(F.min("path").alias("path"))
        nxt = _cut(nxt)   # one reliable checkpoint per hop
        hit = nxt.filter(F.col("node") == F.col("dst")).select("src", "dst", "path")
        found = hit if found is None else found.unionByName(hit)
        frontier = nxt.filter(F.col("node") != F.col("dst")).join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(nxt.select("src", "dst", "node"))
    res = p.join(found, ["src", "dst"], "left") if found is not None else p.withColumn("path", F.lit(None))
    return res.select(F.col("src").alias("source_entity"), F.col("dst").alias("target_entity"), "path",
                      F.col("path").isNotNull().alias("has_path"))


def causal_chain(edges: DataFrame, starts: DataFrame, direction: str = "upstream", min_level: str = "correlates_with",
                 max_depth: int = 5, compat: bool = True) -> DataFrame:
    """CG9: BFS from every start entity over edges at or above ``min_level``.

    Upstream follows edges into the node (neighbour = source), downstream out of
    it; ``both`` is downstream in compat mode (as the reference's else branch),
    else the union. Each newly reached node contributes the one edge that reached
    it first (ties: smallest (via, source, target)); output is nearest first
    (``hop``)."""
    lv = LEVELS.index(min_level) if min_level in LEVELS else 0
    e = edges.filter(level_rank(F.col("promotion_level")) >= lv) \
             .select("source_entity", "target_entity", "promotion_level", "confidence")
    if direction == "upstream":
        dirs = [("target_entity", "source_entity")]
    elif direction == "both" and not compat:
        dirs = [("target_entity", "source_entity"), ("source_entity", "target_entity")]
    else:
        dirs = [("source_entity", "target_entity")]
    adj = None
    for via, nb in dirs:
        a = e.select(F.col(via).alias("via"), F.col(nb).alias("nbr"), "source_entity", "target_entity",
                     "promotion_level", "confidence")
        adj = a if adj is None else adj.unionByName(a)
    adj = _cut(adj)  # joined once per hop: materialise it once
    st = starts.select(F.col("start").alias("start")).distinct()
    frontier = st.select("start", F.col("start").alias("node"))
    visited = frontier
    chain = None
    for hop in range(1, max_depth + 1):
        step = frontier.join(adj, frontier["node"] == adj["via"]).join(
            visited.withColumnRenamed("node", "nbr"), ["start", "nbr"], "left_anti")
        best = step.groupBy("start", "nbr").agg(F.min_by(F.struct("source_entity", "target_entity", "promotion_level",
                                                                  "confidence"),
                                                         F.struct("via", "source_entity", "target_entity")).alias("e"))
        # one reliable checkpoint per hop; frontier and visited are unions of
        # checkpointed frames, so their lineage stays short without more cuts
        best = _cut(best.select("start", "nbr", F.lit(hop).alias("hop"), "e.*"))
        chain = best if chain is None else chain.unionByName(best)
        frontier = best.select("start", F.col("nbr").alias("node"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return chain.drop("nbr")


# ------------------------------------------------------------------ entity registry


def merge_entities(target: DataFrame, batch: DataFrame) -> DataFrame:
    """CG13: upsert by canonical_name: aliases and repos as set unions (sorted),
    description replaced when given, metadata maps merged (batch wins); new names
    are inserted. ``batch`` holds at most one row per name (apply in order)."""
    k = "canonical_name"
    t = target.alias("t")
    b = batch.alias("b")
    j = t.join(b, k, "full_outer")

    def arr(c):
        return F.coalesce(F.col(c), F.array().cast("array<string>"))

    new_meta = F.col("b.metadata_json")
    old_meta = F.col("t.metadata_json")
    meta = F.when(new_meta.isNull() | (F.size(new_meta) == 0), old_meta).when(old_meta.isNull(), new_meta) \
            .otherwise(F.map_concat(F.map_filter(old_meta, lambda kk, v: ~F.array_contains(F.map_keys(new_meta), kk)),
                                    new_meta))
    return j.select(
        k, F.coalesce(F.col("t.entity_type"), F.col("b.entity_type")).alias("entity_type"),
        F.array_sort(F.array_distinct(F.concat(arr("t.aliases"), arr("b.aliases")))).alias("aliases"),
        F.array_sort(F.array_distinct(F.concat(arr("t.repos"), arr("b.repos")))).alias("repos"),
        F.coalesce(F.when(F.col("b.description") != "", F.col("b.description")), F.col("t.description")).alias("description"),
        meta.alias("metadata_json"),
        F.coalesce(F.col("t.deprecated"), F.lit(False)).alias("deprecated"))


def list_entities(df: DataFrame, entity_type: str | None = None, deprecated: bool = False) -> DataFrame:
    """CG14: entities of a type (optional) and deprecation state, by name."""
    out = df.filter(F.col("deprecated") == F.lit(deprecated))
    if entity_type:
        out = out.filter(F.col("entity_type") == entity_type)
    from .ordering import global_rank
    return global_rank(out, [F.col("canonical_name")])


def deprecate(df: DataFrame, names: DataFrame) -> DataFrame:
    """CG15: mark the named entities deprecated (edges are untouched)."""
    n = names.select(F.col("canonical_name")).distinct().withColumn("_hit", F.lit(True))
    return df.join(n, "canonical_name", "left") \
             .withColumn("deprecated", F.col("deprecated") | F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def resolve_aliases(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """CG16: entity names that are aliases are replaced by their canonical name."""
    al = registry.select(F.explode("aliases").alias("alias"), "canonical_name") \
                 .groupBy("alias").agg(F.min("canonical_name").alias("canon"))
    out = edges
    for c in ("source_entity", "target_entity"):
        a = al.withColumnRenamed("alias", c).withColumnRenamed("canon", f"_{c}")
        out = out.join(a, c, "left").withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out


def ingest_deployments(deploys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CG12: deployments (service_name, version, environment, repo_id, ts, order) ->
    (entities, co-occurrence rows). The entity keeps the latest version and
    environment and the repos in order of first appearance; every deployment adds
    a lag-0 co-occurrence ``deployment:svc:ver -> svc``."""
    d = deploys
    key = F.struct(F.col("ts"), F.col("order"))
    firsts = d.filter(F.col("repo_id").isNotNull()).groupBy("service_name", "repo_id").agg(F.min(key).alias("_f"))
    repos = firsts.groupBy("service_name").agg(F.array_sort(F.collect_list(F.struct("_f", "repo_id"))).alias("_r")) \
                  .select("service_name", F.transform("_r", lambda x: x["repo_id"]).alias("repos"))
    latest = d.groupBy("service_name").agg(F.max_by(F.struct("version", "environment"), key).alias("_l"),
                                           F.count(F.lit(1)).alias("deployments"))
    ent = latest.join(repos, "service_name", "left").select(
        F.col("service_name").alias("canonical_name"), F.lit("Service").alias("entity_type"),
        F.coalesce(F.col("repos"), F.array().cast("array<string>")).alias("repos"),
        F.col("_l.version").alias("last_version"), F.col("_l.environment").alias("environment"), "deployments")
    pairs = d.select(F.concat(F.lit("deployment:"), F.col("service_name"), F.lit(":"),
                              F.coalesce(F.col("version"), F.lit("unknown"))).alias("source_entity"),
                     F.col("service_name").alias("target_entity"), F.lit(0.0).alias("lag_ms"), "ts")
    return ent, pairs
