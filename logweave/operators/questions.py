"""Question planning as a batch job over a column of questions: classification,
entity extraction, retrieval plan, and plan-driven retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed as E
from . import graph as G
from . import vectors as V

# Fixed values (must equal the reference): signal patterns in priority order.
SIGNALS: list[tuple[str, str]] = [
    ("diagnostic", r"\b(why|cause|reason|root.cause|slow|latency|error|fail|crash|broken|timeout|exception|bug|issue|problem|debug|diagnos)\b"),
    ("exploratory", r"\b(how.does|explain|what.is|describe|overview|show.me|walk.me|understand|architecture|flow|works?)\b"),
    ("impact", r"\b(if|what.if|impact|affect|depend|downstream|upstream|cascade|break|remove|delete|migrate)\b"),
    ("ownership", r"\b(who|owner|owns|responsible|team|author|wrote|maintains?|contact)\b"),
    ("risk", r"\b(safe|risk|danger|vulnerable|security|pr|pull.request|review|deploy|change|merge|regression)\b"),
    ("historical", r"\b(when|history|last.week|yesterday|monday|incident|outage|previously|used.to|before|ago|changed|introduced)\b"),
]
QUOTED_RE = r"""['"]([^'"]{2,64})['"]"""
IDENT_RE = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+|[a-z]+-[a-z]+(?:-[a-z]+)*)\b"
MAX_GRAPH_DEPTH = 3
# Retrieval plan per class (code, logs, concepts, graph, depth,
# direction, code_k, log_k, concept_k, threshold override).
PLAN_RULES = [
    ("diagnostic", True, True, True, True, MAX_GRAPH_DEPTH, "upstream", 20, 15, 15, None),
    ("exploratory", True, False, False, True, 1, "both", 30, 10, 10, None),
    ("impact", True, True, True, True, MAX_GRAPH_DEPTH, "downstream", 15, 10, 10, None),
    ("ownership", True, False, False, True, 1, "both", 10, 10, 10, None),
    ("risk", True, True, True, True, 2, "both", 25, 10, 10, None),
    ("historical", True, True, True, False, 1, "both", 20, 20, 20, 0.2),
    ("general", True, True, False, False, 1, "both", 20, 10, 10, None),
]
RULES_SCHEMA = ("query_type string, use_code_retrieval boolean, use_log_retrieval boolean, "
                "use_concept_retrieval boolean, use_graph_traversal boolean, graph_depth int, graph_direction string, "
                "code_fetch_k int, log_fetch_k int, concept_fetch_k int, similarity_threshold_override double")


def signal_counts(q: Column) -> Column:
    return F.array(*[F.regexp_count(F.coalesce(q, F.lit("")), F.lit("(?iu)" + rx)) for _, rx in SIGNALS])


def classify(q: Column) -> Column:
    """QP1: the class with most signal matches; ties go to the earlier class; no
    match -> general."""
    counts = signal_counts(q)
    best = F.array_max(counts)
    names = F.array(*[F.lit(n) for n, _ in SIGNALS])
    return F.when(best == 0, F.lit("general")).otherwise(F.element_at(names, F.array_position(counts, best).cast("int")))


def extract_entities(q: Column) -> Column:
    """QP2: quoted names then CamelCase / kebab-case identifiers, distinct in order."""
    t = F.coalesce(q, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(QUOTED_RE), 1),
                                     F.regexp_extract_all(t, F.lit(IDENT_RE), 1)))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAN_RULES, RULES_SCHEMA)


def plan_questions(df: DataFrame, col: str = "question") -> DataFrame:
    """QP3: class, entities and the plan columns (broadcast join to the 7-row
    rules table, a fixed-size side)."""
    x = df.withColumn("query_type", classify(F.col(col))).withColumn("target_entities", extract_entities(F.col(col)))
    return x.join(F.broadcast(rules(df.sparkSession)), "query_type")


def plan_struct(plans: DataFrame) -> DataFrame:
    """QP4: the plan as one nested record (graph depth 0 when the graph is off)."""
    return plans.withColumn("plan", F.struct(
        "query_type", "target_entities",
        F.struct(F.col("use_code_retrieval").alias("code"), F.col("use_log_retrieval").alias("logs"),
                 F.col("use_concept_retrieval").alias("concepts"), F.col("use_graph_traversal").alias("graph"))
        .alias("layers"),
        F.when(F.col("use_graph_traversal"), F.col("graph_depth")).otherwise(F.lit(0)).alias("graph_depth"),
        "graph_direction"))


#: Columns of a question's vectors, one for each domain: code, and logs with their concepts.
DOMAIN_VECTORS = {"code": "code_embedding", "log": "log_embedding"}


def embed_questions(df: DataFrame, dim: int, col: str = "question", fn: dict | None = None) -> DataFrame:
    """A vector of the question in each domain, as the items of the domain are embedded.
    ``fn`` names a supplied model (:func:`embed.embed`) for a domain."""
    for domain, out in DOMAIN_VECTORS.items():
        df = E.embed(df, col, domain, dim, out=out, fn=(fn or {}).get(domain))
    return df


#: Hits from which on they meet their items by a merge, whatever size Spark takes a side to have.
MANY_HITS = 100_000


def retrieve(plans: DataFrame, code: DataFrame, logs: DataFrame, concepts: DataFrame | None = None,
             threshold: float = V.SIMILARITY_THRESHOLD, top_k: int = 5, qid: str = "query_id",
             rerank: bool | None = None, scorer=None) -> DataFrame:
    """QP5: each question runs only its enabled layers with its own fetch size
    and threshold; code hits are boosted by log hits (VE11), reranked on their text (VE12),
    then cut to ``top_k`` (VE13). Returns (query_id, layer, item_id, similarity, rank) and,
    where hits are reranked, rerank_score; no rows where no question asks for a layer.

    Questions with the vectors of :func:`embed_questions` meet each layer in its own domain;
    with a single ``embedding`` that one serves all. ``rerank`` is on where the questions hold
    ``question`` and the code ``content``, unless it is given; ``scorer`` as in
    :func:`embed.rerank`. The score is null for the other layers."""
    thr = F.coalesce(F.col("similarity_threshold_override"), F.lit(threshold))
    own = {d: F.col(c if c in plans.columns else "embedding").alias(DOMAIN_VECTORS[d]) for d, c in DOMAIN_VECTORS.items()}
    q = plans.select(qid, *own.values(), "use_code_retrieval", "use_log_retrieval", "use_concept_retrieval",
                     "code_fetch_k", "log_fetch_k", "concept_fetch_k", thr.alias("thr"))
    q = G._cut(q)   # every layer counts, searches and joins the questions: classify and embed them once
    if rerank is None:
        rerank = "question" in plans.columns and "content" in code.columns
    no_score = F.lit(None).cast("double").alias("rerank_score")
    columns = ["query_id", "layer", "item_id", "similarity", "rank"]

    def layer(items, switch, k_col, name, cols):
        qs = q.filter(F.col(switch))
        kmax, least, n = qs.agg(F.max(k_col), F.min("thr"), F.count(F.lit(1))).first()
        if kmax is None:
            return None
        vec = DOMAIN_VECTORS["code" if name == "code" else "log"]
        # boost, rerank and output read the hits: search once
        h = G._cut(V.knn(qs.select(qid, F.col(vec).alias("embedding")), items, int(kmax), qid=qid, least=least))
        # per-question limits: the join side grows with the questions, so AQE picks the strategy
        h = h.join(qs.select(F.col(qid).alias("query_id"), k_col, "thr"), "query_id") \
             .filter((F.col("rank") <= F.col(k_col)) & (F.col("similarity") >= F.col("thr")))
        h = h.drop(k_col, "thr")
        if cols:   # of many hits neither they nor the items are to be sent to all tasks
            h = V.attach(h.hint("merge") if n * kmax >= MANY_HITS else h, items, cols=cols)
        return h.withColumn("layer", F.lit(name))

    out = []
    ch = layer(code, "use_code_retrieval", "code_fetch_k", "code", ["file_path"])
    lg = layer(logs, "use_log_retrieval", "log_fetch_k", "log", ["file_reference"])
    if ch is not None:
        if lg is not None:
            ch = V.boost_by_logs(ch, lg)
        else:
            ch = ch.withColumn("cross_referenced", F.lit(False))
        if rerank:
            asked = plans.select(F.col(qid).alias("query_id"), "question")
            best = E.rerank(ch.drop("rank"), asked, top_k, scorer, items=code).withColumnRenamed("rerank_rank", "rank")
            out.append(best.select(*columns, "rerank_score"))
        else:
            out.append(V.top_k(ch.drop("rank"), top_k).select(*columns, no_score))
    if lg is not None:
        out.append(V.top_k(lg.drop("rank"), top_k).select(*columns, no_score))
    if concepts is not None:
        cc = layer(concepts, "use_concept_retrieval", "concept_fetch_k", "concept", None)
        if cc is not None:
            out.append(V.top_k(cc.drop("rank"), top_k).select(*columns, no_score))
    if not out:  # no question, or none that asks for a layer
        kinds = dict(plans.dtypes)[qid], dict(code.dtypes)["item_id"]
        return plans.sparkSession.createDataFrame(
            [], f"query_id {kinds[0]}, layer string, item_id {kinds[1]}, similarity double, rank int" + ", rerank_score double" * rerank)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res if rerank else res.drop("rerank_score")


def graph_context(plans: DataFrame, edges: DataFrame, qid: str = "query_id", compat: bool = True) -> DataFrame:
    """CG11: causal chains of each question's first three entities, with the
    question's direction and depth (questions with the graph layer on)."""
    g = plans.filter(F.col("use_graph_traversal") & (F.size("target_entities") > 0))
    starts = g.select(qid, "graph_direction", "graph_depth", F.explode(F.slice("target_entities", 1, 3)).alias("start"))
    out = None
    edges = G._cut(edges)   # every BFS below reads the edges: materialise them once
    # one BFS per (direction, depth) the questions use; the plan rules bound these to a handful
    combos = sorted((r[0], r[1]) for r in starts.select("graph_direction", "graph_depth").distinct().collect())
    for direction, depth in combos:
        s = starts.filter((F.col("graph_direction") == direction) & (F.col("graph_depth") == depth))
        ch = G.causal_chain(edges, s.select("start").distinct(), direction, "correlates_with", depth, compat)
        part = s.select(qid, "start").join(ch, "start")
        out = part if out is None else out.unionByName(part)
    if out is None:   # no question uses the graph: an empty result with the chain schema
        qtype = dict(starts.dtypes)[qid]
        out = plans.sparkSession.createDataFrame(
            [], f"{qid} {qtype}, start string, hop int, source_entity string, target_entity string, "
                "promotion_level string, confidence double")
    return out
