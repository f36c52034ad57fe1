"""Service dependencies from source text: regex rules -> normalised targets ->
rollup per (source, target, type, file) -> graph, degrees, blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS

# Fixed values (must equal the reference): (kind, pattern) in rule order.
# (?U) gives Python's Unicode \s and \w; (?i), (?s), (?m) as in the reference.
RULES: list[tuple[str, str]] = [
    ("http", r"""(?iU)(?:requests|httpx|aiohttp|urllib)\s*\.\s*(?:get|post|put|patch|delete|request)\s*\(\s*['"]https?://([a-zA-Z0-9_.-]+)"""),
    ("http", r"""(?iU)(?:fetch|axios(?:\s*\.\s*(?:get|post|put|delete|patch))?|got)\s*\(\s*`?['"]https?://([a-zA-Z0-9_.-]+)"""),
    ("http", r"""(?iU)f?['"]https?://\{?(?:os\.(?:environ\.get|getenv)\s*\(\s*)?['"]?([A-Z][A-Z0-9_]*(?:_URL|_HOST|_ENDPOINT|_SERVICE))['")?}]"""),
    ("grpc", r"""(?iU)grpc\s*\.\s*(?:insecure_channel|secure_channel)\s*\(\s*f?['"]([a-zA-Z0-9_.-]+)"""),
    ("grpc", r"""(?U)grpc\.Dial\s*\(\s*"([a-zA-Z0-9_.-]+)"""),
    ("event", r"""(?isU)(?:KafkaProducer|Producer)\s*\(.*?bootstrap[._-]servers\s*[=:]\s*['"]([a-zA-Z0-9_.-]+)"""),
    ("event", r"""(?iU)(?:producer|client)\s*\.\s*(?:send|produce|publish)\s*\(\s*['"]([a-zA-Z0-9._-]+)['"]"""),
    ("event", r"""(?isU)PublisherClient\s*\(\s*\).*?\.publish\s*\(\s*['"]projects/[^'"]+/topics/([a-zA-Z0-9_.-]+)['"]"""),
    ("event", r"""(?isU)\.send_message\s*\(\s*QueueUrl\s*=.*?/([a-zA-Z0-9_.-]+)['"]"""),
    ("import", r"""(?mU)^(?:from|import)\s+([\w.]+)"""),
    ("import", r"""(?U)"(github\.com/[^"]+/[^"]+)\""""),
    ("env_ref", r"""(?iU)os\.(?:environ\.get|getenv)\s*\(\s*['"]([A-Z][A-Z0-9_]*(?:_URL|_HOST|_ENDPOINT|_SERVICE|_ADDR))['"]"""),
    ("env_ref", r"""(?U)process\.env\.([A-Z][A-Z0-9_]*(?:_URL|_HOST|_ENDPOINT|_SERVICE|_ADDR))"""),
]
# A text that every match of a rule holds (lower: looked for in the lower-cased file); a file
# without it is not searched. Of the rules that ignore case only letters count that no other
# character folds to (not i, k, s). Rules left out are searched in every file.
RULE_TEXTS: dict[int, tuple[str, bool]] = {
    0: ("://", False), 1: ("://", False), 2: ("://", False), 3: ("grpc", True), 4: ("grpc.Dial", False), 5: ("producer", True),
    7: ("projec", True), 8: ("queueurl", True), 10: ("github.com/", False), 11: ("env", True), 12: ("process.env.", False)}
# Generic names never taken as services.
IGNORED_TARGETS = ["localhost", "127-0-0-1", "0-0-0-0", "example", "example-com", "your-service",
                   "service", "host", "api", "internal", ""]
PATTERN_CHARS = 200
BLAST_HIGH, BLAST_MEDIUM = 5, 2


def normalise_target(raw: Column) -> Column:
    """SD2: lower, strip scheme, port and one suffix, ``_``/``.`` -> ``-``; generic
    or shorter than 3 characters -> null."""
    s = F.lower(F.regexp_replace(raw, f"^{WS_CLASS}+|{WS_CLASS}+$", ""))
    s = F.regexp_replace(s, r"^https?://", "")
    s = F.regexp_replace(s, r":[0-9]+$", "")
    s = F.regexp_replace(s, r"[_-](?:url|host|endpoint|service|addr)$", "")
    s = F.translate(s, "_.", "--")
    return F.when(s.isin(IGNORED_TARGETS) | (F.length(s) < 3), F.lit(None).cast("string")).otherwise(s)


def _rule_row(i: int, kind: str):
    def row(m, j):
        return F.struct(F.lit(i).alias("rule"), j.alias("pos"), F.lit(kind).alias("dependency_type"),
                        m["g1"].alias("raw"), F.substring(m["g0"], 1, PATTERN_CHARS).alias("source_pattern"))
    return row


def extract_matches(files: DataFrame, content: str = "content", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """SD1: every match of every rule (of the named ``kinds``): (…, rule, pos,
    dependency_type, raw, source_pattern). One scan: the per-rule match lists are
    concatenated in a single projection and exploded once."""
    per_rule = []
    for i, (kind, rx) in enumerate(RULES):
        if kinds is not None and kind not in kinds:
            continue
        # a match found again in its own text has the same group 1: no rule looks beyond its match
        z = F.transform(F.regexp_extract_all(F.col(content), F.lit(rx), 0),
                        lambda g: F.struct(g.alias("g0"), F.regexp_extract(g, rx, 1).alias("g1")))
        if i in RULE_TEXTS:
            text, lower = RULE_TEXTS[i]
            z = F.when(F.contains(F.lower(content) if lower else F.col(content), F.lit(text)), z).otherwise(
                F.array().cast("array<struct<g0:string,g1:string>>"))
        per_rule.append(F.transform(z, _rule_row(i, kind)))
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.explode(F.concat(*per_rule)).alias("_m")).select(*keep, "_m.*")


def _known_imports(imports: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Import matches with a component among the names. Equal rows are counted, then each row
    meets the names by its distinct components; one that meets several comes out once, and as
    often as it was there. The names are not made distinct: a semi join does not need it, and
    adaptive execution splits a hot component only where both sides come straight from a shuffle."""
    names = known.select(F.lower(F.col(name)).alias("_comp"))
    cols = imports.columns
    counted = imports.groupBy(*cols).agg(F.count(F.lit(1)).alias("_times"))
    comps = F.array_distinct(F.split(F.lower(F.col("raw")), "[./]"))
    hit = counted.withColumn("_comp", F.explode(comps)).join(names, "_comp", "left_semi")
    return hit.select(*cols, "_times").dropDuplicates() \
              .withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*cols)


def filter_imports(matches: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """SD3: import matches stay only when a ``.`` / ``/`` component of the raw
    module name is a known service (case-insensitive); other kinds pass. Names are
    joined, however many there are; a null name or raw module matches nothing, repeated rows
    stay repeated."""
    imports = matches.filter(F.col("dependency_type") == "import")
    return matches.filter(F.col("dependency_type") != "import").unionByName(_known_imports(imports, known, name))


def extract_dependencies(files: DataFrame, known: DataFrame, repo: str = "repo", content: str = "content") -> DataFrame:
    """SD1-SD4: matches -> normalised targets (null dropped) -> import filter ->
    self-dependencies dropped. Import rules run apart from the others, so that only their
    matches are joined and every rule runs once."""
    def targets(kinds: tuple[str, ...]) -> DataFrame:
        m = extract_matches(files, content, kinds).withColumn("target_name", normalise_target(F.col("raw")))
        return drop_self(m.filter(F.col("target_name").isNotNull()), repo)
    others = tuple(sorted({kind for kind, _ in RULES} - {"import"}))
    return targets(others).unionByName(_known_imports(targets(("import",)), known, "name"))


def drop_self(df: DataFrame, repo: str = "source_repo", target: str = "target_name") -> DataFrame:
    """SD4: a repository does not depend on itself."""
    return df.filter(F.col(target) != F.lower(F.col(repo)))


def resolve_target(df: DataFrame, repos: DataFrame, target: str = "target_name") -> DataFrame:
    """SD5: target repository id by lower-cased name (null when unknown)."""
    r = repos.select(F.lower("name").alias("_n"), F.col("id").alias("target_repo_id")).dropDuplicates(["_n"])
    return df.join(r, F.col(target) == F.col("_n"), "left").drop("_n")


def rollup_dependencies(df: DataFrame, source: str = "source_repo", target: str = "target_name",
                        order: list[str] | None = None) -> DataFrame:
    """SD6: one row per (source, target, type, file): call_count and the first
    matched pattern (insert keeps the first, a conflict only counts)."""
    keys = [source, target, "dependency_type", "source_file"]
    agg = [F.count(F.lit(1)).alias("call_count"), F.lit(1.0).alias("confidence")]
    if "source_pattern" in df.columns:
        agg.append(F.min_by("source_pattern", F.struct(*[F.col(c) for c in (order or ["rule", "pos"])]))
                   .alias("source_pattern"))
    return df.groupBy(*keys).agg(*agg)


def dependency_graph(repos: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SD7: nodes = all repositories; edges with a known target, or with no
    resolved target (target ``""``); targets resolved to unknown ids are dropped."""
    ids = repos.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    e = deps.join(ids, deps["target_repo_id"] == ids["_id"], "left")
    e = e.filter(F.col("target_repo_id").isNull() | F.col("_known").isNotNull()) \
         .withColumn("target", F.coalesce(F.col("target_repo_id"), F.lit(""))).drop("_id", "_known")
    return repos, e


def node_degrees(nodes: DataFrame, edges: DataFrame, source: str = "source_repo_id") -> DataFrame:
    """SD8: per node: outbound / inbound counts, first 3 outbound targets, first 2
    inbound sources, and the overflow beyond 5 shown rows. The shown rows are
    cut by rank per node before they are gathered (a hot node is not collected)."""
    wo = Window.partitionBy(source).orderBy("target_name", "dependency_type", "source_file")
    wi = Window.partitionBy("target").orderBy("source_repo", "dependency_type", "source_file")
    n_out = edges.groupBy(F.col(source).alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    n_in = edges.filter(F.col("target") != "").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    top_o = edges.withColumn("_r", F.row_number().over(wo)).filter("_r <= 3").groupBy(F.col(source).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("_r", "target_name", "dependency_type"))).alias("_o"))
    top_i = edges.filter(F.col("target") != "").withColumn("_r", F.row_number().over(wi)).filter("_r <= 2") \
                 .groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_r", "source_repo"))).alias("_i"))
    j = nodes.select("id", "name").join(n_out, "id", "left").join(n_in, "id", "left").join(top_o, "id", "left") \
             .join(top_i, "id", "left").na.fill(0, ["n_out", "n_in"])
    return j.select("id", "name", "n_out", "n_in",
                    F.array_join(F.transform(F.coalesce("_o", F.array()), lambda x: F.concat(
                        x["target_name"], F.lit(" ("), x["dependency_type"], F.lit(")"))), ", ").alias("outbound"),
                    F.array_join(F.transform(F.coalesce("_i", F.array()), lambda x: x["source_repo"]), ", ").alias("inbound"),
                    F.greatest(F.col("n_out") + F.col("n_in") - 5, F.lit(0)).alias("more"))


def blast_radius(deps: DataFrame, services: DataFrame, service: str = "service_name") -> DataFrame:
    """SD9: dependency rows targeting a service; >= 5 high, >= 2 medium, else low."""
    c = deps.groupBy(F.col("target_name").alias("_t")).agg(F.count(F.lit(1)).alias("blast_radius"))
    s = services.select(service).distinct()
    j = s.join(c, F.lower(F.col(service)) == F.col("_t"), "left").drop("_t").na.fill(0, ["blast_radius"])
    lvl = F.when(F.col("blast_radius") >= BLAST_HIGH, F.lit("high")) \
           .when(F.col("blast_radius") >= BLAST_MEDIUM, F.lit("medium")).otherwise(F.lit("low"))
    return j.withColumn("blast_radius_level", lvl)
