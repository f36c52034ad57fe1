"""Canonical views: shape the driver tables into the log / code / graph domain.

The same SQL text runs in Spark (``spark.sql`` with DataFrame arguments) and in
DuckDB (the oracle), so inputs are identical on both sides. ``MICROS(x)`` is
expanded per engine. Every view reads its whole base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

VIEW_SQL: dict[str, str] = {
    "v_logs": """
SELECT event_id AS log_id, CAST(ts AS TIMESTAMP) AS ts,
       concat('svc-', CAST(user_id % 8 AS STRING)) AS service_name, 'raw' AS source,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                       WHEN 'signup' THEN 'INFO' WHEN 'click' THEN 'DEBUG' END AS level,
       concat('handler_', CAST(event_id % 5 AS STRING), '.py') AS file_reference,
       concat(event_type, ' in handler_', CAST(event_id % 5 AS STRING), '.py:', CAST(10 + event_id % 7 AS STRING),
              ' took ', CAST(CAST(floor(value) AS BIGINT) AS STRING), 'ms for user ', CAST(user_id AS STRING),
              CASE WHEN event_type = 'error' THEN ' TimeoutError: no reply' ELSE '' END) AS message,
       concat(substr(CAST(ts AS STRING), 1, 19), ' ', upper(event_type), ' handler_', CAST(event_id % 5 AS STRING), '.py:47 done') AS raw_line
FROM {events}""",
    "v_log_lines": """
SELECT CAST(floor(event_id / 50) AS BIGINT) AS doc_id, event_id % 50 AS line_no,
       CASE WHEN CAST(floor(event_id / 50) AS BIGINT) % 4 = 0
            THEN concat('{"level":"', event_type, '","msg":"took ', CAST(user_id AS STRING), 'ms","k":', CAST(event_id AS STRING), '}')
            WHEN event_id % 3 = 0
            THEN concat(substr(CAST(ts AS STRING), 1, 19), ' ', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'info' END, ' step ', CAST(user_id AS STRING))
            ELSE concat('  File "app/m', CAST(user_id % 9 AS STRING), '.py", line ', CAST(10 + event_id % 90 AS STRING)) END AS line
FROM {events}""",
    "v_files": """
SELECT concat('svc-', CAST(p_partkey % 20 AS STRING)) AS repo,
       concat('src/f', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.txt' WHEN 2 THEN '.bin' ELSE '.py' END) AS file_path,
       concat('import os', chr(10), 'from pay', CAST(p_size % 20 AS STRING), '.client import api', chr(10), '# ', p_name, chr(10), '# a', chr(10), '# b', chr(10),
              'def call_', CAST(p_partkey AS STRING), '():', chr(10), '    return requests.get("http://svc-', CAST(p_partkey % 25 AS STRING), ':8080/x")', chr(10),
              'class C:', chr(10), '    url = os.getenv("SVC_', CAST(p_size % 7 AS STRING), '_URL")', chr(10),
              '    def go(self):', chr(10), '        producer.send("topic-', CAST(p_size % 5 AS STRING), '")', chr(10)) AS content
FROM {part}""",
    "v_commits": """
SELECT concat('c', CAST(o_orderkey AS STRING)) AS sha, concat('repo', CAST(o_orderkey % 10 AS STRING)) AS repo_id,
       concat('dev', CAST(o_custkey % 50 AS STRING)) AS author_name,
       concat('dev', CAST(o_custkey % 50 AS STRING), '@example.org') AS author_email,
       CAST(o_orderdate AS TIMESTAMP) AS committed_at, o_orderpriority AS message
FROM {orders}""",
    "v_commit_files": """
SELECT concat('c', CAST(l_orderkey AS STRING)) AS sha,
       concat('src/p', CAST(l_partkey % 300 AS STRING),
              CASE l_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' ELSE '.md' END) AS file_path,
       CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions
FROM {lineitem}""",
    "v_chunks": """
SELECT p_partkey AS chunk_id, concat('repo', CAST(p_size % 10 AS STRING)) AS repo_id,
       concat('src/p', CAST(p_partkey % 300 AS STRING),
              CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' ELSE '.md' END) AS file_path,
       CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' END AS language,
       CAST(1 + 50 * floor(p_partkey / 300) AS BIGINT) AS start_line, CAST(60 + 50 * floor(p_partkey / 300) AS BIGINT) AS end_line,
       p_name AS chunk_content
FROM {part}""",
    # Raw dependency matches before SD6; targets svc-20..svc-24 stay unresolved.
    # Reads the whole lineitem table (no sampling filter).
    "v_deps": """
SELECT concat('svc-', CAST(l_suppkey % 20 AS STRING)) AS source_repo, concat('svc-', CAST(l_partkey % 25 AS STRING)) AS target_repo,
       CASE l_linenumber % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'event' WHEN 2 THEN 'grpc' WHEN 3 THEN 'import' ELSE 'env_ref' END AS dependency_type,
       concat('f', CAST(l_partkey % 3 AS STRING), '.py') AS source_file
FROM {lineitem}""",
    "v_edges": """
SELECT source_entity, target_entity, CAST(MICROS(ts) - MICROS(prev_ts) AS DOUBLE) / 1000 AS lag_ms, CAST(ts AS TIMESTAMP) AS ts
FROM (SELECT ts, concat(event_type, '-', CAST(event_id % 6 AS STRING)) AS target_entity,
             lag(concat(event_type, '-', CAST(event_id % 6 AS STRING))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source_entity,
             lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
      FROM {events}) t
WHERE source_entity IS NOT NULL AND source_entity <> target_entity""",
    "v_traces": """
SELECT event_id AS trace_id, concat('svc-', CAST(user_id % 8 AS STRING)) AS service, event_type AS operation,
       value * 10 AS duration_ms, CAST(ts AS TIMESTAMP) AS ts
FROM {events}""",
}

_MICROS = re.compile(r"MICROS\(([^()]*)\)")
_TABLE_REF = re.compile(r"\{(\w+)\}")


def _spark_text(sql: str) -> str:
    sql = _MICROS.sub(lambda m: f"unix_micros(CAST({m.group(1)} AS TIMESTAMP))", sql)
    # spark.sql formats its text: escape literal braces, keep the table references
    sql = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql)


def _duck_text(sql: str) -> str:
    # DuckDB: table names are the registered views; STRING is an alias of VARCHAR
    sql = _MICROS.sub(lambda m: f"epoch_us({m.group(1)})", sql)
    return _TABLE_REF.sub(lambda m: m.group(1), sql)


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The view; ``spread`` deals the rows of its tables out to all cores, for work that is much
    more than reading them (a small file is read by one task)."""
    sql = VIEW_SQL[name]
    refs = {t: table(spark, sf_dir, t) for t in set(_TABLE_REF.findall(sql))}
    if spread:
        refs = {t: df.repartition(4 * spark.sparkContext.defaultParallelism) for t, df in refs.items()}
    return spark.sql(_spark_text(sql), **refs)


def duck_view_sql(name: str) -> str:
    return _duck_text(VIEW_SQL[name]).strip()


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views for a DuckDB oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({duck_view_sql(n)})" for n in names) + "\n"
