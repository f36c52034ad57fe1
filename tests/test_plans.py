"""Native operators stay in the JVM: no Python evaluation node in their plans."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

NATIVE = ["concept_trend_all", "severity_gate", "rate_limit", "parse_log_lines", "chunk_files", "extract_dependencies",
          "edge_rollup", "log_stats", "classify_questions", "commit_risk", "unified_diff", "otlp_entries"]
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonMapInArrow",
                "MapInArrow")


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_nodes(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PYTHON_NODES), plan


def test_scan_prunes_columns(spark):
    df = E.queries()["severity_gate"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan  # only the two columns used


@pytest.mark.parametrize("name", ["rising_log_patterns", "filter_logs_kept"])
def test_only_the_dedup_fold_is_python(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the dedup fold (read by the rate limit's count and join) is the only Python step
    assert "MapInArrow" in plan
    assert not any(n in plan for n in PYTHON_NODES if n not in ("MapInArrow", "PythonMapInArrow"))


def test_queries_configure_a_foreign_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        E.queries()["log_stats"](spark, SF_SMALL)
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
