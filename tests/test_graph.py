import datetime as dt

from pyspark.sql import functions as F

from logweave.operators import graph as G

from .conftest import rows


def pairs(spark, data):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, t, lag, t0 + dt.timedelta(minutes=i)) for i, (s, t, lag) in enumerate(data)],
                                 "source_entity string, target_entity string, lag_ms double, ts timestamp")


def test_promotion_ladder(spark):
    data = [("a", "b", None), ("a", "b", 100.0), ("a", "b", 50.0), ("a", "b", 70.0),   # correlates at 2, probable at 4
            ("c", "d", -5.0), ("c", "d", -7.0), ("c", "d", -1.0),                      # negative lags: probable directly
            ("e", "f", 10.0)]                                                           # one incident
    e = {(r["source_entity"], r["target_entity"]): r for r in G.lag_stats(G.rollup_edges(pairs(spark, data))).collect()}
    ab, cd, ef = e[("a", "b")], e[("c", "d")], e[("e", "f")]
    assert ab["promotion_level"] == "probable_cause" and abs(ab["confidence"] - min(0.85, 0.55 + 0.08)) < 1e-9
    assert ab["temporal_precedence_ms"] == 100.0 and ab["temporal_std_ms"] == 0.0
    assert ab["median_lag_ms"] == 70.0 and ab["n_lag_samples"] == 3
    assert cd["promotion_level"] == "probable_cause" and cd["temporal_precedence_ms"] is None
    assert ef["promotion_level"] == "correlates_with" and abs(ef["confidence"] - 0.15) < 1e-9


def edges(spark, data):
    return spark.createDataFrame([(s, t, lv, 0.5) for s, t, lv in data],
                                 "source_entity string, target_entity string, promotion_level string, confidence double")


def test_paths_and_chains_with_cycle_parallel_and_self_loop(spark):
    e = edges(spark, [("a", "b", "correlates_with"), ("b", "c", "probable_cause"), ("c", "a", "correlates_with"),
                      ("a", "b", "probable_cause"), ("d", "d", "correlates_with"), ("c", "e", "observed")])
    p = G.topology_path(e, spark.createDataFrame([("a", "c"), ("a", "e"), ("a", "z")], "source_entity string, target_entity string"),
                        exclude_self_edge=False)
    got = {(r[0], r[1]): r[2] for r in rows(p, "source_entity", "target_entity", "path")}
    assert got[("a", "c")] == ["a", "c"] and got[("a", "e")] == ["a", "c", "e"] and got[("a", "z")] is None
    ch = G.causal_chain(e, spark.createDataFrame([("a",)], "start string"), "upstream", "correlates_with", 5)
    got = sorted(rows(ch, "hop", "source_entity", "target_entity"))
    assert got == [(1, "c", "a"), (2, "b", "c")]
    down = G.causal_chain(e, spark.createDataFrame([("a",)], "start string"), "both", "correlates_with", 5)
    assert sorted(rows(down, "hop", "source_entity", "target_entity")) == [(1, "a", "b"), (2, "b", "c")]


def test_confirm_and_entities(spark):
    e = edges(spark, [("a", "b", "correlates_with"), ("b", "c", "observed")])
    c = spark.createDataFrame([("a", "b", "me"), ("b", "c", "me"), ("x", "y", "me")],
                              "source_entity string, target_entity string, confirmed_by string")
    out, nf = G.confirm(e, c)
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(out, "source_entity", "target_entity", "promotion_level", "confidence")}
    assert got[("a", "b")] == ("confirmed_cause", 1.0) and got[("b", "c")] == ("confirmed_cause", 1.0)
    assert sorted(rows(nf, "source_entity")) == [("x",)]
    t = spark.createDataFrame([("pay", "Service", ["p"], ["r1"], "old", {"a": "1"}, False)],
                              "canonical_name string, entity_type string, aliases array<string>, repos array<string>, "
                              "description string, metadata_json map<string,string>, deprecated boolean")
    b = spark.createDataFrame([("pay", "Service", ["q", "p"], ["r2"], None, {"a": "2", "b": "3"})],
                              "canonical_name string, entity_type string, aliases array<string>, repos array<string>, "
                              "description string, metadata_json map<string,string>")
    m = G.merge_entities(t, b).first()
    assert m["aliases"] == ["p", "q"] and m["repos"] == ["r1", "r2"] and m["description"] == "old"
    assert m["metadata_json"] == {"a": "2", "b": "3"}


def test_path_has_no_depth_limit(spark):
    chain = [chr(ord("a") + i) for i in range(13)]
    e = edges(spark, [(x, y, "observed") for x, y in zip(chain, chain[1:])])
    pair = spark.createDataFrame([("a", "m")], "source_entity string, target_entity string")
    assert G.topology_path(e, pair).first()["path"] == chain
    assert G.topology_path(e, pair, max_depth=6).first()["has_path"] is False
