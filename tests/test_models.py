import numpy as np
from pyspark.sql import functions as F

from logweave.operators import drain as D
from logweave.operators import granger as GR


def test_drain_clusters_similar_messages():
    d = D.Drain()
    a = d.add("Connection to db1 failed after 3 retries")
    b = d.add("Connection to db2 failed after 5 retries")
    c = d.add("User alice logged in")
    assert a[1] == b[1] != c[1]
    assert b[0] == "Connection to <*> failed after <*> retries"


def test_drain_keeps_templates_apart_without_a_cluster_limit(spark):
    """More clusters than 2000 and more first tokens than 100 in one service; another service beside it."""
    words = ["".join(chr(97 + i // 26 ** k % 26) for k in range(3)) for i in range(1050)]
    texts = [f"{w} {a}" for w in words for a in ("started a b c d", "stopped e f g h")]
    rows = [("hot", t, i) for i, t in enumerate(texts)] + [("cold", t, i) for i, t in enumerate(texts[:10])]
    df = spark.createDataFrame(rows, "service_name string, template string, log_id long").withColumn("ts", F.timestamp_seconds("log_id"))
    got = D.drain_templates(df).collect()
    hot = [r for r in got if r.service_name == "hot"]
    assert len(got) == len(rows) and len({r.drain_cluster_id for r in hot}) == len(texts)
    assert all(r.template == r.cluster_template for r in got)


def test_drain_groups_by_length_equal_one_tree(spark):
    texts = [f"job {k % 7} took {k} ms" + " of time" * (k % 4) for k in range(60)] + ["", " ", "a\u00a0b c", "a b c", "a\u2003b\x1fc", "a\u200bb c", "x\u0085y z"]
    df = spark.createDataFrame([("s", t, i) for i, t in enumerate(texts)], "service_name string, template string, log_id long") \
              .withColumn("ts", F.timestamp_seconds("log_id"))
    got = {r.template: r for r in D.drain_templates(df).collect()}
    d = D.Drain()
    one = {t: d.add(t) for t in texts}
    for r in got.values():
        assert r.drain_template == one[r.template][0] and r.drain_cluster_id.split("-")[0] == str(len(r.template.split()))
    assert len({(one[t][1], got[t].drain_cluster_id) for t in texts}) == len({c for _, c in one.values()}) \
        == len({r.drain_cluster_id for r in got.values()})


def test_distribution_tails():
    assert abs(GR.f_sf(4.10, 2, 10) - 0.0501) < 5e-4
    assert abs(GR.chi2_sf(3.841, 1) - 0.05) < 5e-4
    assert abs(GR.chi2_sf(20.0, 10) - 0.02925) < 5e-4
    assert abs(GR.chi2_sf(7.815, 3) - 0.05) < 5e-4
    # F tables at 5 %: (1, 5) 6.608, (1, 10) 4.965, (3, 7) 4.347, (3, 20) 3.098
    for f, d1, d2 in ((6.608, 1, 5), (4.965, 1, 10), (4.347, 3, 7), (3.098, 3, 20)):
        assert abs(GR.f_sf(f, d1, d2) - 0.05) < 5e-4


def test_granger_detects_lagged_driver():
    rng = np.random.default_rng(0)
    x = rng.poisson(5, 200).astype(float)
    y = np.roll(x, 1) * 2 + rng.normal(0, 0.5, 200)
    assert GR.granger_pvalue(y[1:], x[1:]) < 1e-6
    assert GR.granger_pvalue(rng.normal(size=200), rng.normal(size=200)) > 1e-3
    assert GR.granger_pvalue(np.ones(5), np.ones(5)) is None


def test_granger_of_sums_equals_the_series_form(spark):
    import datetime as dt
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    series = {}
    for k in range(12):
        n = [200, 60, 25, 11, 10, 9][k % 6]
        x = rng.poisson(4, n)
        y = np.roll(x, 1 + k % 3) * (k % 2) + rng.poisson(3, n)
        series[f"s{k}", "t"] = (y, x)
    series["flat", "t"] = (np.ones(50, int), rng.poisson(4, 50))
    series["self", "t"] = (x1 := rng.poisson(4, 50), x1)
    series["perfect", "t"] = (np.r_[0, x1[:-1]], x1)
    rows = [(a, b, t0 + dt.timedelta(hours=i), int(v), int(u)) for (a, b), (y, x) in series.items() for i, (v, u) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "source_entity string, target_entity string, hour timestamp, n_target long, n_source long")
    got = {r["source_entity"]: (r["n_points"], r["p_value"]) for r in GR.granger(df.repartition(5)).collect()}
    for (a, _), (y, x) in series.items():
        want = None if a == "perfect" else GR.granger_pvalue(y, x)
        assert got[a][0] == len(y)
        if want is None:
            assert got[a][1] is None, a
        else:
            assert abs(got[a][1] - want) <= 1e-6 * max(want, 1e-3), (a, got[a], want)
    assert sum(v[1] is not None for v in got.values()) >= 9 and GR.granger(df.limit(0)).count() == 0
