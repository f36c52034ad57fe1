"""The rule ensemble: statistics, compiled score, held-out accuracy, odd input."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import rulefit
from logweave.llm.queries import op13_rules

DIR = "/root/testdata/sf0.01"


def plain_statistics(text):
    """The statistics by their description."""
    b = (text or "").encode()
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w.encode() for w in words if w]
    lines = [x for x in b.split(b"\n") if x]
    n = len(words)
    symbol, mark = set(b"#$%&*+/<=>@[\\]^_`{|}~"), set(b".,;:!?'\"()-")
    letters = lambda w: sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w)
    upper = lambda w: sum(65 <= c <= 90 for c in w)
    noisy = lambda w: any(c in symbol for c in w)
    shouted = lambda w: upper(w) >= 2 and 2 * upper(w) > letters(w)
    per = lambda a, t: a / t if t else 0.0

    def in_lines(test):
        own = [[w for w in line.replace(b"\t", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if w] for line in lines]
        return per(sum(len(ws) for ws in own if 2 * sum(map(test, ws)) > len(ws)), n)
    return [math.log1p(n), per(sum(map(len, words)), n), per(len(set(words)), n), per(n, len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0,
            *(per(sum(test(c) for c in b), len(b)) for test in (lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in symbol,
                                                               lambda c: c in mark, lambda c: c >= 128)),
            per(sum(letters(w) == 0 for w in words), n), per(sum(map(noisy, words)), n), per(sum(map(shouted, words)), n),
            per(sum(2 * sum(c in mark for c in w) > len(w) for w in words), n), in_lines(noisy), in_lines(shouted)]


def odd_texts():
    rng = random.Random(1)
    some = ["".join(rng.choice(" ab\nC|!é1.\t日") for _ in range(rng.randint(0, 300))) for _ in range(80)]
    return [None, "", " \n\n ", "\n", "a", "|", "A B", "one\none\ntwo", "x" * 50_000, "word " * 50_000, *some, some[3], some[3]]


def test_statistics_equal_plain_ones(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id long, text string, label double, _id string")
    got = {r[0]: list(r)[1:] for r in rulefit.statistics(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_statistics(t)), (i, t)


def test_compiled_score_equals_the_model_by_hand(spark):
    model = rulefit.Ensemble(-0.25, [((("upper_share", 0.1, 0.5), ("log_words", -math.inf, 3.0)), 1.5), ((("symbol_share", 0.2, math.inf),), -2.0)],
                             [("word_length", 2.0, 6.0, 0.75)])
    rng = random.Random(2)
    rows = [[rng.choice([0.0, 0.1, 0.2, 0.3, 0.5, 2.0, 3.0, 9.0]) for _ in rulefit.STATISTICS] for _ in range(200)]
    got = spark.createDataFrame(rows, rulefit.STATISTICS).coalesce(1).select(model.score()).collect()
    for row, r in zip(rows, got):
        s = dict(zip(rulefit.STATISTICS, row))
        x = -0.25 + 1.5 * (0.1 < s["upper_share"] <= 0.5 and s["log_words"] <= 3) - 2 * (s["symbol_share"] > 0.2)
        x += 0.75 * (min(max(s["word_length"], 2), 6) - 2) / 4
        assert abs(r[0] - 1 / (1 + math.exp(-x))) < 1e-6


def test_rules_are_the_paths_of_the_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    rng = random.Random(4)
    rows = [[rng.random() for _ in rulefit.STATISTICS] for _ in range(300)]
    df = spark.createDataFrame([(*r, float(r[2] > 0.5 and r[7] < 0.4)) for r in rows], [*rulefit.STATISTICS, "label"]).coalesce(1)
    x = df.withColumn("features", array_to_vector(F.array(*rulefit.STATISTICS))).cache()
    model = RandomForestClassifier(numTrees=1, maxDepth=2, seed=1, subsamplingRate=1.0, featureSubsetStrategy="all").fit(x)
    rules = rulefit.tree_rules(model)
    leaves = [r for r in rules if sum((low > -math.inf) + (high < math.inf) for _, low, high in r) == 2]
    counts = x.select(*(F.sum(rulefit.holds(r).cast("int")).alias(str(i)) for i, r in enumerate(leaves))).first()
    one_deep = [r for r in rules if r not in leaves]
    assert len(one_deep) == 2 and sum(counts) <= 300 and len(rules) <= 6
    whole = x.select(*(F.sum(rulefit.holds(r).cast("int")).alias(str(i)) for i, r in enumerate(one_deep))).first()
    assert sum(whole) == 300  # the two sides of the root share out all rows


@pytest.fixture(scope="module")
def judged(spark):
    out = op13_rules(spark, DIR)
    return {r["doc_id"]: r for r in out.collect()}


def test_held_out_accuracy(spark, judged):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(judged[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in judged)
    good, bad = ([judged[i] for i in held if labels[i] == q] for q in (1, 0))
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.8 * len(bad)
    wins = sum((g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) >= 0.95


def test_every_row_has_a_score(spark, judged):
    assert len(judged) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in judged.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(rulefit.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r["doc_id"], r["score"]) for r in rulefit.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_null_and_repeated_ids_empty_tables_clashing_columns(spark):
    rows = [(None, "a b", 0.5, 1), (None, None, 0.5, 1), (3, "x", 0.1, 2), (3, "y | z", 0.1, 2), (4, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in rulefit.classify(df, none).collect()) == \
        [("3", False, 0.5), ("3", False, 0.5), ("4", False, 0.5), ("None", True, 0.5), ("None", True, 0.5)]
    one = spark.createDataFrame([(3, 1), (3, None), (None, 0), (4, 1)], "doc_id long, quality int")
    assert {r["score"] for r in rulefit.classify(df, one).collect()} == {1.0}
    assert rulefit.classify(df.limit(0), one).collect() == []
