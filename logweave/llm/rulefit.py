"""Quality classifier: a sparse ensemble of rules over text statistics.

One Arrow pass writes ``STATISTICS`` of every whole text. Trees grown on labelled rows
(random forest, shallow) give candidate rules: each path from the root to a node is a
conjunction of thresholds. A logistic regression with an L1 penalty keeps a few rules and
statistics; these become one Spark column expression, so that all rows are
scored without Python. The model is plain data (``Ensemble``).

Learning reads at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id; all
rows are scored. Labels: a row's label is the rounded mean of its id's labels (ties: 1); null ids
and labels teach nothing. Without labels the score is 0.5 everywhere, with one class alone that
class. Null and empty texts have all statistics 0 and are scored like any other. Repeated rows
are scored each on their own. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LINE_END, Words, blocks, id_text, prepare, scratch, text_buffers

#: Labelled rows that the trees and the regression are fitted on (expected number).
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 7
#: Rules that hold for a smaller part of the training rows, or for all but that, are left out.
LEAST_SUPPORT = 0.005
PENALTY = 0.002
#: Partitions of the training rows; there is little of them.
TRAIN_PARTS = 4

STATISTICS = [
    "log_words", "word_length", "distinct_share", "line_words", "repeated_lines",
    "upper_share", "digit_share", "symbol_share", "mark_share", "other_share",
    "bare_words", "symbol_words", "upper_words", "marked_words", "symbol_lines", "upper_lines"]

_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, _OTHER = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT | _MARK)
_OTHER[128:] = True


def _per(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    return counts / np.maximum(total, 1)


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each span are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def _statistics(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each document of a block."""
    n = len(o) - 1
    w, lines = Words(d, o), Words(d, o, space=LINE_END)
    count = w.count
    size = np.diff(o)
    of_word, of_line = np.repeat(np.arange(n), count), np.repeat(np.arange(n), lines.count)

    def share(hit: np.ndarray) -> np.ndarray:
        return _per(np.bincount(of_word[hit], minlength=n), count)

    def different(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
        order = np.lexsort((code, owner))
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        return np.bincount(owner[order][new], minlength=n)

    letters, upper, symbols, marks = (_within(k[d], w.starts, w.ends) for k in (_LETTER, _UPPER, _SYMBOL, _MARK))
    chars = w.ends - w.starts
    shouted = (upper >= 2) & (2 * upper > letters)
    with_symbol = symbols > 0
    line_words = np.searchsorted(w.starts, lines.ends) - np.searchsorted(w.starts, lines.starts)
    noisy_line = np.add.reduceat(np.r_[with_symbol, False].astype(np.int64), np.searchsorted(w.starts, lines.starts)) if len(lines.starts) else np.zeros(0)
    shout_line = np.add.reduceat(np.r_[shouted, False].astype(np.int64), np.searchsorted(w.starts, lines.starts)) if len(lines.starts) else np.zeros(0)
    in_words = np.where(line_words > 0, line_words, 0)
    return np.column_stack([
        np.log1p(count), _per(np.bincount(of_word, weights=chars, minlength=n), count),
        _per(different(of_word, w.code), count), _per(count, lines.count),
        1 - _per(different(of_line, lines.code), lines.count) - (lines.count == 0),
        *(_per(_within(k[d], o[:-1], o[1:]), size) for k in (_UPPER, _DIGIT, _SYMBOL, _MARK, _OTHER)),
        share(letters == 0), share(with_symbol), share(shouted), share(marks * 2 > chars),
        _per(np.bincount(of_line, weights=in_words * (2 * noisy_line > line_words), minlength=n), count),
        _per(np.bincount(of_line, weights=in_words * (2 * shout_line > line_words), minlength=n), count)])


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, one double for each of ``STATISTICS``) of every row."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, offs = text_buffers(rb.column(1))
            for i, j, d, o in blocks(data, offs):
                table = _statistics(d, o)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, j - i), *map(pa.array, np.ascontiguousarray(table.T))], ["_id", *STATISTICS])

    x = id_text(df, id_col, text_col)
    kind = x.schema["_id"].dataType.simpleString()
    return x.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))


#: A rule: for each statistic in it, (lower bound, excluded; upper bound, included).
Rule = tuple[tuple[str, float, float], ...]


@dataclass
class Ensemble:
    """The fitted model: score = 1 / (1 + exp(-(intercept + weights)))."""
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float]] = field(default_factory=list)  # statistic, low, high, weight

    def score(self) -> Column:
        """The compiled score, over the columns ``STATISTICS``."""
        x = F.lit(self.intercept)
        for rule, weight in self.rules:
            x = x + F.when(holds(rule), weight).otherwise(0.0)
        for name, low, high, weight in self.linear:
            x = x + clipped(name, low, high) * weight
        return F.round(1 / (1 + F.exp(-x)), 6)


def holds(rule: Rule) -> Column:
    cond = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            cond = cond & (F.col(name) > low)
        if high < math.inf:
            cond = cond & (F.col(name) <= high)
    return cond


def clipped(name: str, low: float, high: float) -> Column:
    """A statistic between its bounds, as a part of 1."""
    return (F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high)) - low) / (high - low)


def tree_rules(model) -> list[Rule]:
    """The conjunctions of all paths of a fitted forest, without repeats."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found[tuple((k, *bounds[k]) for k in sorted(bounds))] = None
        if node.subtreeDepth() == 0:
            return
        name, at = STATISTICS[node.split().featureIndex()], round(float(node.split().threshold()), 6)
        low, high = bounds.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), bounds | {name: (low, min(high, at))})
        walk(node.rightChild(), bounds | {name: (max(low, at), high)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return [r for r in found if all(low < high for _, low, high in r)]


def fit(labelled: DataFrame) -> Ensemble:
    """Fit on rows of ``STATISTICS`` and ``label`` (0.0 / 1.0)."""
    rows = labelled.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS)
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(seen.values())
    if len(seen) < 2:
        return Ensemble(0.0 if not n else 20.0 if 1.0 in seen else -20.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=max(1, int(LEAST_SUPPORT * n))).fit(rows)
    rules = tree_rules(forest)
    tests = [holds(r).cast("double") for r in rules]
    low, high = ([r[c] for c in STATISTICS] for r in rows.agg(*(F.percentile_approx(c, F.lit(0.025)).alias(c) for c in STATISTICS)).unionAll(
        rows.agg(*(F.percentile_approx(c, F.lit(0.975)).alias(c) for c in STATISTICS))).collect())
    linear = [(c, a, b) for c, a, b in zip(STATISTICS, low, high) if b > a]
    columns = tests + [clipped(*x) for x in linear]
    table = scratch(rows.select("label", array_to_vector(F.array(*columns)).alias("features")), "rules")
    model = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=True).fit(table)
    weights = [float(v) for v in model.coefficients.toArray()]
    return Ensemble(float(model.intercept), [(r, w) for r, w in zip(rules, weights) if w],
                    [(*x, w) for x, w in zip(linear, weights[len(rules):]) if w])


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ensemble:
    """Fit on the rows of ``stats`` that have a label."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).dropna() \
        .groupBy("_id").agg((F.avg("_label") >= 0.5).cast("double").alias("label"))
    both = scratch(stats.join(own, "_id"), "labelled")
    n = both.count()
    if n > TRAIN_ROWS:
        both = both.filter(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1 << 20)) < int(TRAIN_ROWS / n * (1 << 20)))
    return fit(scratch(both.repartition(TRAIN_PARTS, "_id").sortWithinPartitions("_id", *STATISTICS), "training"))


def held_out(id_col: str = "_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(df: DataFrame, labels: DataFrame, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, held_out, score, predicted) of every row; labels of held-out rows are not read."""
    stats = scratch(statistics(df, id_col, text_col), "statistics")
    model = train(stats.filter(~held_out()), labels.select(F.col(id_col).alias("doc_id"), "quality"))
    return stats.select(F.col("_id").alias(id_col), held_out().alias("held_out"), model.score().alias("score")) \
                .withColumn("predicted", (F.col("score") >= limit).cast("int"))
