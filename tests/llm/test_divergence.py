"""Source divergence against brute force in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from logweave.llm import divergence


def brute(rows, min_docs=10, top=10):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
                 for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        tf = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        tf[None] = {t: sum(tf[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in tf.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if tf[s][t] and p[s][t] > p[None][t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.add((lang, s, part, item, v, k))
    return out


def result(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n int, value int")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["Été", "日本", "don't", "a_b", "x1y", "ÉTÉ", *("w" + "abcdefghijklmnopqrstuvwxyz"[k] * 2 for k in range(26)), *"ABcd"]
    rows = [(None, "en", "s0"), ("", None, None), ("only rare here", "xx", "s1"), (" \n\t", "en", "empty"), (None, None, "s9")]
    for i in range(260):
        source = f"s{min(rng.randrange(9), 4)}"  # s4 holds most rows
        lang = rng.choice(["en", "en", "de", None])
        pool = words[:20] if source == "s1" else words[10:]
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))), lang, source))
    return rows + rows[-30:] + [("waa wbb " * 30_000, "en", "s2")]


def test_equals_brute_force(spark, corpus):
    assert result(divergence.divergence(table(spark, corpus))) == brute(corpus)
    assert result(divergence.divergence(table(spark, corpus), min_docs=1, top=3)) == brute(corpus, 1, 3)


def test_no_term_kept(spark, corpus):
    got = result(divergence.divergence(table(spark, corpus), min_docs=10_000))
    assert got == brute(corpus, 10_000) and {r[4] for r in got} == {0}


def test_spilled_stripes_give_the_same(corpus):
    """All steps of a task, with bounds so low that everything is spilled and merged again."""
    rows = [(r[1] or "", r[2] or "", r[0] or "") for r in corpus[:200]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "_text"])
    parts = []
    for spill in (divergence.SPILL_CELLS, 0):
        stripes = []
        old = divergence.SPILL_CELLS, divergence.PIECE_BYTES
        divergence.SPILL_CELLS, divergence.PIECE_BYTES = spill, old[1] if spill else 7
        try:
            for b in divergence._fold_documents(iter([batch.slice(0, 90), batch.slice(90)])):
                stripes.append(b)
        finally:
            divergence.SPILL_CELLS, divergence.PIECE_BYTES = old
        t = pa.Table.from_batches(stripes).sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
        merged = [m for size in [5 if not spill else 10**6] for m in divergence._merge(3)(iter(t.to_batches(max_chunksize=size)))]
        flat = {(r["lang"], r["term"]): (r["n_docs"], dict(zip(r["sources"], r["counts"]))) for m in merged for r in m.to_pylist()}
        assert sum(m.num_rows for m in merged) == len(flat)
        parts.append((len(stripes), flat))
    assert parts[0][1] == parts[1][1] and parts[0][1] and parts[1][0] > 10 * parts[0][0]


def test_matrix_spill(spark, corpus, monkeypatch):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en", "de", "en"]), pa.array([[{"source": s, "p": 5 * k + 9, "zero": 2} for k, s in enumerate(x)] for x in ("abc", "ab", "cbd")])],
        ["lang", "cells"])

    def sums():
        total = Counter()
        for b in divergence._pair_sums(iter([batch.slice(0, 1), batch.slice(1)])):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["item"]] += r["value"]
        return total
    want = sums()
    monkeypatch.setattr(divergence, "MATRIX_CELLS", 0)
    assert sums() == want and len(want) >= 8


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(3 * 10**11, 7 * 10**11 + 13), (0, 10), (10**17, 10**17 + 7)], "c long, t long")
    got = [r[0] for r in df.select(divergence._share("c", "t")).collect()]
    assert got == [1 + 10**9 * (c + 2) // t for c, t in [(3 * 10**11, 7 * 10**11 + 13), (0, 10), (10**17, 10**17 + 7)]]


def test_empty_table(spark):
    assert result(divergence.divergence(table(spark, []))) == set()
