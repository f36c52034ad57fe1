"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from logweave.llm import variants
from logweave.llm.queries import op11_variants

DIR = "/root/testdata/sf0.001"


def brute_counts(rows, shortest=6, at_least=5, noise=199):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            if len(w) >= shortest:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= at_least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, factor=5):
    of_length = defaultdict(list)
    for w in n:
        of_length[len(w)].append(w)
    out, form = {}, {}
    for w in n:
        close = [v for k in (-1, 0, 1) for v in of_length[len(w) + k] if v != w and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(close)
    rows = set()
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        rows.add((w, form[w], r, n[w], out[w], n[form[w]] if form[w] is not None else None))
    return rows


def result(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, n):
    return spark.createDataFrame([(w, c, 1, "x") for w, c in n.items()], "word string, n long, id int, form string")


@pytest.mark.parametrize("alphabet, lengths, size", [("ab", (0, 6), 90), ("aé日🙂", (1, 4), 150), ("abcdefgh", (3, 5), 400)])
def test_neighbours_equal_brute_force(spark, alphabet, lengths, size):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(size)}
    n = {w: rng.choice([1, 1, 2, 5, 5, 30, 150]) for w in sorted(words)}
    assert result(variants.group_variants(table(spark, n))) == brute_variants(n)


def test_chain_of_forms_ends_at_its_root(spark):
    words = ["a" * (k + 1) for k in range(20)]
    n = {w: 5 ** k for k, w in enumerate(words)}
    got = result(variants.group_variants(table(spark, n)))
    assert got == brute_variants(n) and {r[2] for r in got} == {"a" * 20}


def test_very_long_words_and_borders_inside_a_shared_prefix(spark):
    long = "ab" * 4000
    n = {long: 50, long + "c": 5, long[:-1]: 7, "x" + long: 9, long[:3000] + "Z" + long[3001:]: 1}
    n |= {"same" * 5 + c + d: 3 for c in "abcdefghij" for d in "abc"}
    assert result(variants.group_variants(table(spark, n))) == brute_variants(n)


def test_numbers_name_prefixes_once_and_ascend(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(600)})
    rows = variants.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    number = {}
    for r in rows:
        for k, v in enumerate(r["nodes"]):
            assert number.setdefault(r["word"][:k], v) == v
    assert len(set(number.values())) == len(number) and {r["word"] for r in rows} == set(words)
    assert [r["word"] for r in sorted(rows, key=lambda r: r["nodes"][-1])] == words


def test_counts_nulls_empty_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(variants, "LONG_TEXT", 50)
    rows = [(1, None), (2, ""), (None, "Shadow shadows"), (3, "SHADOW, shadow; ÀÈÏÿ÷×  shadowÉ"), (3, "SHADOW, shadow; ÀÈÏÿ÷×  shadowÉ"),
            (4, "straße Straße " * 40)] + [(100 + i, f"shadows over innsmouth {i} lurking") for i in range(900)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n int")
    got = {r["word"]: r["n"] for r in variants.word_counts(df, at_least=2).collect()}
    assert got == brute_counts(rows, at_least=2) and len(got) > 8
    assert result(variants.group_variants(variants.word_counts(df, at_least=2))) == brute_variants(got)


def test_empty_tables_null_words_and_bad_factor(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.word_counts(empty)).collect() == []
    odd = spark.createDataFrame([(None, 3), ("word", None), ("single", 3)], "word string, n long")
    assert result(variants.group_variants(odd)) == {("single", None, "single", 3, 0, None)}
    with pytest.raises(ValueError):
        variants.group_variants(odd, factor=1)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_counts(rows))
    assert result(op11_variants(spark, DIR)) == want and len(want) > 100
