"""The corpus operators against brute force on a fixture with nulls, empty, blank
and very long texts, repeated rows, ties and extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import bpe, exact, langid, oddsketch, packing, quality, sharding, substring, tokenfile, urlfilter
from logweave.llm.components import components
from logweave.llm.library_tokens import LibraryTokens, read_vocabulary
from logweave.llm.queries import URL_RULES, op4_exact

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", "  a  b", " \n x", "a\n\nb", "a\nb", "x \n y", "<|endoftext|> hi<|startoftext|>Hi", "İSTANBUL Σας ΣΑΣ", "é a ́b",
             "日本語 です　x", "a\x1cb \x85 c\xa0d", "it's I'LL 'S", "\t\ta", "a   ", "🙂🙂 x", "a\r\nb", "don't\n'tis", "x​y z", "### $$$ 12 345"]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(70), say(300).split()
    out = [None, "", " \n\t ", "one", "One", *ODD_TEXTS]
    out += [say(rng.randint(20, 200)) for _ in range(25)]
    out += [say(30) + "\n" + passage + "  " + say(40) for _ in range(6)] + [passage]
    copy = say(120)
    out += [copy, copy.replace(" ", "  "), copy, copy.upper(), "short text", "short text"]
    for k in range(12):  # near copies at several distances
        w = list(base)
        for i in rng.sample(range(300), k):
            w[i] = "new" + str(i)
        out.append(" ".join(w))
    out.append(say(30_000))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], 1, "x", "y", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids int, _id string, piece string, kept boolean")


def by_id(df, *cols):
    out = defaultdict(list)
    for r in df.select("doc_id", *cols).collect():
        out[r[0]].append(tuple(r[1:]))
    assert all(len(v) == 1 for v in out.values())
    return {k: v[0] for k, v in out.items()}


def ids_of(path, texts, end=()):
    tok = Tokenizer.from_file(path)
    return tok, [tok.encode(t or "", add_special_tokens=False).ids + list(end) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_bpe_equals_the_library(spark, docs, texts):
    tok, ids = ids_of(WORD, texts)
    coded = bpe.encode(docs, WORD)
    assert {k: list(v[0]) for k, v in by_id(coded, "ids").items()} == dict(enumerate(ids))
    assert by_id(bpe.decode(coded, WORD), "text") == {i: (tok.decode(x, skip_special_tokens=False),) for i, x in enumerate(ids)}
    got = by_id(bpe.round_trip_digests(coded, WORD), "n_tokens", "ids_sha256")
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in enumerate(ids)}
    tok, ids = ids_of(BYTE, texts)
    coded = bpe.encode(docs, BYTE)
    assert {k: list(v[0]) for k, v in by_id(coded, "ids").items()} == dict(enumerate(ids))
    assert by_id(bpe.decode(coded, BYTE), "text") == {i: (t or "",) for i, t in enumerate(texts)}


def test_cached_segments_equal_whole_texts(texts):
    for path, kind in ((WORD, "words"), (BYTE, "bytes")):
        _, ids = ids_of(path, texts)
        own = LibraryTokens(read_vocabulary(path), kind)
        for _ in range(2):  # cold and warm
            assert own.encode([(t or "").encode() for t in texts]) == [np.array(x, "<u4").tobytes() for x in ids]


def test_packing(spark, docs, texts):
    _, ids = ids_of(WORD, texts, [1])
    cap = 256
    got = packing.pack(packing.pieces(docs, WORD, cap), cap).collect()
    expected = {(i, p, p * cap, len(x[p * cap:(p + 1) * cap]), crc(x[p * cap:(p + 1) * cap]))
                for i, x in enumerate(ids) for p in range(-(-len(x) // cap))}
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= cap
    assert len(bins) <= -(-sum(map(len, ids)) // cap) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_local_search_never_worse(lengths):
    start = packing.best_fit(lengths, 100)
    squares = sum(sum(lengths[i] for i in b) ** 2 for b in start)
    n = len(start)
    end = packing.improve([list(b) for b in start], lengths, 100)
    assert sorted(i for b in end for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in end) and len(end) <= n
    assert sum(sum(lengths[i] for i in b) ** 2 for b in end) >= squares


def test_local_search_empties_a_bin():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # 30: three bins of 10
    start = [[0, 5], [1, 3], [2, 4], [6]]
    assert len(packing.improve(start, lengths, 10)) == 3


def brute_substring(texts, width):
    first, out = {}, {}
    for i, t in enumerate(texts):
        w = split(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k:k + width]), i)
    for i, t in enumerate(texts):
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [50, 8])
def test_substring(spark, docs, texts, width):
    got = substring.substring_dedup(docs, width).cache()
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == brute_substring(texts, width)
    for _, (removed, cut) in by_id(got, "n_removed", "cut_text").items():
        assert (cut is None) == (removed == 0)


def test_exact(spark, docs, texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    expected = {i: (m[0], len(m), i == m[0], hashlib.sha256(t.encode()).hexdigest()) for t, m in groups.items() for i in m}
    got = exact.with_sha256(docs, exact.exact_dedup(docs))
    assert by_id(got, "keep_id", "group_size", "kept", "text_sha256") == expected


def test_sharding(spark, docs, texts):
    many = docs.unionByName(docs.select(*[F.when(F.col("doc_id") >= 0, F.col("doc_id") + 1000).alias(c) if c == "doc_id"
                                          else F.lit("hot text").alias(c) if c == "text" else F.col(c) for c in docs.columns]))
    got = sharding.assign_shards(many, 4).collect()
    assert len(got) == 2 * len(texts)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        t = texts[r.doc_id] or "" if r.doc_id < 1000 else "hot text"
        assert (r["size"], r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    for s in range(4):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    longest = max(len((t or "").encode()) for t in texts) + 1
    assert max(load.values()) - min(load[s] for s in range(4)) <= 2 * longest


def brute_near(texts, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = split((t or "").translate(low))
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("words,percent,bands,rows", [(3, 85, 25, 6), (5, 80, 30, 5)])
def test_near(spark, docs, texts, words, percent, bands, rows):
    got = oddsketch.near_dedup(docs, words, percent, bands, rows)
    assert by_id(got, "n_shingles", "component_id", "kept") == brute_near(texts, words, percent)


def test_odd_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 900).astype(np.uint64))
    y = np.sort(np.r_[x[40:], rng.integers(0, 2**63, 30).astype(np.uint64)])
    z = int(np.bitwise_count(oddsketch.odd_sketch(x) ^ oddsketch.odd_sketch(y)).sum())
    assert z <= 70 and z % 2 == 0 and z >= 50


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (22, 21), (5, 5), (20, 21)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 20: 20, 21: 20, 22: 20}


def test_urls(spark):
    urls = [None, "", "nothing", "http://Example.ORG/es/1?x#y", "https://a.example.org/en/12", "https://example.org/en/2", "http://x.com/fr/1",
            "http://x.com/de/1", "http://org", "http://notorg/", "http://www.cheap-pills.example.net/en/926/", "http://thther.example.net/en/4",
            "http://com/de/a://b", "x://h?q/", "http://H#f"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r["path"], r.rule, r.verdict) for r in urlfilter.filter_urls(df, URL_RULES).collect()}
    assert len(got) == len(urls)
    assert got[0][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[12][2] == "com/de/"
    assert got[8][:3] == ("org", "", None) and got[9][2] is None
    assert got[10][3] == "block" and got[11][3] == "allow" and got[13][:2] == ("h", "") and got[14][:2] == ("h", "")


def test_language_forward_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ab"]
    prob = np.array([[.2], [.1], [.15], [.25], [.3]]) * (1 - langid.BYTE_MASS)
    m = langid.PieceModel(pieces, prob, ["xx"])
    one = {p: m.table[m._find(np.array([m._code(p)], np.uint64))[0], 0] for p in [*pieces, b" "]}

    def total(t):
        return 1.0 if not t else sum(one.get(t[:k], 0.0) * total(t[k:]) for k in range(1, len(t) + 1))
    got = np.exp(m.forward(np.frombuffer(b" abab", np.uint8)[None, :]))[0, 0]
    assert abs(got - total(b" abab")) < 1e-12


def test_language(spark, sf_docs):
    test = langid.held_out()
    model = langid.train(sf_docs.filter(~test), public_tokenizers.path("piece_bpe_32k.model"))
    got = langid.identify(sf_docs, model).join(sf_docs.select("doc_id", "lang").withColumn("t", test), "doc_id").collect()
    held = [r for r in got if r.t]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 #"), (4, "日本語"), (5, "the " * 50_000)], "doc_id long, text string")
    out = by_id(langid.identify(odd, model), "lang_pred", "score")
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] != "und" and out[5][0] == "en"
    none = langid.train(odd.withColumn("lang", F.lit(None).cast("string")), public_tokenizers.path("piece_bpe_32k.model"))
    assert {v[0] for v in by_id(langid.identify(odd, none), "lang_pred").values()} == {"und"}


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def brute_quality(t):
    t = t or ""
    w, seen, dup = split(t), set(), 0
    for line in t.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality(spark, docs, texts):
    extra = ["a b\na b\n\na  b\n a b\na b", "x y z x y z x y z q", "| # |\n| # |", "é è\né è\r\né è"]
    more = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame(
        [(1000 + i, t, "en", 1, "x", "y", True) for i, t in enumerate(extra)], docs.schema))
    got = by_id(quality.quality(more), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute_quality(t) for i, t in [*enumerate(texts), *enumerate(extra, 1000)]}


def test_quality_keeps_prose_and_rejects_symbol_noise(sf_docs):
    x = quality.quality(sf_docs).join(sf_docs, "doc_id").filter(~F.col("base_failed"))
    rows = x.select("kept", "n_symbols", "n_words").collect()
    noise = [r.kept for r in rows if r.n_symbols > 2 * r.n_words]
    clean = [r.kept for r in rows if r.n_symbols == 0]
    assert noise and not any(noise) and all(clean)


def test_quality_rejects_prose_without_common_words(spark, sf_docs):
    clean = sf_docs.filter("lang = 'en'").select("doc_id", "text", "lang")
    rng = random.Random(9)
    bare = [" ".join("q" + "".join(rng.choices("bcdfghaeiou", k=rng.randint(3, 6))) for _ in range(n)).capitalize() + "." for n in (60, 160, 600)]
    cases = spark.createDataFrame([(-1 - j, t, lang) for j, (t, lang) in enumerate(
        [(t, "en") for t in bare] + [(bare[2], "xx"), (bare[2], None)])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(clean.unionByName(cases)).collect()}
    assert [got[-1 - j].base_failed for j in range(5)] == [False] * 5 and got[-3].char_distance < quality.MAX_CHAR_DISTANCE
    assert [got[-1 - j].kept for j in range(5)] == [False, False, False, True, True]
    assert got[-4].word_distance is got[-5].word_distance is None
    prose = [r.kept for i, r in got.items() if i > 0 and not r.base_failed and r.n_symbols == 0]
    assert len(prose) > 20 and all(prose)


def test_quality_keeps_other_scripts_and_rejects_their_noise(spark, sf_docs):
    base = sf_docs.select("doc_id", "text", "lang")
    rng = random.Random(5)
    russian = [" ".join("".join(rng.choices("абвгдежзийклмнопрстуя", k=rng.randint(3, 8))) for _ in range(120)) + "." for _ in range(40)]
    english = base.filter("lang = 'en'").orderBy("doc_id").collect()
    clean = min((r.text for r in english if len(split(r.text or "")) >= 200 and not re.search(r"[#*$%&|<>]", r.text)), key=len)
    noise = " ".join("".join(rng.choices("#*$%&|<>", k=4)) for _ in range(200))
    rows = [(t, "ru") for t in russian] + [(russian[0], None), (noise, "ru"), (noise, None), (noise, "en"), (clean, None), (clean, "ru")]
    cases = spark.createDataFrame([(-1 - j, t, x) for j, (t, x) in enumerate(rows)], base.schema)

    def kept(cases):
        got = {r.doc_id: r for r in quality.quality(base.unionByName(cases)).collect() if r.doc_id < 0}
        return [got[i].kept for i in sorted(got, reverse=True)]
    assert kept(cases) == [True] * 41 + [False] * 3 + [True] * 2
    assert kept(cases.filter("lang is null")) == [True, False, True]  # no Russian reference
    # a label with one odd document makes a reference of its own, for its own documents only
    assert kept(cases.filter("lang = 'en'").unionByName(cases.limit(1).select(F.lit(-99).cast("long").alias("doc_id"), F.lit(noise).alias("text"), F.lit("zz").alias("lang")))) == [False, True]


def test_token_files(spark, docs, texts, tmp_path):
    _, ids = ids_of(BYTE, texts, [0])
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, BYTE)
    start, expected = 0, {}
    for i, x in enumerate(ids):
        expected[i] = (start, len(x), crc(x))
        start += len(x)
    assert by_id(tokenfile.read_documents(spark, path), "start", "n_tokens", "ids_crc32") == expected
    flat = [v for x in ids for v in x]
    places = [0, 1, start - 1, start // 2, start, -1]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    assert {r.place: r.token for r in tokenfile.read_tokens(spark, path, asked).collect()} == {p: flat[p] for p in places[:4]}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_random_access(values):
    codes = tokenfile.Codes(tokenfile.encode_codes(np.array(values, np.uint32)))
    assert codes.all().tolist() == values
    assert [codes.token(i) for i in range(len(values))] == values


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.decode(bpe.encode(none, WORD), WORD).count() == 0
    assert packing.pack(packing.pieces(none, WORD)).count() == 0
    assert substring.substring_dedup(none).count() == exact.exact_dedup(none).count() == 0
    assert sharding.assign_shards(none).count() == oddsketch.near_dedup(none).count() == quality.quality(none).count() == 0


def test_exact_hashes_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a  b"), (None, "a b"), (None, "c d"), (None, "some other text"), (7, "x y"), (7, "p q r"), (8, "x y"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op4_exact(spark, str(tmp_path)).collect())

    def row(i, keep, n, kept, t):
        return i, keep, n, kept, hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([row(None, None, 2, True, "a b")] * 2 + [row(None, None, 1, True, "c d"), row(None, None, 1, True, "some other text"),
                          row(7, 7, 2, True, "x y"), row(8, 7, 2, False, "x y"), row(7, 7, 1, True, "p q r"), row(9, 9, 1, True, "")])


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, "en"), (1, t, "en"), (None, t, "en"), (2, t + " end", None)], "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(df).collect())
    assert got == {(1, None, 3, False): 2, (2, 2, 1, True): 1, (None, None, 3, True): 1}
    assert oddsketch.near_dedup(df).count() == substring.substring_dedup(df).count() == quality.quality(df).count() == 4
    assert sharding.assign_shards(df, 2).count() == 4
