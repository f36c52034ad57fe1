"""Spelling variant grouping with a dictionary of trie-node pairs.

The nodes of a trie of the words and of a trie of the reversed words are numbered. A
word is its path of prefix nodes and its path of suffix nodes, both integers, and

* two words of one length differ in position i alone if they have the same pair (prefix
  node before i, suffix node after i);
* a word without its position i is another word if that pair of the first is a pair
  (prefix node, suffix node) of the second with nothing between them.

So one equi-join of integer pairs gives all words at one insertion, deletion or
replacement, exactly. No pair of words is made: for each node pair the number of its
words, its two most frequent ones and the word that is whole there are enough (windows over
the pair; a group has at most one word for each character of the alphabet, and one whole
word). Within a run of equal characters only the first position stands for a deletion, so a
neighbour is met once.

Numbering: words are range-partitioned and sorted; a task walks its words and numbers
the nodes that its next word adds, as (partition, counter). A prefix that reaches over a
border belongs to the earlier partition; the borders (first and last word of each partition,
a row for each task) tell which nodes these are. Numbers of word ends ascend with the words,
so ties by code point are ties by number.

``word_counts``: null texts have no words; a null id counts as an empty one; repeated rows
count again. ``group_variants``: rows without word or count are left out, repeated words are an
error of the caller (group them first). Ties: the neighbour of the largest count, of these the
smallest in code-point order. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, prepare, scratch, shuffle_width, text_buffers

#: Words, and characters in them, a partition counts before it hands its counts on.
COUNT_WORDS, COUNT_CHARS = 300_000, 16_000_000
#: Node numbers in one Arrow batch.
BATCH_NODES = 200_000
#: Longer texts are searched as a stream of matches.
LONG_TEXT = 1 << 22
#: Chains of forms grow by the factor at each step, so 6 doublings reach the end of any.
DOUBLINGS = 6


def word_counts(df: DataFrame, shortest: int = 6, at_least: int = 5, noise: int = 199, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of at least ``shortest``
    code points that occur ``at_least`` times. With h the crc32 of ``<id>:<run>``, a run whose h
    ``noise`` divides loses its code point ``h % length`` first (0: none does)."""
    prepare(df.sparkSession)
    run_re = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            rb = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rb
        for rb in batches:
            ids = rb.column(0).to_pylist()
            data, offs = text_buffers(rb.column(1))
            for i in range(rb.num_rows):
                text = data[offs[i]:offs[i + 1]].tobytes().lower().decode()
                found = Counter(run_re.findall(text) if len(text) < LONG_TEXT else map(methodcaller("group"), run_re.finditer(text)))
                start = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                for w, n in found.items():
                    h = zlib.crc32(w.encode(), start)
                    if noise and not h % noise:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < shortest:
                            continue
                    counts[w] += n
                chars += len(text)
                if len(counts) > COUNT_WORDS or chars > COUNT_CHARS and sum(map(len, counts)) > COUNT_CHARS:
                    yield flush()
                if chars > COUNT_CHARS:
                    chars = 0
        yield flush()

    x = id_text(df, id_col, text_col).select(F.col("_id").cast("string"), "_text")
    return x.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[low:mid], low):
            low = mid
        else:
            high = mid - 1
    return low


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    made = part << 40  # the next node's number
    path, last, shared = [made], None, 0
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        words, paths, firsts, own = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(paths, pa.list_(pa.int64())),
             pa.array(firsts, pa.list_(pa.bool_())), pa.array(own, pa.int32())], ["word", "part", "nodes", "firsts", "shared"])
    made += 1
    for rb in batches:
        for word in rb.column(0).to_pylist():
            same = common_prefix(last, word) if last is not None else 0
            shared = len(word) if last is None else min(shared, same)
            new = len(word) - same
            path = path[:same + 1] + list(range(made, made + new))
            made += new
            rows.append((word, path, [True, *map(str.__ne__, word, word[1:])][:len(word)], shared))
            last, held = word, held + len(path)
            if held > BATCH_NODES:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def trie_nodes(words: DataFrame) -> DataFrame:
    """(word, nodes, firsts): the numbers of the nodes of each word's prefixes, from the
    empty one to the word, and which of its characters differ from the one before. ``words``
    has distinct words in column ``word``."""
    spark = prepare(words.sparkSession)
    # an own copy, since borders and rows must see the same partitions
    x = scratch(words.select("word").repartitionByRange(max(shuffle_width(spark), 1), "word").sortWithinPartitions("word")
                .mapInArrow(_number, "word string, part int, nodes array<bigint>, firsts array<boolean>, shared int"), "trie")
    ends = x.groupBy("part").agg(F.min("word").alias("first"), F.max_by(F.struct("word", "nodes"), "word").alias("last"))
    carried, last, path = [], None, []
    for r in ends.orderBy("part").collect():  # a row for each task that had words
        own = list(r["last"]["nodes"])
        carry = path[:common_prefix(last, r["first"]) + 1] if last is not None else []
        both = min(common_prefix(r["first"], r["last"]["word"]) + 1, len(carry))
        carried.append((r["part"], carry))
        last, path = r["last"]["word"], carry[:both] + own[both:]
    borders = spark.createDataFrame(carried, "part int, carry array<bigint>")
    return x.join(F.broadcast(borders), "part").withColumn("_own", F.least(F.col("shared") + 1, F.size("carry"))) \
            .select("word", F.expr("concat(slice(carry, 1, _own), slice(nodes, _own + 1, size(nodes)))").alias("nodes"), "firsts")


#: What a row of a node pair is: a word without a character that equals the one before, a word
#: without another character, a whole word.
AGAIN, SKIP, WHOLE = 0, 1, 2


def _neighbours(paths: DataFrame) -> DataFrame:
    """(id, n_near, best): the number of near words and the (n, -id) of the first of them."""
    skipped = F.expr("transform(slice(sequence(0, size(firsts)), 2, size(firsts)), i -> struct(nodes[i - 1] as p, back[size(firsts) - i] as s, "
                     f"if(firsts[i - 1], {SKIP}, {AGAIN}) as kind))")
    whole = F.expr(f"transform(sequence(0, size(firsts)), i -> struct(nodes[i] as p, back[size(firsts) - i] as s, {WHOLE} as kind))")
    x = paths.select("id", "n", F.explode(F.concat(skipped, whole)).alias("_pair")).select("_pair.*", "id", "n")
    pair = Window.partitionBy("p", "s")
    x = x.withColumn("me", F.struct("n", (-F.col("id")).alias("back"))).withColumns({
        "members": F.count(F.when(F.col("kind") != WHOLE, 1)).over(pair),
        "top": F.max(F.when(F.col("kind") != WHOLE, F.col("me"))).over(pair),
        "shorter": F.max(F.when(F.col("kind") == WHOLE, F.col("me"))).over(pair),
        "longer": F.count(F.when(F.col("kind") == SKIP, 1)).over(pair),
        "top_longer": F.max(F.when(F.col("kind") == SKIP, F.col("me"))).over(pair)})
    x = x.withColumn("second", F.max(F.when((F.col("kind") != WHOLE) & (F.col("me") != F.col("top")), F.col("me"))).over(pair))
    shorter = F.when(F.col("kind") == SKIP, F.col("shorter"))
    other = F.when(F.col("top") == F.col("me"), F.col("second")).otherwise(F.col("top"))
    return x.select("id",
                    F.when(F.col("kind") == WHOLE, F.col("longer")).otherwise(F.col("members") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("near"),
                    F.when(F.col("kind") == WHOLE, F.col("top_longer")).otherwise(F.greatest(other, shorter)).alias("best")) \
            .filter(F.col("near") > 0).groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of each chain of forms, by doubling."""
    roots = scratch(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        further = roots.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        ahead = roots.join(further, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        ahead = scratch(ahead, "roots")
        roots = ahead.select("id", "root")
        if ahead.filter("moved").isEmpty():
            break
    return roots


def group_variants(words: DataFrame, factor: int = 5, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct words with counts. A
    word's form is its near word of largest count if that is ``factor`` times its own or
    more; its root is the end of its chain of forms. ``factor`` must be over 1."""
    if factor <= 1:
        raise ValueError("the factor must be over 1, or chains of forms may not end")
    vocabulary = scratch(words.select(F.col(word_col).cast("string").alias("word"), F.col(n_col).cast("long").alias("n"))
                         .dropna(), "words")
    ahead = trie_nodes(vocabulary)
    back = trie_nodes(vocabulary.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.col("nodes").alias("back"))
    paths = scratch(vocabulary.join(ahead, "word").join(back, "word").withColumn("id", F.element_at("nodes", -1)), "paths")
    named = paths.select("id", "word", "n")
    near = named.join(_neighbours(paths), "id", "left") \
        .withColumn("fits", F.coalesce(F.col("best.n") >= F.lit(factor) * F.col("n"), F.lit(False))) \
        .select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(F.col("fits"), -F.col("best.back")).alias("form"), F.when(F.col("fits"), F.col("best.n")).alias("form_n"))
    near = scratch(near, "near")
    roots = _roots(near.filter(F.col("form").isNotNull()))

    def name(column: str) -> DataFrame:
        return named.select(F.col("id").alias(column), F.col("word").alias(column + "_word"))
    return near.join(roots, "id", "left").join(name("form"), "form", "left").join(name("root"), "root", "left") \
               .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
