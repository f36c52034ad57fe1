import random

from pyspark.sql import functions as F

from logweave.operators import analytics as A
from logweave.operators import profiles as P

from .conftest import rows


def test_author_chunks_joins_only_chunks_that_can_be_among_the_first(spark):
    rng = random.Random(3)
    commits = [(f"c{i}", f"a{i % 4}@x") for i in range(40)] + [("c90", "none@x"), (None, "n@x")]
    files = [(f"c{rng.randrange(40)}", f"f{rng.randrange(12):02d}") for _ in range(120)] + [("c1", "gone"), ("c1", None), (None, "f01")]
    chunks = [(k, f"f{rng.randrange(12):02d}", rng.choice([None, 1, 51, 101]), "c90" if k % 97 == 0 else None) for k in range(300)] + [(900, None, 1, None)]
    c = spark.createDataFrame(commits, "sha string, author_email string")
    f = spark.createDataFrame(files, "sha string, file_path string")
    k = spark.createDataFrame(chunks, "chunk_id long, file_path string, start_line long, commit_sha string")
    mail = dict(commits)
    want = set()
    for a in set(mail.values()):
        mine = {p for s, p in files if s is not None and mail.get(s) == a}
        own = [x for x in chunks if x[1] in mine and x[1] is not None] if mine else [x for x in chunks if x[3] and mail.get(x[3]) == a]
        own.sort(key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[0]))
        want |= {(a, x[0], n + 1) for n, x in enumerate(own[:7])}
    got = P.author_chunks(c, f, k, cap=7)
    assert set(rows(got, "author_email", "chunk_id", "chunk_rank")) == want and any(a == "none@x" for a, _, _ in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") >= 3   # of the chunks of a file, of the files of an author, of the result


def test_incident_patterns_join_the_files_once(spark):
    commits = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "sha string")
    files = spark.createDataFrame([("a", "x/f"), ("a", "x/f"), ("a", "x/g"), ("b", "x/f"), ("z", "x/f"), (None, "x/f"), ("c", None)], "sha string, file_path string")
    inc = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "sha string")
    p = A.incident_patterns(inc, commits, files, level="file")
    assert sorted(rows(p, "pattern", "commits", "incidents", "incident_rate"), key=str) == sorted([("x/f", 2, 1, 0.5), ("x/g", 1, 1, 1.0), (None, 1, 0, 0.0)], key=str)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
