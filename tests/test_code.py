from pyspark.sql import functions as F

from logweave.operators import code as C
from logweave.operators import deps as D

from .conftest import rows


def chunks(spark, path, text):
    df = spark.createDataFrame([(path, text)], "file_path string, content string")
    return [(r["start_line"], r["end_line"], r["language"]) for r in C.chunk_files(df).orderBy("chunk_no").collect()]


def test_python_boundaries_and_preamble(spark):
    short = "import os\n\ndef a():\n    return 1\n\nclass B:\n    pass\n"
    assert chunks(spark, "x.py", short) == [(3, 5, "python"), (6, 7, "python")]
    long_pre = "import os\nimport re\nimport sys\n\n# c\nX = 1\ndef a():\n    pass\n"
    assert chunks(spark, "x.py", long_pre) == [(1, 6, "python"), (7, 8, "python")]


def test_long_function_goes_to_sliding_window(spark):
    body = "\n".join(f"    x{i} = {i}" for i in range(129))
    text = "def big():\n" + body + "\n"
    got = chunks(spark, "big.py", text)
    assert got == [(1, 60, "python"), (51, 110, "python"), (101, 130, "python")]


def test_go_rust_and_fallback(spark):
    go = "package main\n\nfunc A() {\n}\n\ntype T struct {\n}\n"
    assert chunks(spark, "m.go", go) == [(3, 5, "go"), (6, 7, "go")]
    rs = "use x;\n\npub fn a() {}\nfn b() {}\nstruct S;\n"
    assert chunks(spark, "m.rs", rs) == [(3, 3, "rust"), (4, 4, "rust"), (5, 5, "rust")]
    txt = "\n".join(f"line {i}" for i in range(7))
    assert chunks(spark, "notes.txt", txt) == [(1, 7, None)]
    assert chunks(spark, "tiny.txt", "a\nb\n") == []


def test_language_and_support(spark):
    df = spark.createDataFrame([("a/b.PY",), ("x.tsx",), (".bashrc",), ("a.tar.gz",), ("c.md",)], "p string")
    r = df.select(C.detect_language(F.col("p")), C.file_extension(F.col("p"))).collect()
    assert [x[0] for x in r] == ["python", "typescript", None, None, None]
    assert [x[1] for x in r] == [".py", ".tsx", "", ".gz", ".md"]


RULE_HITS = [
    ('requests.get("http://billing-api:8080/x")', "http", "billing-api"),
    ("axios.post('https://orders.internal/v1')", "http", "orders-internal"),
    ('url = f"http://{os.getenv("INVENTORY_URL")}"', "env_ref", "inventory"),
    ('grpc.insecure_channel("ledger:50051")', "grpc", "ledger"),
    ('grpc.Dial("search-svc:9000")', "grpc", "search-svc"),
    ('KafkaProducer(\n bootstrap_servers="kafka-main:9092")', "event", "kafka-main"),
    ("producer.send('user-events', v)", "event", "user-events"),
    ("pubsub_v1.PublisherClient().publish('projects/p/topics/audit-log', b)", "event", "audit-log"),
    ("sqs.send_message(QueueUrl='https://sqs/q/mailer-jobs', x)", "event", "mailer-jobs"),
    ("from payments.client import api", "import", "payments-client"),
    ('import "github.com/acme/payments/sdk"', "import", "github-com/acme/payments/sdk"),
    ('os.environ.get("NOTIFY_HOST")', "env_ref", "notify"),
    ("process.env.PROFILE_SERVICE", "env_ref", "profile"),
]


def test_dependency_rules(spark):
    files = spark.createDataFrame([(f"r{i}", f"f{i}.py", t) for i, (t, _, _) in enumerate(RULE_HITS)],
                                  "repo string, file_path string, content string")
    known = spark.createDataFrame([("payments",)], "name string")
    got = {(r["file_path"], r["dependency_type"], r["target_name"]) for r in D.extract_dependencies(files, known).collect()}
    for i, (_, kind, target) in enumerate(RULE_HITS):
        assert (f"f{i}.py", kind, target) in got, (i, kind, target, got)
    misses = spark.createDataFrame([("r", "m.py", 'requests.get(url)\nimport os\nfrom util import x\nfetch("/rel")')],
                                   "repo string, file_path string, content string")
    assert D.extract_dependencies(misses, known).count() == 0


def test_import_filter_joins_names(spark):
    m = [("r", 0, "import", "acme/Pay.pay", "p"), ("r", 0, "import", "acme/Pay.pay", "p"), ("r", 1, "import", "pay.core", None),
         ("r", 2, "import", "payroll", "p"), ("r", 3, "import", None, "p"), (None, 4, "import", "core", "p"), ("r", 5, "http", "x", "p")]
    df = spark.createDataFrame(m, "repo string, pos int, dependency_type string, raw string, source_pattern string")
    known = spark.createDataFrame([("PAY",), ("pay",), ("Core",), (None,)], "name string")
    assert sorted(rows(D.filter_imports(df, known)), key=str) == sorted([m[0], m[1], m[2], m[5], m[6]], key=str)
    assert rows(D.filter_imports(df, known.limit(0))) == [m[6]]
    assert rows(D.filter_imports(df.limit(0), known)) == []


def test_normalise_and_blast(spark):
    df = spark.createDataFrame([("http://Billing_API:80",), ("localhost",), ("ab",), ("PAY.SERVICE_URL",)], "r string")
    assert [r[0] for r in df.select(D.normalise_target(F.col("r"))).collect()] == ["billing-api", None, None, "pay-service"]
    deps = spark.createDataFrame([("x", "a")] * 10 + [("y", "b")] * 2, "source_repo string, target_name string")
    svc = spark.createDataFrame([("A",), ("b",), ("c",)], "service_name string")
    got = dict(rows(D.blast_radius(deps, svc), "service_name", "blast_radius_level"))
    assert got == {"A": "high", "b": "medium", "c": "low"}


def test_rules_search_only_files_that_hold_their_text(spark, monkeypatch):
    texts = ["REQUEſTS.get('HTTPS://Svc-A.b/x')", "fetch('http://a-b/y') got(`'https://c')", 'u = f"https://{PAY_URL}/v"', "GRPC.Secure_Channel('pay-x:1')",
             'c := grpc.Dial("pay-y:5")', "KafKaProducer(\n a, Bootstrap_Servers = 'brok:9'\n) Producer(x bootstrap.servers: 'b2')", "client.publish('t-1') PRODUCER.SEND(\"t2\")",
             "PubliſherClient()\n.publish('PROJECTS/p/topics/t9')", "sqs.send_message( QueueUrl = 'https://q/1/jobs' )", "import pay.client\nfrom a.b import c\n x import y",
             '"github.com/org/lib"', "OS.environ.get('PAY_URL') os.getenv(\"A_HOST\")", "process.env.PAY_ADDR process.env.x", "", None]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("all", "\n".join(t for t in texts if t))], "file_path string, content string")
    out = ("file_path", "rule", "pos", "dependency_type", "raw", "source_pattern")
    got = sorted(rows(D.extract_matches(files), *out))
    assert {r[1] for r in got} == set(range(len(D.RULES)))
    monkeypatch.setattr(D, "RULE_TEXTS", {})
    assert got == sorted(rows(D.extract_matches(files), *out))
    whole = files.select("file_path", *[F.arrays_zip(F.regexp_extract_all("content", F.lit(rx), 0).alias("g0"), F.regexp_extract_all("content", F.lit(rx), 1).alias("g1"))
                                        .alias(f"r{i}") for i, (_, rx) in enumerate(D.RULES)])
    want = [(r["file_path"], i, pos, kind, m["g1"], m["g0"][:200]) for r in whole.collect() for i, (kind, _) in enumerate(D.RULES)
            for pos, m in enumerate(r[f"r{i}"] or [])]
    assert got == sorted(want)


def test_source_files_of_a_small_table_are_dealt_out(spark):
    from logweave.plans.views import view
    sf = "/root/testdata/sf0.001"
    f = view(spark, sf, "v_files", spread=True)
    assert f.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(rows(f)) == sorted(rows(view(spark, sf, "v_files")))
