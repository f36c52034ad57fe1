"""Property checks: texts and times are put together from parts whose class is
known, so the expected result follows from the parts."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions.logparse import parse_ts
from logweave.functions.text import template

HEX = "0123456789abcdefABCDEF"
number = st.integers(0, 10**6).map(str)
#: Tokens of each variable kind, built piece by piece.
VARIABLE = st.one_of(
    number,
    st.tuples(number, number).map(".".join),
    st.tuples(number, st.sampled_from(["ms", "s", "m", "h", "kb", "mb", "gb"])).map("".join),
    st.tuples(*[st.integers(0, 999).map(str)] * 4).map(".".join),
    st.tuples(st.just("10.0.0.1"), number).map(":".join),
    st.text(HEX, min_size=32, max_size=48),
    st.tuples(*[st.text(HEX, min_size=n, max_size=n) for n in (8, 4, 4, 4, 12)]).map("-".join),
    st.text("abc/?=1", min_size=1, max_size=9).map("https://".__add__),
)
#: Tokens that are none: words, signs and near misses of each kind.
PLAIN = st.one_of(
    st.text("ghijklmnop", min_size=1, max_size=8),
    st.sampled_from(["-3", "x=1", "7MB", "http:/bad", "1.2.3.4.5", "12msec", "g" + "0" * 40, "(5)", "a-1"]),
)
SEPARATOR = st.sampled_from([" ", "  ", "\t", "\n", "\x1b[31m \x1b[0m"])
MESSAGE = st.lists(st.tuples(st.one_of(st.tuples(st.just(True), VARIABLE), st.tuples(st.just(False), PLAIN)), SEPARATOR),
                   max_size=12)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(MESSAGE, min_size=150, max_size=150))
def test_template_marks_runs_of_variables(spark, messages):
    texts = ["".join(token + sep for (_, token), sep in m) for m in messages]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", template(F.col("t"))).collect())
    for i, m in enumerate(messages):
        kinds = [variable for (variable, _), _ in m]
        expected = ["<*>" if variable else token for (variable, token), _ in m]
        shown = [w for k, w in enumerate(expected) if not (kinds[k] and k and kinds[k - 1])]
        assert got[i] == " ".join(shown), repr(texts[i])


MOMENT = st.datetimes(dt.datetime(1999, 1, 1), dt.datetime(2030, 12, 31)).map(lambda t: t.replace(microsecond=0))
ZONE = st.sampled_from(["Z", "+02:00", "-0530"])
FRACTION = st.integers(0, 999_999)


@st.composite
def stamped(draw):
    """(text, time it names or None)."""
    t = draw(MOMENT)
    day, clock = t.strftime("%Y-%m-%d"), t.strftime("%H:%M:%S")
    before = draw(st.sampled_from(["", "at ", "[x] "]))
    kind = draw(st.sampled_from(["bare T", "zone", "fraction", "space", "long", "month", "hour"]))
    if kind == "bare T":
        return f"{before}{day}T{clock} x", t
    if kind == "zone":
        return f"{before}{day}T{clock}{draw(ZONE)} x", t
    if kind == "fraction":
        us = draw(FRACTION)
        return f"{before}{day}T{clock}.{us:06d}{draw(ZONE)} x", t.replace(microsecond=us)
    if kind == "space":
        return f"{before}{day} {clock} x", t
    if kind == "long":  # seven digits are no fraction, and the T form has no other reading
        return f"{before}{day}T{clock}.1234567Z x", None
    if kind == "month":
        return f"{before}{t.year:04d}-13-01T{clock} x", None
    return f"{before}{day}T25:00:00 x", None


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(stamped(), min_size=200, max_size=200))
def test_timestamp_of_known_parts(spark, cases):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", parse_ts(F.col("t")).cast("timestamp_ntz")).collect()}
    for i, (text, expected) in enumerate(cases):
        assert got[i] == expected, text
