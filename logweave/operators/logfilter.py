"""Log filters (severity gate, allowlist, dedup, rate limit, truncation) and the
ordered filter waterfall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import INGEST_RANK, ingest_rank
from .ordering import join_null_safe

TRUNCATION_MARKER = "… [truncated]"  # fixed value


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def severity_gate_flag(level: Column, floor: str = "WARN") -> Column:
    """True when the entry is dropped: 0 <= rank < floor; unknown levels pass.
    An unknown floor name falls back to WARN."""
    floor_rank = INGEST_RANK.get((floor or "").upper(), 3)
    r = ingest_rank(level)
    return (r >= 0) & (r < F.lit(floor_rank))


def severity_gate(df: DataFrame, floor: str = "WARN", level: str = "level") -> DataFrame:
    return df.filter(~severity_gate_flag(F.col(level), floor))


def parse_allowlist(csv: str | None) -> list[str]:
    return sorted({s.strip().lower() for s in (csv or "").split(",") if s.strip()})


def allow_flag(service: Column, csv: str | None) -> Column:
    """True when the entry is dropped by the allowlist (empty list = all pass)."""
    allowed = parse_allowlist(csv)
    if not allowed:
        return F.lit(False)
    return ~F.coalesce(F.lower(service), F.lit("")).isin(allowed)


def allow_services(df: DataFrame, csv: str | None, service: str = "service_name") -> DataFrame:
    return df.filter(~allow_flag(F.col(service), csv))


#: A key's rows are cut into slices of so many dedup windows.
SLICE_WINDOWS = 4


def _runs(rb, names: list[str]):
    """Start positions of runs of equal ``names`` in a batch sorted by them (first is 0)."""
    import numpy as np
    import pyarrow.compute as pc
    change = np.zeros(rb.num_rows, dtype=bool)
    change[0] = True
    for name in names:
        c = rb.column(rb.schema.get_field_index(name))
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, rb.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _slice_tables(w_us: int, carried: bool):
    """Sorted (_k, _sl, _us) to one row a slice: its first time, and its outgoing last kept
    time as a step function of the time until which the incoming one blocks: ``outs[i]``
    for the first i with ``upto[i]`` at or after it; later than all, the incoming one stays.
    Without carried state the incoming time lies before the slice."""
    import numpy as np
    import pyarrow as pa

    def table(k: str, sl: int, t) -> tuple:
        n = len(t)
        following = np.r_[np.searchsorted(t, t + w_us), n]
        last = np.arange(n)
        while True:  # a slice holds a few windows, so this is a few steps
            ahead = following[last]
            if not (ahead < n).any():
                break
            last = np.where(ahead < n, ahead, last)
        out = t[last]
        if not carried:  # nothing that comes before the slice blocks longer than this
            m = int(np.searchsorted(t, sl * SLICE_WINDOWS * w_us + w_us)) + 1
            out = out[:m]
        ends = np.r_[np.flatnonzero(out[1:] != out[:-1]), len(out) - 1]
        return k, sl, int(t[0]), t[ends].tolist(), out[ends].tolist()

    def run(batches):
        held, times = None, []
        rows: list[tuple] = []

        def batch():
            cols = list(zip(*rows))
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], ["_k", "_sl", "_first", "_upto", "_outs"])
        for rb in batches:
            if not rb.num_rows:
                continue
            us = rb.column(2).to_numpy(zero_copy_only=False)
            starts = _runs(rb, ["_k", "_sl"]).tolist()
            for a, b in zip(starts, starts[1:] + [rb.num_rows]):
                key = (rb.column(0)[a].as_py(), rb.column(1)[a].as_py())
                if key != held:
                    if held is not None:
                        rows.append(table(*held, np.concatenate(times)))
                    held, times = key, []
                times.append(us[a:b])
            if len(rows) > 5000:
                yield batch()
                rows = []
        if held is not None:
            rows.append(table(*held, np.concatenate(times)))
        if rows:
            yield batch()
    return run


def _compose(w_us: int):
    """Step functions of a key's slices in order to (_k, _sl, _in): the last kept time that
    comes into a slice, where it matters."""
    from bisect import bisect_left

    import pyarrow as pa

    def run(batches):
        key, last = None, None
        for rb in batches:
            out = []
            cols = [c.to_pylist() for c in rb.columns]
            for k, sl, first, upto, outs in zip(*cols):
                if k != key:
                    key, last = k, None
                until = None if last is None else last + w_us
                if until is None or until <= first:
                    last = outs[0]
                else:
                    out.append((k, sl, last))
                    i = bisect_left(upto, until)
                    if i < len(outs):
                        last = outs[i]
            ks, sls, ins = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(sls, pa.int64()), pa.array(ins, pa.int64())], ["_k", "_sl", "_in"])
    return run


def _slice_fold(w_us: int, out_schema):
    """Arrow batches of rows sorted by (_k, _sl, _us, order) -> the same rows with the kept
    flag. A slice starts from its incoming last kept time (``_in``) and jumps from one kept row
    to the next with ``searchsorted``, so the work follows the kept rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        held, last = None, None
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            k, sl, usc, came = (rb.column(rb.schema.get_field_index(c)) for c in ("_k", "_sl", "_us", "_in"))
            us = pc.fill_null(usc, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flags = np.zeros(n, dtype=bool)
            starts = _runs(rb, ["_k", "_sl"]).tolist()
            for a, b in zip(starts, starts[1:] + [n]):
                key = (k[a].as_py(), sl[a].as_py())
                if key != held:
                    held, last = key, came[a].as_py()
                if not usc[a].is_valid:  # rows without a time have a slice of their own
                    flags[a:b] = True
                    continue
                t = us[a:b]
                i = 0 if last is None else int(np.searchsorted(t, last + w_us, side="left"))
                while i < b - a:
                    flags[a + i] = True
                    last = int(t[i])
                    i = int(np.searchsorted(t, last + w_us, side="left"))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(flags)], schema=out_schema)
    return run


def dedup_key(keys: list) -> Column:
    """One string for the key columns, different for different keys (null is a value)."""
    return F.concat(*[F.concat(F.coalesce(F.length(_c(k).cast("string")), F.lit(-1)).cast("string"), F.lit(":"),
                               F.coalesce(_c(k).cast("string"), F.lit(""))) for k in keys])


def dedup_flag(df: DataFrame, keys: list, ts: str, seconds: float, order: str,
               out: str = "kept", last_kept: DataFrame | None = None) -> DataFrame:
    """Exact last-kept duplicate suppression, as a flag column.

    Per key, in (ts, order) order, a row is kept when no row was kept before or
    the last *kept* row is at least ``seconds`` older; a dropped row does not
    extend the window; a row without a time is kept and changes nothing.
    ``last_kept`` (_k as :func:`dedup_key` makes it, _us) carries the last kept times of
    earlier data; rows at or before them are duplicates.

    The rule is sequential in a key, yet no key is one task's work: a key's rows are cut
    into slices of ``SLICE_WINDOWS`` windows. A slice's outgoing last kept time is
    tabulated as a step function of the incoming one; the functions, one row a slice, are
    composed along each key; then every slice is folded on its own from its incoming time.
    """
    if seconds is None or seconds <= 0:
        return df.withColumn(out, F.lit(True))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, StructField, StructType
    w_us = int(round(seconds * 1_000_000))
    us = F.unix_micros(F.col(ts))
    sl = F.coalesce(F.floor(us / F.lit(SLICE_WINDOWS * w_us)), F.lit(-(1 << 62)))
    # the input's columns travel as one, so they may have any names
    x = df.select(F.struct(*[c for c in df.columns if c != out]).alias("_row"), dedup_key(keys).alias("_k"), us.alias("_us"),
                  sl.cast("bigint").alias("_sl"), F.col(order).alias("_o"))
    table = "_k string, _sl bigint, _first bigint, _upto array<bigint>, _outs array<bigint>"
    steps = x.select("_k", "_sl", "_us").filter(F.col("_us").isNotNull()).repartition("_k", "_sl").sortWithinPartitions("_k", "_sl", "_us") \
        .mapInArrow(_slice_tables(w_us, last_kept is not None), table)
    if last_kept is not None:  # an earlier slice that always ends with the carried time
        steps = steps.unionByName(last_kept.select("_k", F.lit(-(1 << 62)).cast("bigint").alias("_sl"), F.col("_us").alias("_first"),
                                                   F.array("_us").alias("_upto"), F.array("_us").alias("_outs")))
    came = steps.repartition("_k").sortWithinPartitions("_k", "_sl").mapInArrow(_compose(w_us), "_k string, _sl bigint, _in bigint")
    x = x.repartition("_k", "_sl").join(came, ["_k", "_sl"], "left").select("_row", "_k", "_sl", "_us", "_in", "_o") \
         .sortWithinPartitions("_k", "_sl", "_us", "_o").drop("_o")
    schema = StructType(x.schema.fields + [StructField(out, BooleanType(), False)])
    return x.mapInArrow(_slice_fold(w_us, to_arrow_schema(schema)), schema).select("_row.*", out)


def dedup_window(df: DataFrame, keys: list, ts: str, seconds: float, order: str) -> DataFrame:
    return dedup_flag(df, keys, ts, seconds, order).filter("kept").drop("kept")


def rate_flag(df: DataFrame, service: str, ts: str, n: int, order: str, out: str = "kept") -> DataFrame:
    """First ``n`` rows per service and clock hour (in ts, order order) are kept.

    A hot (service, hour) group is split into minute sub-buckets: per-minute
    counts give each bucket its offset in the hour, and rows are ranked only
    inside their minute, so no task ranks a whole hot group; buckets wholly
    inside or outside the budget are decided by their offset alone. A row without
    a time is kept and counts for no hour.
    """
    if n is None or n <= 0:
        return df.withColumn(out, F.lit(True))
    x, flag = _rate_ranked(df, service, ts, n, order, F.lit(True))
    return x.withColumn(out, flag).drop(*_RATE_COLS)


_RATE_COLS = ["_svc", "_hour", "_min", "_n", "_off"]


def _service(service: str) -> Column:
    return F.coalesce(F.lower(F.col(service)), F.lit(""))


def _rate_ranked(df: DataFrame, service: str, ts: str, n: int, order: str, counted: Column,
                 used: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Rows with their minute's offset in the hour, and the column that says
    whether a row is within the budget; only ``counted`` rows use it up, and a row
    without a time is within it and uses nothing. ``used`` (_svc, _hour, _used): rows of
    earlier data within the budget."""
    svc = _service(service)
    x = df.withColumn("_svc", svc).withColumn("_hour", F.date_trunc("hour", F.col(ts))) \
          .withColumn("_min", F.date_trunc("minute", F.col(ts)))
    # one shuffle by minute bucket, read by both the counts and the join back
    x = x.repartition("_svc", "_hour", "_min")
    uses = (counted & F.col(ts).isNotNull()).cast("int")
    counts = x.groupBy("_svc", "_hour", "_min").agg(F.sum(uses).alias("_n"))
    wc = Window.partitionBy("_svc", "_hour").orderBy("_min").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wc), F.lit(0)))
    if used is not None:
        counts = counts.join(used, ["_svc", "_hour"], "left").withColumn("_off", F.col("_off") + F.coalesce("_used", F.lit(0))) \
                       .select("_svc", "_hour", "_min", "_n", "_off")
    x = join_null_safe(x, counts, ["_svc", "_hour", "_min"])
    wr = Window.partitionBy("_svc", "_hour", "_min").orderBy(F.col(ts), F.col(order)) \
               .rowsBetween(Window.unboundedPreceding, 0)
    flag = F.when(F.col(ts).isNull(), F.lit(True)) \
            .when(F.col("_off") + F.col("_n") <= n, F.lit(True)).when(F.col("_off") >= n, F.lit(False)) \
            .otherwise(F.col("_off") + F.sum(uses).over(wr) <= n)
    return x, flag


def rate_limit(df: DataFrame, service: str, ts: str, n: int, order: str) -> DataFrame:
    return rate_flag(df, service, ts, n, order).filter("kept").drop("kept")


def truncate_message(msg: Column, limit: int) -> Column:
    return F.when(F.length(msg) > limit, F.concat(F.substring(msg, 1, limit), F.lit(TRUNCATION_MARKER))).otherwise(msg)


def truncate_messages(df: DataFrame, limit: int = 2000, message: str = "message") -> DataFrame:
    return df.withColumn("truncated", F.coalesce(F.length(message) > limit, F.lit(False))) \
             .withColumn(message, truncate_message(F.col(message), limit))


@dataclass(frozen=True)
class FilterConfig:
    # Fixed defaults (equal to the reference's configuration defaults)
    min_severity: str = "WARN"
    allowed_services: str = ""
    dedup_seconds: float = 60.0
    rate_limit: int = 500
    max_message_length: int = 2000


@dataclass
class FilterState:
    """What the filters remember of earlier data: ``last_kept`` (_k, _us), the last kept
    time of each dedup key, and ``used`` (_svc, _hour, _used), the rows of each service and
    hour within the rate budget. None: nothing came before."""
    last_kept: DataFrame | None = None
    used: DataFrame | None = None


def filter_logs(df: DataFrame, cfg: FilterConfig = FilterConfig(), *, id_col: str = "log_id",
                ts: str = "ts", level: str = "level", service: str = "service_name",
                message: str = "message") -> tuple[DataFrame, DataFrame]:
    """Ordered waterfall: severity -> allowlist -> dedup -> rate limit -> truncate.

    Each dropped entry gets its first drop reason. Returns ``(kept, reasons)``;
    ``reasons`` has (reason, n) and also counts truncated messages (not dropped).
    Dedup and rate limit see only the survivors of the stages before them.
    """
    return split_reasons(filter_reasons(df, cfg, id_col=id_col, ts=ts, level=level, service=service, message=message), cfg, message)


def split_reasons(tagged: DataFrame, cfg: FilterConfig = FilterConfig(), message: str = "message") -> tuple[DataFrame, DataFrame]:
    """``(kept, reasons)`` from the rows of :func:`filter_reasons`."""
    kept = truncate_messages(tagged.filter(F.col("_reason").isNull()).drop("_reason"), cfg.max_message_length, message)
    cut = F.col("_reason").isNull() & (F.length(message) > cfg.max_message_length)
    reasons = (tagged.select(F.when(cut, F.lit("truncated")).otherwise(F.col("_reason")).alias("reason"))
               .filter(F.col("reason").isNotNull())
               .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
    return kept, reasons


def filter_reasons(df: DataFrame, cfg: FilterConfig = FilterConfig(), *, id_col: str = "log_id", ts: str = "ts",
                   level: str = "level", service: str = "service_name", message: str = "message",
                   state: FilterState = FilterState()) -> DataFrame:
    """Every input row with ``_reason``: why the waterfall drops it, null for a kept
    one. One dedup fold and one rate count serve both the kept rows and the reasons."""
    gated = df.withColumn(
        "_reason",
        F.when(severity_gate_flag(F.col(level), cfg.min_severity), F.lit("below_severity"))
         .when(allow_flag(F.col(service), cfg.allowed_services), F.lit("service_not_allowed")))
    passing = gated.filter(F.col("_reason").isNull()).drop("_reason")
    d = dedup_flag(passing, _dedup_keys(service, message), ts, cfg.dedup_seconds, id_col, out="_kept", last_kept=state.last_kept)
    if cfg.rate_limit and cfg.rate_limit > 0:
        d, within = _rate_ranked(d, service, ts, cfg.rate_limit, id_col, F.col("_kept"), state.used)
    else:
        within = F.lit(True)
    d = d.withColumn("_reason", F.when(~F.col("_kept"), F.lit("duplicate")).when(~within, F.lit("rate_limited")))
    return gated.filter(F.col("_reason").isNotNull()).unionByName(d.select(*df.columns, "_reason"))


def _dedup_keys(service: str, message: str) -> list[Column]:
    return [_service(service), F.coalesce(F.col(message), F.lit(""))]


def next_state(tagged: DataFrame, cfg: FilterConfig = FilterConfig(), state: FilterState = FilterState(), lateness: float = 3600,
               *, ts: str = "ts", service: str = "service_name", message: str = "message") -> FilterState:
    """The state after the rows of :func:`filter_reasons` (whose messages are as they
    came in). Keys whose window or hour ended ``lateness`` seconds before the newest row go."""
    timed = tagged.filter(F.col(ts).isNotNull())
    us = F.unix_micros(F.col(ts))
    last = timed.filter(F.col("_reason").isNull() | (F.col("_reason") == "rate_limited")) \
        .select(dedup_key(_dedup_keys(service, message)).alias("_k"), us.alias("_us"))
    used = timed.filter(F.col("_reason").isNull()).groupBy(_service(service).alias("_svc"), F.date_trunc("hour", F.col(ts)).alias("_hour")) \
        .agg(F.count(F.lit(1)).alias("_used"))
    newest = timed.agg(F.max(us).alias("_newest"))
    if state.last_kept is not None:
        last = last.unionByName(state.last_kept.select("_k", "_us"))
        newest = newest.unionByName(state.last_kept.agg(F.max("_us").alias("_newest"))).agg(F.max("_newest").alias("_newest"))
    if state.used is not None:
        used = used.unionByName(state.used.select("_svc", "_hour", "_used"))
    last = last.groupBy("_k").agg(F.max("_us").alias("_us"))
    used = used.groupBy("_svc", "_hour").agg(F.sum("_used").alias("_used"))
    top = newest.first()["_newest"]  # one number
    if top is not None:
        behind = top - int(lateness * 1_000_000)
        last = last.filter(F.col("_us") + int(round((cfg.dedup_seconds or 0) * 1_000_000)) > behind)
        used = used.filter(F.unix_micros("_hour") + 3_600_000_000 > behind)
    return FilterState(last, used)


def ingest_summary(kept: DataFrame, reasons: DataFrame, level: str = "level") -> DataFrame:
    """(metric, key, n): kept total, dropped total, kept count per level (null -> UNKNOWN)."""
    by_level = kept.groupBy(F.coalesce(F.col(level), F.lit("UNKNOWN")).alias("key")) \
                   .agg(F.count(F.lit(1)).alias("n")).withColumn("metric", F.lit("by_level"))
    total = kept.agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.lit("")).withColumn("metric", F.lit("ingested"))
    dropped = reasons.filter(F.col("reason") != "truncated").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")) \
                     .withColumn("key", F.lit("")).withColumn("metric", F.lit("dropped"))
    return by_level.unionByName(total).unionByName(dropped).select("metric", "key", "n")
