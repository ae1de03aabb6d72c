"""Ordered scans, ranks and exact quantiles that never put one key in one task.

A plain window over a hot key sorts that whole key in a single task. Each scan here deals
the rows out by ranges of (key, order), so that a range holds about ``ROWS`` of them
whatever keys, instants or values they share, runs inside each range, reduces a key's part
of a range to one summary row, runs the window over the summaries only, and joins the
carried value back. Orders must end in a column that tells equal rows apart.
Keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlumen.session import materialize

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)
ROWS = 1_000_000


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, the number of the range of (keys, order) that a row is in:
    about ``rows`` rows each. Written once, so that all later uses see the same ranges."""
    by = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    parts = max(1, -(-df.count() // (rows or ROWS)))
    dealt = df.repartitionByRange(parts, *by)
    return materialize(dealt.withColumn("_slice", F.spark_partition_id().cast("long")), "ranges")


def value_slice(value: Column, per_e: int = 4096) -> Column:
    """Monotone bucket number of a double, ``per_e`` buckets per factor e."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value) * 1e6) * per_e)).cast("long")


def carry(df: DataFrame, keys: Sequence[str], slice_col: str, totals: dict[str, Column],
          carried: dict[str, callable]) -> DataFrame:
    """Join to each row what the earlier slices of its key add up to.

    ``totals`` reduces a slice to one row; ``carried`` turns those into the value
    handed to the next slices, given the window over slices (``before`` excludes
    the slice itself, ``whole`` spans the key).
    """
    group = [*keys, slice_col]
    summary = df.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()])
    # With no key this is one task over one row per slice, bounded by the slice count.
    ordered = Window.partitionBy(*keys).orderBy(slice_col)
    whole = Window.partitionBy(*keys)
    summary = summary.select(*group, *[
        f(ordered, whole).alias(n) for n, f in carried.items()
    ])
    # Plain equality keeps the rows' own partitioning: only the summaries move.
    return df.join(summary, group, "left")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            lags: dict[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """Running sums and maxima and previous-row values along ``order`` within ``keys``.

    Output keeps every input column.
    """
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    base = ranges(df, keys, order, rows)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = local.rowsBetween(*UP_TO)
    base = base.withColumns({
        **{f"_s_{n}": F.sum(c).over(upto) for n, c in sums.items()},
        **{f"_m_{n}": F.max(c).over(upto) for n, c in maxes.items()},
        **{f"_v_{n}": c for n, c in lags.items()},
        **({"_rn": F.row_number().over(local)} if lags else {}),
    })
    if lags:
        base = base.withColumns({f"_l_{n}": F.lag(f"_v_{n}").over(local) for n in lags})
    totals = {
        **{f"_ts_{n}": F.sum(c) for n, c in sums.items()},
        **{f"_tm_{n}": F.max(c) for n, c in maxes.items()},
        **{f"_tl_{n}": F.max_by(F.struct(F.col(f"_v_{n}").alias("v")), "_rn") for n in lags},
    }

    def total_before(name):
        return lambda o, w: F.sum(f"_ts_{name}").over(o.rowsBetween(*BEFORE))

    def max_before(name):
        return lambda o, w: F.max(f"_tm_{name}").over(o.rowsBetween(*BEFORE))

    def last_before(name):
        return lambda o, w: F.lag(f"_tl_{name}").over(o)

    carried = {
        **{f"_bs_{n}": total_before(n) for n in sums},
        **{f"_bm_{n}": max_before(n) for n in maxes},
        **{f"_bl_{n}": last_before(n) for n in lags},
    }
    joined = carry(base, keys, "_slice", totals, carried)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.coalesce(F.col(f"_bs_{n}"), F.lit(0))).alias(n)
          for n in sums],
        *[F.greatest(f"_m_{n}", f"_bm_{n}").alias(n) for n in maxes],
        *[F.when(F.col("_rn") == 1, F.col(f"_bl_{n}.v")).otherwise(F.col(f"_l_{n}")).alias(n)
          for n in lags],
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rn", total: str | None = None,
                rows: int | None = None) -> DataFrame:
    """``row_number`` over the whole table without a one-task sort."""
    base = ranges(df, [], order, rows)
    local = Window.partitionBy("_slice").orderBy(*order)
    base = base.withColumn("_rn", F.row_number().over(local))
    carried = {"_before": lambda o, w: F.sum("_n").over(o.rowsBetween(*BEFORE))}
    if total:
        carried["_total"] = lambda o, w: F.sum("_n").over(w)
    joined = carry(base, [], "_slice", {"_n": F.count(F.lit(1))}, carried)
    cols = [(F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long").alias(name)]
    if total:
        cols.append(F.col("_total").alias(total))
    return joined.select(*df.columns, *cols)


def in_window(df: DataFrame, keys: Sequence[str], ts: str, window_s: float, name: str,
              first: str | None = None, upto: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds how many rows of a key lie in the ``window_s`` seconds up to and at each row's
    time; optionally the time of the first of them and the number of all rows so far.

    Rows of one instant are counted together first. Every instant also sends a mark to the
    instant it leaves the window, and one running sum over instants and marks in time order
    gives the numbers, whatever the window holds."""
    keys = list(keys)
    at = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_c"))
    mark = at.select(*keys, (F.col(ts) + F.lit(float(window_s))).alias(ts), F.lit(1).alias("_mark"), (-F.col("_c")).alias("_c"))
    both = at.withColumn("_mark", F.lit(0)).unionByName(mark)
    # A mark at an instant itself comes after it: the rows it stands for still count.
    run = running(both, keys, [ts, "_mark"], rows=rows, sums={
        name: F.col("_c"), "_all": F.when(F.col("_mark") == 0, F.col("_c")),
        "_nth": 1 - F.col("_mark"), "_left": F.col("_mark")})
    out = run.filter("_mark = 0").drop("_mark", "_c")
    if first:
        nth = out.select(*keys, (F.col("_nth") - 1).alias("_left"), F.col(ts).alias(first))
        out = out.join(nth, [*keys, "_left"])
    more = [F.col(c) for c in (name, first) if c] + ([F.col("_all").alias(upto)] if upto else [])
    return df.join(out.select(*keys, ts, *more), [*keys, ts])


def histogram_quantiles(values: DataFrame, value: str, picks: dict[str, tuple[str, float]],
                        nearest: bool = False) -> DataFrame:
    """One row of quantiles read from counts per distinct value: each pick names a count
    column and q. Linearly interpolated, or the element at position ``floor(n * q)``.
    A popular value is one row here, however often it occurs."""
    counts = sorted({c for c, _ in picks.values()})
    totals = values.agg(*[F.sum(c).alias(f"_t{c}") for c in counts]).select(F.struct("*")).scalar()
    upto = running(values.select(value, *counts), [], [value], sums={f"_u{c}": F.col(c) for c in counts})
    upto = upto.withColumn("_t", totals)

    def at(c: str, rank: Column) -> Column:
        before = F.col(f"_u{c}") - F.col(c)
        return F.max(F.when((before <= rank) & (rank < F.col(f"_u{c}")), F.col(value)))

    out = []
    for name, (c, q) in picks.items():
        h = F.col(f"_t._t{c}") * q if nearest else (F.col(f"_t._t{c}") - 1) * q
        low, high = at(c, F.floor(h)), at(c, F.ceil(h))
        share = F.max(h - F.floor(h))
        out.append((low if nearest else low + (high - low) * share).alias(name))
    return upto.agg(*out)


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float],
                    by: Sequence[str] = (), per_e: int = 4096) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group and q.

    Counts per value bucket locate each rank; only the buckets that hold a wanted
    rank are then counted by value. No group is ever held in one buffer.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows.withColumn("_b", value_slice(F.col("_v"), per_e))
    hist = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*by).orderBy("_b")
    hist = hist.select(*by, "_b", "_n",
                       (F.sum("_n").over(ordered.rowsBetween(*UP_TO)) - F.col("_n")).alias("_lo"),
                       F.sum("_n").over(Window.partitionBy(*by)).alias("_total"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    ranks = hist.select("*", wanted).withColumn("_h", (F.col("_total") - 1) * F.col("q"))
    ranks = ranks.withColumns({"_k0": F.floor("_h"), "_k1": F.ceil("_h")})

    def holds(k: str, lo: str, n: str) -> Column:
        return (F.col(k) >= F.col(lo)) & (F.col(k) < F.col(lo) + F.col(n))

    # At most two buckets per (group, q). These one-sided joins can broadcast the ranks only:
    # ``rows`` may be made of far more rows than the size Spark estimates for them.
    buckets = ranks.select(*by, "_b").distinct()
    counted = rows.join(buckets, [*by, "_b"], "left_semi").groupBy(*by, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(*UP_TO)
    counted = counted.select(*by, "_b", "_v", "_c", (F.sum("_c").over(inside) - F.col("_c")).alias("_in"))
    hits = counted.join(ranks.select(*by, "_b", "_lo", "q", "_h", "_k0", "_k1"), [*by, "_b"], "left")
    hits = hits.withColumn("_at", F.col("_lo") + F.col("_in"))
    low = F.max(F.when(holds("_k0", "_at", "_c"), F.col("_v")))
    high = F.max(F.when(holds("_k1", "_at", "_c"), F.col("_v")))
    return (hits.groupBy(*by, "q", "_h", "_k0").agg(low.alias("_low"), high.alias("_high"))
            .select(*by, "q", (F.col("_low") + (F.col("_high") - F.col("_low"))
                               * (F.col("_h") - F.col("_k0"))).alias("value")))


def _last_known(df: DataFrame, keys: Sequence[str], at: str, known: str) -> DataFrame:
    """Give each row the latest non-NULL ``known`` at or before it; at a tie the row
    that knows comes first. For groups of bounded size."""
    w = (Window.partitionBy(*keys).orderBy(F.col(at), F.col(known).isNull())
         .rowsBetween(*UP_TO))
    return df.withColumn("_known", F.last(known, ignorenulls=True).over(w))


def values_at_ranks(df: DataFrame, value: str, ranks: DataFrame, by: Sequence[str],
                    per_e: int = 4096) -> DataFrame:
    """The value at each wanted 0-based ascending ``rank`` of its group.

    ``ranks`` (by, rank, any further columns) should be small: it is looked up in the
    bucket histogram, and only the buckets hit are counted by value.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows.withColumn("_b", value_slice(F.col("_v"), per_e))
    hist = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*by).orderBy("_b").rowsBetween(*UP_TO)
    hist = hist.withColumn("_at", F.sum("_n").over(up) - F.col("_n"))
    asked = ranks.withColumn("_at", F.col("rank").cast("long"))
    found = _last_known(
        asked.unionByName(hist.select(*by, "_at", F.col("_b").alias("_bucket"),
                                      F.col("_at").alias("_lo")), allowMissingColumns=True)
        .withColumn("_hit", F.when(F.col("_bucket").isNotNull(), F.struct("_bucket", "_lo"))),
        by, "_at", "_hit").filter(F.col("rank").isNotNull())
    found = found.select(*ranks.columns, "_at", F.col("_known._bucket").alias("_b"),
                         F.col("_known._lo").alias("_lo"))
    # As above, only the few places found can be broadcast.
    places = found.select(*by, "_b", "_lo").distinct()
    counted = (rows.join(places.select(*by, "_b"), [*by, "_b"], "left_semi")
               .groupBy(*by, "_b", "_v").agg(F.count(F.lit(1)).alias("_c")))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(*UP_TO)
    counted = counted.select(*by, "_b", "_v", (F.sum("_c").over(inside) - F.col("_c")).alias("_in"))
    starts = counted.join(places, [*by, "_b"], "left").select(
        *by, "_b", F.col("_v").alias("_value"), (F.col("_lo") + F.col("_in")).alias("_at"))
    both = found.drop("_lo").unionByName(starts, allowMissingColumns=True)
    out = _last_known(both, [*by, "_b"], "_at", "_value").filter(F.col("rank").isNotNull())
    return out.select(*ranks.columns, F.col("_known").alias("value"))
