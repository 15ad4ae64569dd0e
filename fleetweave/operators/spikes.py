"""p3: readings that can't be believed, judged by how their series normally runs.

Rows are brought together by series once, and everything below works on that partitioning:

1. a KLL sketch per series and hour of the day gives what is normal at that hour; merged over the hours (and the pieces of
   a long series), they give the series' expanded interquartile fences;
2. readings within the fences span the first range. What lies outside is summed up in rings of doubling distance (their
   smallest and largest value), so a series of any size has a bounded summary. Rings within one width of the range
   join it, until none does. That is exact: a ring is no wider than the range it just made by its nearest value, so it
   joins as a whole or not at all, and fences one interquartile range wide never hold a reading that leaves the final
   range by more than its width, as long as such readings are fewer than a quarter;
3. a reading beyond the range by more than its width is still normal if the series is there at that hour day by day: the
   reading lies within the width of what `USUAL` of the readings at its hour reach, over two days or more. Such a daily
   course widens the range;
4. in order of time, the other readings beyond the range by more than its width are spikes if the excursion lasts a few
   readings only (jumping out of it and back by more than the width, an implausible rate of change); longer ones are a
   change of level and widen the range too. Equal values in a row are stuck if the series otherwise moves (zero
   variance in between is otherwise just a constant series).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.operators.ordered import TARGET_ROWS, chunked

#: Possible values by unit (fixed values).
UNIT_BOUNDS = {"%": (0.0, 100.0), "ratio": (0.0, 1.0), "C": (-273.15, None), "ms": (0.0, None), "rpm": (0.0, None), "Bps": (0.0, None), "bps": (0.0, None)}
#: Readings a spike may last, and equal readings that make a run.
FEW, RUN = 6, 12
#: Expansion of the fences in interquartile ranges (see above why one).
FENCE = 1.0
#: What makes a daily course: an hour seen on two days or more with so many readings at least (one less from the third day
#: on, so that one reading a day is enough), and the share of them that go as far.
COURSE, USUAL = 4, 0.7
_HOUR, _DAY = 3_600_000_000, 86_400_000_000
_INSIDE, _ABOVE = 0, 100_000


def impossible(value: Column, tags: Column) -> Column:
    """Whether the unit in `tags` (`units=...`) rules the value out; NaN and infinities are ruled out for any unit."""
    unit = F.try_element_at(F.filter(tags, lambda t: t.startswith("units=")), F.lit(1))
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    for u, (lo, hi) in UNIT_BOUNDS.items():
        out = value < lo if hi is None else (value < lo) | (value > hi)
        bad = bad | F.coalesce(unit == f"units={u}", F.lit(False)) & out
    return bad


def _joined(rings: Column, start: Column) -> Column:
    """The range after all rings in reach have joined it; `start` is the range within the fences."""

    def step(r: Column, ring: Column) -> Column:
        w = r["hi"] - r["lo"]
        up = (ring["c"] > _INSIDE) & (ring["lo"] <= r["hi"] + w)
        down = (ring["c"] < _INSIDE) & (ring["hi"] >= r["lo"] - w)
        return F.struct(F.when(down, F.least(r["lo"], ring["lo"])).otherwise(r["lo"]).alias("lo"), F.when(up, F.greatest(r["hi"], ring["hi"])).otherwise(r["hi"]).alias("hi"))

    outer = F.filter(rings, lambda x: x["c"] != _INSIDE)
    ordered = F.array_sort(F.transform(outer, lambda x: F.struct(F.abs(x["c"]).alias("d"), x["c"].alias("c"), x["lo"].alias("lo"), x["hi"].alias("hi"))))
    # as many passes as rings: each pass but the last lets at least one in
    passes = F.sequence(F.lit(0), F.size(outer))
    return F.aggregate(passes, start, lambda r, _: F.aggregate(ordered, r, step))


def readings(metrics: DataFrame, series: list[str], key: str, value: str, tags: str, at: str, target: int = TARGET_ROWS) -> DataFrame:
    """`(key, reason)` of readings that can't be believed: `impossible`, `spike` or `stuck`, in that precedence.

    Readings without a value are no readings. A `key` delivered again counts once (repeats have the same time and
    value). Null series columns are a value of their own; readings without a time come first, those of one time in
    order of `key`. An empty table gives an empty table. Series of more than `target` rows are cut in time, with the
    readings at either side of a cut for the windows; their ranges, whether they otherwise move and their changes of level are
    merged over the cuts, so that the size of a series doesn't change what is found.
    """
    names = [f"s{i}" for i in range(len(series))]
    rows = metrics.where(F.col(value).isNotNull()).select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(n) for c, n in zip(series, names)),
        F.col(key).alias("id"), F.col(value).cast("double").alias("v"),
        F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63))).alias("t"), impossible(F.col(value), F.col(tags)).alias("bad"),
    )
    sizes = metrics.where(F.col(value).isNotNull()).select(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(n) for c, n in zip(series, names)))
    pieces = chunked(rows, names, "t", ["id"], RUN + FEW + 1, target, sizes_of=sizes)
    by = pieces.by
    # every branch below reads all columns of this one exchange, so that it is made once
    spread = pieces.spread()
    own = F.col("_own") if pieces.cut else F.lit(True)
    good = F.when(own & ~F.col("bad") & F.col("id").isNotNull(), F.col("v"))
    hour = F.pmod(F.floor(F.col("t") / _HOUR), F.lit(24)).cast("int")
    day = F.when(good.isNotNull(), F.floor(F.col("t") / _DAY))
    sketches = spread.groupBy(*by, hour.alias("hour")).agg(F.kll_sketch_agg_double(good).alias("sketch"), F.count(good).alias("n"), F.min(day).alias("d0"), F.max(day).alias("d1")).where("n > 0")
    if pieces.cut:
        # those of the pieces of a series become one for each hour, and go back to every piece
        per_hour = sketches.groupBy(*names, "hour").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
        sketches = sketches.select(*by).distinct().join(per_hour, names)
    q = lambda r: F.kll_sketch_get_quantile_double("sketch", F.lit(r))
    days = F.col("d1") - F.col("d0")
    daily = (days >= 1) & (F.col("n") >= COURSE - F.when(days >= 2, 1).otherwise(0))
    # at most 24 hours a series
    hours = F.collect_list(F.when(daily, F.struct("hour", q(1 - USUAL).alias("lo"), q(USUAL).alias("hi"))))
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), hours.alias("hours"))
    fences = merged.select(*by, q(0.25).alias("q1"), q(0.75).alias("q3"), "hours")
    fences = fences.select(*by, (F.col("q1") - FENCE * (F.col("q3") - F.col("q1"))).alias("f_lo"), (F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))).alias("f_hi"), "hours")
    # only hours that are beyond the fences as a rule can tell anything; most series have none, so the list travels as part of the key
    fences = fences.select(*by, "f_lo", "f_hi", F.array_sort(F.filter("hours", lambda h: (h["lo"] > F.col("f_hi")) | (h["hi"] < F.col("f_lo")))).alias("usual"))

    v = F.col("v")
    ring = lambda d: F.floor(2 * F.log2(d)).cast("int")
    code = F.when(v > F.col("f_hi"), _ABOVE + ring(v - F.col("f_hi"))).when(v < F.col("f_lo"), -_ABOVE - ring(F.col("f_lo") - v)).otherwise(_INSIDE)
    placed = spread.join(fences.hint("shuffle_hash"), by).select(*by, "usual", code.alias("c"), good.alias("g"))
    rings = placed.groupBy(*by, "usual", "c").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo is not null")
    if pieces.cut:
        all_rings = rings.groupBy(*names, "usual", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        rings = merged.select(*by).join(all_rings, names)
    summed = rings.groupBy(*by, "usual").agg(F.collect_list(F.struct("c", "lo", "hi")).alias("rings"), F.min(F.when(F.col("c") == _INSIDE, F.col("lo"))).alias("lo"), F.max(F.when(F.col("c") == _INSIDE, F.col("hi"))).alias("hi"))
    ranges = summed.select(*by, "usual", _joined(F.col("rings"), F.struct("lo", "hi")).alias("r")).select(*by, "usual", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))

    order = Window.partitionBy(*by).orderBy("t", "id")
    frame = lambda a, b: order.rowsBetween(a, b)
    whole = Window.partitionBy(*by)
    width = F.col("hi") - F.col("lo")
    beyond = F.coalesce(~F.col("bad") & ((v > F.col("hi") + width) | (v < F.col("lo") - width)), F.lit(False))
    reached = F.exists("usual", lambda h: (h["hour"] == hour) & F.when(v > F.col("hi"), v <= h["lo"] + width).otherwise(v >= h["hi"] - width))
    timed = spread.join(ranges.hint("shuffle_hash"), by, "left").select(*spread.columns, "lo", "hi", beyond.alias("beyond"), (beyond & F.coalesce(reached, F.lit(False))).alias("course"))
    timed = timed.withColumn("again", F.lag("id").over(order).eqNullSafe(F.col("id")) & F.col("id").isNotNull()).where("not again")
    full = (F.count(F.lit(1)).over(frame(1 - RUN, 0)) == RUN) & (F.min("v").over(frame(1 - RUN, 0)) == F.max("v").over(frame(1 - RUN, 0)))
    timed = timed.withColumn("full", full)
    long_out = F.sum(F.col("beyond").cast("int")).over(frame(-FEW, 0)) == FEW + 1
    timed = timed.withColumn("long_out", long_out).withColumn("run", F.max("full").over(frame(0, RUN - 1)))
    timed = timed.withColumn("lasting", F.col("course") | F.max("long_out").over(frame(0, FEW)))
    loose = F.when(~F.col("run") & ~F.col("bad") & (~F.col("beyond") | F.col("lasting")), v)
    level = F.when(F.col("lasting") & F.col("beyond"), v)
    if pieces.cut:
        # the pieces of a cut series are summed up to one row; there are as many as series beyond the target
        parts = timed.where("_own and _chunk > 0").select(*names, loose.alias("loose"), level.alias("level"))
        series_of = parts.groupBy(*names).agg(F.lit(True).alias("is_cut"), (F.max("loose") > F.min("loose")).alias("c_moves"), F.min("level").alias("c_lo"), F.max("level").alias("c_hi"))
        timed = timed.join(F.broadcast(series_of), names, "left")
        of = lambda c, piece: F.when(F.col("is_cut"), F.col(c)).otherwise(piece)
    else:
        of = lambda _, piece: piece
    extent = {"moves": F.max(loose).over(whole) > F.min(loose).over(whole), "l_lo": F.min(level).over(whole), "l_hi": F.max(level).over(whole)}
    timed = timed.withColumns({n: of(c, extent[n]) for n, c in (("moves", "c_moves"), ("l_lo", "c_lo"), ("l_hi", "c_hi"))})
    lo, hi = F.least("lo", "l_lo"), F.greatest("hi", "l_hi")
    spike = F.col("beyond") & ~F.col("lasting") & ((v > hi + (hi - lo)) | (v < lo - (hi - lo)))
    reason = F.when(F.col("bad"), F.lit("impossible")).when(spike, F.lit("spike")).when(F.col("run") & F.coalesce("moves", F.lit(False)), F.lit("stuck"))
    return pieces.only_own(timed.withColumn("reason", reason).where("reason is not null")).select(F.col("id").alias(key), "reason")
