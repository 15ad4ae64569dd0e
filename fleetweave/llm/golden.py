"""p1: one surviving record for each group of duplicates, by skylines.

A record's criteria are how complete it is (fields with a value), how recent, and how far its source is trusted for each
field. One record dominates another if it is nowhere worse and somewhere better. Records of one source with values for
the same fields differ in recency only, so all but the newest of each (group, source, set of filled fields) are dominated
by one with the same fields; that first step is a `max_by` with map-side combine and leaves at most sources x 2^fields
records of a group, however large it is. Those are put into their dominance layers, all of them: a record's layer is one
below the deepest record that dominates it. A field is resolved by the lexicographic policy trust, recency, layer, value
over the records of the first layer, and where a later layer has a value that goes before (the first has none of that
source, or only an older one), it fills in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that only say "no value" (fixed values), lower case; besides them runs of one of 0 x - ? . and the counting
#: sequences below.
NO_VALUE = (
    "", "n/a", "na", "none", "null", "nil", "nan", "unknown", "?", "-", "--", "tbd", "not set", "not specified",
    "not available", "not applicable", "undefined", "empty", "default string", "system serial number",
    "to be filled by o.e.m.", "other", "unknown os", "nobody", "unassigned", "no user", "(none)", "(null)", "<none>",
    "123456789", "0123456789", "1234567890", "12345678",
)


def real_value(c: Column) -> Column:
    """The text without outer blanks, or null if it only says that there is none."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    empty = F.lower(t).isin(*NO_VALUE) | F.lower(t).rlike(r"^(0+|x{3,}|-+|\?+|\.+|_+)$")
    return F.when(c.isNotNull() & ~empty, t)


def _layered(rows: Column, n: int) -> Column:
    """`(row, layer)` of an array of rows, layers from 1, by one pass in an order in which a row comes after all that dominate it."""

    def beats(a: Column, b: Column) -> Column:
        no_worse = [a["at"] >= b["at"], a["full"] >= b["full"], *(a[f"r{i}"] <= b[f"r{i}"] for i in range(n))]
        better = [a["at"] > b["at"], a["full"] > b["full"], *(a[f"r{i}"] < b[f"r{i}"] for i in range(n))]
        return reduce(Column.__and__, no_worse) & reduce(Column.__or__, better)

    def place(done: Column, row: Column) -> Column:
        above = F.array_max(F.transform(F.filter(done, lambda x: beats(x["row"], row)), lambda x: x["layer"]))
        return F.array_append(done, F.struct(row.alias("row"), (F.coalesce(above, F.lit(0)) + 1).alias("layer")))

    # nowhere worse and somewhere better: earlier in this order
    total = lambda r: reduce(Column.__add__, [r[f"r{i}"].cast("long") for i in range(n)])
    ordered = F.transform(F.array_sort(F.transform(rows, lambda r: F.struct((-F.unix_micros(r["at"])).alias("a"), (-r["full"]).alias("f"), total(r).alias("t"), r.alias("r")))), lambda x: x["r"])
    none = F.filter(F.transform(ordered, lambda r: F.struct(r.alias("row"), F.lit(0).alias("layer"))), lambda _: F.lit(False))
    return F.aggregate(ordered, none, place)


def survivors(records: DataFrame, trust: DataFrame, group: str, source: str, fetched: str, fields: dict[str, str]) -> DataFrame:
    """`(group, *fields)`: for each group the surviving value of each field, null without any real value.

    `fields` maps a field to the column of `trust` with its rank (1 = most trusted; sources without a rank come last).
    Of values equal in trust and recency that of a record that dominates the others survives, else the smallest text. Rows repeated in full count once; null groups are
    left out; records without a time count as the oldest.
    """
    names = list(fields)
    rank = trust.select(F.col(source).alias("_s"), *(F.col(c).cast("int").alias(f"r{i}") for i, c in enumerate(fields.values())))
    values = [real_value(F.col(c)).alias(f"v{i}") for i, c in enumerate(names)]
    rows = records.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(source).alias("_s"), F.col(fetched).alias("at"), *values)
    has = [F.col(f"v{i}").isNotNull() for i in range(len(names))]
    rows = rows.where(reduce(Column.__or__, has))
    mask = reduce(Column.__add__, [h.cast("int") * (1 << i) for i, h in enumerate(has)])
    at = F.coalesce(F.col("at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800)))
    rows = rows.select("g", "_s", at.alias("at"), mask.alias("mask"), *(f"v{i}" for i in range(len(names))))
    # among the newest of equal time, the smallest value field by field: one max and, per field, one min
    newest = rows.groupBy("g", "_s", "mask").agg(
        F.max("at").alias("at"),
        *(F.max_by(F.struct(f"v{i}"), F.struct("at", _falling(f"v{i}")))[f"v{i}"].alias(f"v{i}") for i in range(len(names))),
    )
    # a system table of fixed size: the number of sources
    ranked = newest.join(F.broadcast(rank), "_s", "left")
    worst = F.lit(2**31 - 1)
    full = reduce(Column.__add__, [F.col(f"v{i}").isNotNull().cast("int") for i in range(len(names))])
    row = F.struct("at", full.alias("full"), *(F.coalesce(f"r{i}", worst).alias(f"r{i}") for i in range(len(names))), *(f"v{i}" for i in range(len(names))))
    grouped = ranked.groupBy("g").agg(F.collect_list(row).alias("rows"))  # at most sources x 2^fields
    layered = grouped.select("g", _layered(F.col("rows"), len(names)).alias("rows"))
    return layered.select(F.col("g").alias(group), *(_by_policy(F.col("rows"), i).alias(c) for i, c in enumerate(names)))


def _by_policy(rows: Column, i: int) -> Column:
    """Value of field `i`: of the most trusted, then newest, then least dominated, then smallest."""
    with_value = F.filter(rows, lambda x: x["row"][f"v{i}"].isNotNull())
    keyed = F.transform(with_value, lambda x: F.struct(x["row"][f"r{i}"].alias("r"), (-F.unix_micros(x["row"]["at"])).alias("t"), x["layer"].alias("l"), x["row"][f"v{i}"].alias("v")))
    return F.array_min(keyed)["v"]


def _falling(c: str) -> Column:
    """A sort key that falls as the text grows, so that `max_by` takes the smallest text."""
    return F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210")


def disagreements(mart: DataFrame, best: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """`(group, field)` for each row of `mart` and field whose value isn't the surviving one.

    Compared without case and outer blanks; no surviving value stands for `''`, as does null in `mart`.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    b = best.select(F.col(group), *(F.col(f).alias(f"_b_{f}") for f in fields))
    joined = mart.select(group, *fields).join(b, group, "left")
    wrong = F.array(*(F.when(plain(F.col(f)) != plain(F.col(f"_b_{f}")), F.lit(f)) for f in fields))
    return joined.select(group, F.explode(F.array_compact(wrong)).alias("field"))
