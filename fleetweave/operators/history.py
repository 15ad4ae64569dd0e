"""p7: the versions of changing attributes with the period each was valid (type-two dimension)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.operators.ordered import TARGET_ROWS, chunked, neighbour
from fleetweave.session import discard, staged

#: Texts that stand for "no value" (fixed values), lower case.
PLACEHOLDERS = ("", "null", "none", "n/a", "na", "nil", "nan", "-", "--", "?", "unknown", "not set", "tbd")


def cleaned(c: Column) -> Column:
    """The value without outer blanks, null for a placeholder."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def _states(changes: DataFrame, keys: list[str], old: str, new: str, at: str, batch: str, target: int) -> DataFrame:
    """`(*keys, at, value, hash, ends, first)`: what each attribute is from each instant on (null for no value), rows that
    change nothing within `changes` left out; `ends` is the next instant, -1 for the last, `first` marks the first.

    Of several rows of an attribute at one instant the last batch counts, and of one batch the row with the largest
    value (a `max_by` with map-side combine, so replays of a long history vanish before the shuffle). The value that
    stands before a row is the one of the row before, and a state ends where the next one begins: both look one row
    away, which `chunked` serves for histories of any length.
    """
    o, n = cleaned(F.col(old)), cleaned(F.col(new))
    us = F.unix_micros(F.col(at).cast("timestamp")).alias("at")
    rows = changes.where(F.col(at).isNotNull()).select(*keys, us, F.col(batch).alias("b"), o.alias("o"), n.alias("n"))
    last = rows.groupBy(*keys, "at").agg(F.max_by(F.struct("o", "n"), F.struct("b", "n", "o")).alias("r")).select(*keys, "at", "r.o", "r.n")
    said = last.where(~F.col("o").eqNullSafe(F.col("n"))).select(*keys, "at", F.col("n").alias("value"), F.xxhash64("n").alias("hash"))
    a = chunked(said, keys, "at", [], 1, target, sizes_of=changes)
    order = [F.col("at")]
    first = neighbour(a, order, F.lit(True), 1).isNull()
    before, hash_before = neighbour(a, order, F.col("value"), 1), neighbour(a, order, F.col("hash"), 1)
    same = ~first & (F.col("hash") == hash_before) & F.col("value").eqNullSafe(before)
    moved = a.only_own(a.df.withColumn("_same", same).withColumn("first", first)).where("not _same").drop("_same")
    # the ends: without a cut this window has the partitioning and order of the one above, so nothing is moved again
    b = chunked(moved, keys, "at", [], 1, target) if a.cut else type(a)(moved, keys, False)
    return b.only_own(b.df.withColumn("ends", F.coalesce(neighbour(b, order, F.col("at"), -1), F.lit(-1))))


def merge_changes(dimension: DataFrame, changes: DataFrame, keys: list[str], old: str, new: str, at: str, batch: str, target: int = TARGET_ROWS) -> DataFrame:
    """A type-two dimension `(*keys, value, hash, valid_from_us, valid_to_us)` brought up to `changes`, none of them earlier
    than a version in it.

    The first state of each attribute in `changes` is compared, by hash and, where hashes agree, by value, with the version
    that is open: if equal, that version goes on to where this state ends, else it is closed where it begins. States with a
    value that isn't the open one's become versions, the last of them open. Closed versions, and the states after the first,
    pass without being joined, so the join has a row per attribute at either side, however long its history.
    """
    states = staged(_states(changes, keys, old, new, at, batch, target), "p7-states")
    shape = [*keys, "value", "hash", "valid_from_us", "valid_to_us"]
    closed = dimension.where("valid_to_us <> -1").select(shape)
    open_ = dimension.where("valid_to_us = -1").select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.lit(True).alias("stands"), F.col("value").alias("v0"), F.col("hash").alias("h0"), F.col("valid_from_us").alias("from0"))
    head = states.where("first").select("*", F.lit(True).alias("there"))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)])
    both = head.join(open_, on, "full_outer")
    either = [F.when(F.col("there"), F.col(k)).otherwise(F.col(f"k{i}")).alias(k) for i, k in enumerate(keys)]
    goes_on = F.coalesce(F.col("stands") & F.col("there") & (F.col("hash") == F.col("h0")) & F.col("value").eqNullSafe(F.col("v0")), F.lit(False))
    before = F.when(F.col("stands"), F.struct(F.col("v0").alias("value"), F.col("h0").alias("hash"), F.col("from0").alias("valid_from_us"), F.when(goes_on, F.col("ends")).when(F.col("there"), F.col("at")).otherwise(F.lit(-1)).alias("valid_to_us")))
    begun = F.when(F.col("there") & F.col("value").isNotNull() & ~goes_on, F.struct("value", "hash", F.col("at").alias("valid_from_us"), F.col("ends").alias("valid_to_us")))
    merged = both.select(*either, F.explode(F.array_compact(F.array(before, begun))).alias("v")).select(*keys, "v.*")
    later = states.where("not first and value is not null").select(*keys, "value", "hash", F.col("at").alias("valid_from_us"), F.col("ends").alias("valid_to_us"))
    return closed.unionByName(merged).unionByName(later)


def versions(changes: DataFrame, keys: list[str], old: str, new: str, at: str, batch: str, target: int = TARGET_ROWS, periods: int = 2) -> DataFrame:
    """`(*keys, value, valid_from_us, valid_to_us)`: a row per version begun by a change; `valid_to_us` -1 while it stands.

    The changes are merged into an empty dimension in `periods` of about as many rows each, the earliest first, as updates
    that come in would be (`merge_changes`); the result doesn't depend on where they are cut. A row that reports no change,
    or the value that already stands, is none; a change to no value ends a version and begins none. Rows with a null
    instant are left out; null keys are a key of their own; an empty table gives an empty table.
    """
    keyed = changes.select(*keys, old, new, at, batch)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cuts = changes.select(micros.alias("t")).agg(F.percentile_approx("t", F.array(*(F.lit((i + 1) / periods) for i in range(periods - 1))), 1000)).first()[0] if periods > 1 else []
    cuts = sorted(set(cuts or []))
    longs = (F.lit(None).cast("long").alias(c) for c in ("hash", "valid_from_us", "valid_to_us"))
    dimension = changes.select(*keys, F.lit(None).cast("string").alias("value"), *longs).where(F.lit(False))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        mine = F.lit(True) if lo is None else micros > lo
        before = dimension
        dimension = merge_changes(dimension, keyed.where(mine if hi is None else mine & (micros <= hi)), keys, old, new, at, batch, target)
        if hi is not None:  # the dimension is a table between two updates
            dimension = staged(dimension, "p7-dimension")
            discard(before)
    return dimension.select(*keys, "value", "valid_from_us", "valid_to_us")


def changes_of_snapshots(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], at: Column, batch: Column) -> DataFrame:
    """Rows for `versions` from two periodic snapshots: `(*keys, field, old_value, new_value, changed_at, batch_id)`.

    Records are compared by one hash over their fields first, so only changed, new and vanished ones are opened. A key
    must be unique in a snapshot.
    """
    packed = lambda df: df.select(*keys, F.xxhash64(*fields).alias("h"), F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields)).alias("fv"))
    both = packed(before).select(*keys, F.col("h").alias("h0"), F.col("fv").alias("fv0")).join(packed(after), keys, "full_outer")
    opened = both.where(~F.col("h0").eqNullSafe(F.col("h")))
    old = lambda i: F.col("fv0")[i]["v"]
    rows = F.array(*(F.struct(F.lit(f).alias("field"), old(i).alias("old_value"), F.col("fv")[i]["v"].alias("new_value")) for i, f in enumerate(fields)))
    flat = opened.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")
    return flat.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("*", at.alias("changed_at"), batch.alias("batch_id"))


def merge_snapshot(dimension: DataFrame, snapshot: DataFrame, keys: list[str], fields: list[str], at_us: int) -> DataFrame:
    """A type-two dimension `(*keys, *fields, valid_from_us, valid_to_us)` brought up to a full snapshot taken at `at_us`.

    Open versions whose fields differ from the snapshot (by hash) or whose key vanished are closed at `at_us`; changed
    and new keys get an open version. Closed versions pass through without being joined.
    """
    closed, still = dimension.where("valid_to_us <> -1"), dimension.where("valid_to_us = -1")
    cur = still.select("*", F.xxhash64(*fields).alias("_h"))
    new = snapshot.select(*keys, *(F.col(f).alias(f"_n_{f}") for f in fields), F.xxhash64(*fields).alias("_hn"), F.lit(True).alias("_there"))
    both = cur.join(new, keys, "full_outer")
    same = F.col("_h").eqNullSafe(F.col("_hn")) & F.col("_there").isNotNull() & F.col("valid_from_us").isNotNull()
    old = both.where(F.col("valid_from_us").isNotNull()).select(*keys, *fields, "valid_from_us", F.when(same, F.lit(-1)).otherwise(F.lit(at_us)).cast("long").alias("valid_to_us"))
    begun = both.where(F.col("_there") & ~same).select(*keys, *(F.col(f"_n_{f}").alias(f) for f in fields), F.lit(at_us).cast("long").alias("valid_from_us"), F.lit(-1).cast("long").alias("valid_to_us"))
    return closed.select(old.columns).unionByName(old).unionByName(begun)
