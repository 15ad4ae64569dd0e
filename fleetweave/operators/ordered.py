"""Work in order within a key, for keys of any size.

A window over a key runs in one task, so a key that holds a large share of all rows has to be cut. `chunked` cuts keys
of more than `target` rows at approximate quantiles of the order column and gives every chunk the `halo` rows next to
it on either side as guests. A window whose frame is at most `halo` rows then has the same result on the chunks as on
the whole key. Keys within `target` stay as they are; without a larger key the input comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000
MOST_CHUNKS = 1_000
PARTITION_ROWS = 1_000_000


class Chunks:
    """`df` with the columns to partition by (`by`); `own` is true for rows that aren't guests. `rows` is how many there are, 0 if not known."""

    def __init__(self, df: DataFrame, by: list[str], cut: bool, rows: int = 0):
        self.df, self.by, self.cut, self.rows = df, by, cut, rows

    def spread(self) -> DataFrame:
        """`df` exchanged by its keys, into more partitions than the session's where these would hold over `PARTITION_ROWS` rows."""
        n = -(-self.rows // PARTITION_ROWS)
        return self.df.repartition(n, *self.by) if n > int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else self.df.repartition(*self.by)

    def only_own(self, df: DataFrame) -> DataFrame:
        return df.where("_own").drop("_own", "_chunk") if self.cut else df


def chunked(df: DataFrame, keys: list[str], position: str, ties: list[str], halo: int, target: int = TARGET_ROWS, sizes_of: DataFrame | None = None) -> Chunks:
    """`position` is a whole number that leads the order, `ties` are the columns after it.

    `sizes_of` may name a cheaper table with the same keys and at least as many rows of each, to find large keys in.
    """
    every = (df if sizes_of is None else sizes_of).groupBy(*keys).count()
    most = every.agg(F.max("count"), F.count_if(F.col("count") > target), F.coalesce(F.sum("count"), F.lit(0))).first()
    sizes = every.where(F.col("count") > target)
    if not most[1]:
        return Chunks(df, keys, False, most[2])
    parts = min(MOST_CHUNKS, -(-int(most[0]) // target))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    hot_keys = sizes.select(*keys)
    if most[1] <= 10_000:  # the size is known here
        hot_keys = F.broadcast(hot_keys)
    hot = df.alias("l").join(hot_keys.alias("r"), on, "left_semi")
    cold = df.alias("l").join(hot_keys.alias("r"), on, "left_anti")
    marks = [(i + 1) / parts for i in range(parts - 1)]
    bounds = hot.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(position, F.array(*map(F.lit, marks)), 20 * parts)).alias("_bounds"))
    if most[1] * parts <= 100_000:
        bounds = F.broadcast(bounds)
    raw = F.size(F.filter("_bounds", lambda b: b < F.col(position)))
    placed = hot.alias("l").join(bounds.alias("r"), on).select("l.*", raw.alias("_raw"))
    # chunks with fewer rows than the halo join the one before; numbers become dense
    counts = placed.groupBy(*keys, "_raw").count()
    ordered = Window.partitionBy(*keys).orderBy("_raw").rowsBetween(Window.unboundedPreceding, 0)
    dense = counts.select(*keys, "_raw", F.sum(F.when(F.col("count") >= max(halo, 1), 1).otherwise(0)).over(ordered).alias("_chunk"))
    on_raw = [*on, F.col("l._raw") == F.col("r._raw")]
    own = placed.alias("l").join(dense.alias("r"), on_raw).select(*(F.col(f"l.{c}") for c in df.columns), F.greatest(F.col("r._chunk"), F.lit(1)).alias("_chunk"), F.lit(True).alias("_own"))
    by = [*keys, "_chunk"]
    up = Window.partitionBy(*by).orderBy(position, *ties)
    down = Window.partitionBy(*by).orderBy(F.desc(position), *(F.desc(c) for c in ties))
    heads = own.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= halo).drop("_n")
    tails = own.withColumn("_n", F.row_number().over(down)).where(F.col("_n") <= halo).drop("_n")
    guests = heads.withColumn("_chunk", F.col("_chunk") - 1).unionByName(tails.withColumn("_chunk", F.col("_chunk") + 1))
    guests = guests.withColumn("_own", F.lit(False))
    rest = cold.select("*", F.lit(0).alias("_chunk"), F.lit(True).alias("_own"))
    return Chunks(rest.unionByName(own).unionByName(guests), by, True, most[2])


def neighbour(chunks: Chunks, order: list[Column], value: Column, offset: int) -> Column:
    """The value `offset` rows before (positive) or after (negative) within the key; the halo must reach that far."""
    w = Window.partitionBy(*chunks.by).orderBy(*order)
    return F.lag(value, offset).over(w) if offset > 0 else F.lead(value, -offset).over(w)
