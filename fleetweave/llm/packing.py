"""p9: items of varying length in containers of fixed capacity, by best-two-fit.

Sizes are whole numbers up to the capacity, so the packing is worked out on the histogram of sizes, which has at most
`capacity` entries however many items there are: one container pattern at a time, taken as often as the histogram
still has its sizes. Items then find their container by their rank within their size, so nothing but that histogram
reaches the driver and no size, however frequent, is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetweave.session import staged

#: Items of one (size, salt) group that are ranked together.
GROUP_ROWS = 100_000


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """`(sizes of a container, number of such containers)` until the histogram is used up.

    Filled greedily, largest that fits first. Then the smallest size in the container is given back if two sizes that
    are still unpacked fill the gap it leaves more tightly (best-two-fit). Every pattern but those of the last items
    leaves some size with fewer items than it needs, so there are O(capacity log capacity) of them.
    """
    left = [0] * (capacity + 1)
    for s, n in histogram.items():
        if not 0 < s <= capacity:
            raise ValueError(f"size {s} is not within 1..{capacity}")
        left[s] += n
    there = sum(1 << s for s, n in enumerate(left) if n)  # bit s: some item of size s is unpacked

    def largest(s: int) -> int:
        """Largest unpacked size up to `s`, 0 without any."""
        return max(0, (there & ((1 << (s + 1)) - 1)).bit_length() - 1)

    def take(s: int, k: int) -> None:
        nonlocal there
        left[s] -= k
        there = there | 1 << s if left[s] else there & ~(1 << s)

    out = []
    while (s := largest(capacity)) > 0:
        box, gap = [], capacity
        while s > 0:
            k = min(left[s], gap // s)
            box += [s] * k
            take(s, k)
            gap -= s * k
            s = largest(min(gap, s - 1))
        if gap and len(box) > 1:
            room, best = gap + box[-1], (box[-1], 0, 0)
            a = largest(room - 1)
            while 2 * a > best[0]:
                b = a if 2 * a <= room and left[a] > 1 else largest(min(a - 1, room - a))
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = largest(a - 1)
            if best[1]:
                take(box.pop(), -1)
                for x in best[1:]:
                    take(x, 1)
                    box.append(x)
        need: dict[int, int] = {}
        for x in box:
            need[x] = need.get(x, 0) + 1
        more = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            take(x, k * more)
        out.append((box, 1 + more))
    return out


def pack(sizes: DataFrame, key: str, size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """`(key, piece_no, piece_start, piece_size, container_id)`: every item of `sizes` in containers.

    An item larger than `capacity` is cut into full pieces and a rest, numbered from 0; any other item is one piece.
    Items of size 0 or null take no room and are spread over the containers (container 0 if there are no others).
    Equal sizes are told apart by `key`, then by nothing: rows repeated in full are separate items. An empty table
    gives an empty table. `sizes` is read twice, so hand in a stored table.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    pieces = sizes.select(F.col(key), F.explode(F.when(n > capacity, F.sequence(F.lit(0), F.floor((n - 1) / capacity))).otherwise(F.array(F.lit(0).cast("long")))).alias("piece_no"), n.alias("n")).select(
        key, "piece_no", (F.col("piece_no") * capacity).alias("piece_start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece_no") * capacity).alias("piece_size")
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("piece_size").count().collect()}  # at most capacity + 1 rows
    total = sum(counts.values())
    salts = max(1, total // GROUP_ROWS)
    slots, base = [], 0
    taken: dict[int, int] = {}
    for box, times in patterns({s: c for s, c in counts.items() if s > 0}, capacity):
        need: dict[int, int] = {}
        for x in box:
            need[x] = need.get(x, 0) + 1
        for x, k in need.items():
            lo = taken.get(x, 0)
            taken[x] = lo + k * times
            slots.append((x, lo, lo + k * times, k, base))
        base += times
    slot = spark.createDataFrame(slots, "piece_size long, lo long, hi long, per long, base long") if slots else spark.createDataFrame([], "piece_size long, lo long, hi long, per long, base long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col(key), F.col("piece_no")), F.lit(salts)))
    filled = salted.where("piece_size > 0")
    groups = filled.groupBy("piece_size", "salt").count()
    before = F.sum("count").over(Window.partitionBy("piece_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("piece_size", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("piece_size", "salt").orderBy(key, "piece_no")) - 1
    ranked = filled.withColumn("at", place.cast("long")).join(offsets, ["piece_size", "salt"]).withColumn("at", F.col("at") + F.col("offset"))
    # the slots number O(capacity log capacity), whatever the input
    found = ranked.join(F.broadcast(slot), "piece_size").where("at >= lo and at < hi").select(
        key, "piece_no", "piece_start", "piece_size", (F.col("base") + F.floor((F.col("at") - F.col("lo")) / F.col("per"))).cast("long").alias("container_id")
    )
    empty = salted.where("piece_size <= 0").select(key, "piece_no", "piece_start", F.lit(0).cast("long").alias("piece_size"), F.pmod(F.xxhash64(F.col(key)), F.lit(max(1, base))).alias("container_id"))
    return found.unionByName(empty)


def pack_texts(df: DataFrame, key: str, text: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """`pack` for texts, sized in tokens; texts are encoded once and their sizes stored."""
    from fleetweave.llm.tokens import count_column

    return pack(staged(count_column(df, key, text, path), "p9-sizes"), key, "n_tokens", capacity)
