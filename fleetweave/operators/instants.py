"""p6: one unambiguous instant for times in mixed notations, precisions and zones.

Texts are read by `functions.timetext` in Arrow batches (as Column expressions the dozen patterns outgrow what one
generated method may hold). Those that say nothing about their zone are in their source's zone, which `estimate_zones`
finds by aligning local times with the times of ingestion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table of sources is read by the driver; it has one row per source and doesn't grow with the data.
MOST_SOURCES = 100_000


def estimate_zones(times: DataFrame, zones: DataFrame, source: str, text: str, ingested: str, declared: str, order: str, slack_s: int = 90, fresh_s: int = 1800) -> dict[str, tuple[str, str]]:
    """`{source: (zone, date order)}` for each row of `zones`: the zone its times without one are in.

    Candidates are the zones that any source declares. Under a candidate, a time later than its ingestion (by more than
    `slack_s`) or staler than `fresh_s` is a violation; as each is a whole history of offsets, one that misses a
    clock change violates for half of the year. The candidate with the fewest violations is taken if it has fewer
    than half of the declared zone's, else the declared one, so a source without evidence keeps what it declares and
    one that declares none is read by its evidence or as UTC. Batches are counted where they are read; what is
    shuffled has a row per task, source and zone.
    """
    rows = zones.select(source, declared, order).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("the table of sources has too many rows")
    said = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None}
    names = sorted({z for z, _ in said.values() if z})
    orders = {s: o == "mdy" for s, (_, o) in said.items()}

    def count(batches):
        import pyarrow as pa

        from fleetweave.functions.timetext import Zone, read

        clocks = [Zone(n) for n in names]
        bad: dict[str, list[int]] = {}
        for b in batches:
            for s, t, seen in zip(*(c.to_pylist() for c in b.columns)):
                x = read(t, orders.get(s, False))
                if x is None or x[0] is not None or x[3] is not None:
                    continue
                mine = bad.setdefault(s, [0] * len(clocks))
                for i, z in enumerate(clocks):
                    lag = seen - z.utc(x[1])
                    if lag < -slack_s or lag > fresh_s:
                        mine[i] += 1
        flat = [(s, n, k) for s, ks in bad.items() for n, k in zip(names, ks)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["s", "zone", "bad"])

    seen = F.unix_seconds(F.col(ingested).cast("timestamp")).alias("seen")
    there = times.where(F.col(text).isNotNull() & F.col(ingested).isNotNull() & F.col(source).isNotNull()).select(source, text, seen)
    found: dict[str, dict[str, int]] = {}
    if names:
        for s, n, k in there.mapInArrow(count, "s string, zone string, bad long").groupBy("s", "zone").agg(F.sum("bad")).collect():  # sources x zones
            found.setdefault(s, {})[n] = k
    out = {}
    for s, (z, o) in said.items():
        bad = found.get(s, {})
        best = min(sorted(bad), key=bad.get, default=None)
        out[s] = (best if best and (not z or bad[best] * 2 < bad.get(z, 0)) else z or "UTC", o)
    return out


def instants(times: DataFrame, key: Column, source: str, text: str, zones: dict[str, tuple[str, str]]) -> DataFrame:
    """`(rec_key, epoch_us)`: the instant of each text, microseconds since 1970 UTC.

    Texts that name no time (null, empty, "never", a counter of 0 or the largest number, broken dates) give no row, nor
    do texts with a zone name that isn't known. Sources that `zones` lacks (null too) are read as UTC, day first. Repeated rows come
    out once; rows of one key with different times each come out.
    """

    def run(batches):
        import pyarrow as pa

        from fleetweave.functions.timetext import Zone, read

        clocks = {n: Zone(n) for n in {z for z, _ in zones.values()} | {"UTC"}}
        by = {s: (clocks[z].utc, o == "mdy") for s, (z, o) in zones.items()}
        plain = (clocks["UTC"].utc, False)
        for b in batches:
            at, out = [], []
            for i, (s, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                utc, first = by.get(s, plain)
                x = read(t, first)
                if x is None:
                    continue
                n, local, micro, offset = x
                if n is None:
                    n = (utc(local) if offset is None else local - offset * 60) * 1_000_000 + micro
                if -(2**63) <= n < 2**63:
                    at.append(i)
                    out.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(out, pa.int64())], names=["rec_key", "epoch_us"])

    rows = times.where(F.col(text).isNotNull()).select(key.cast("string").alias("rec_key"), source, text)
    return rows.mapInArrow(run, "rec_key string, epoch_us long").distinct()


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
