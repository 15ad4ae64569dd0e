"""Structured Streaming: incremental sync of raw stores, windowed and sessionised events, late and repeated rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from fleetweave.operators.capture import field_changes, last_wins, merged


def sync_store(stream: DataFrame, store_path: str, history_path: str, checkpoint: str, key: str = "source_id") -> StreamingQuery:
    """Merge a stream of `(key, raw_json, raw_hash, fetched_at)` into a stored table; changes of fields go to a history.

    Each batch writes a new version of the store beside the old one and then moves a pointer file, so a batch that is
    run again after a failure starts from the version before it and ends with the same result.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_wins(batch, [key], ["fetched_at", "raw_hash"])
        old_path = version(spark, store_path, before=number)
        if old_path is None:
            new.write.mode("overwrite").parquet(f"{store_path}/v{number}")
        else:
            old = spark.read.parquet(old_path)
            changed = new.join(old.select(key, F.col("raw_hash").alias("_h")), key).where("raw_hash <> _h").drop("_h")
            diff = field_changes(old, changed, key, "raw_json").withColumn("batch_id", F.lit(f"b-{number:07d}"))
            diff.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
            merged(old, new, key, "raw_hash").write.mode("overwrite").parquet(f"{store_path}/v{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """Path of the newest whole version of a store (older than `before`), None without any."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    found = []
    for s in fs.listStatus(base):
        n = s.getPath().getName()
        if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(n[1:]))
    found = [n for n in found if before is None or n < before]
    return f"{path}/v{max(found)}" if found else None


def delivered_once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream without rows delivered again within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, at: str, by: list[str], size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def silent(events: DataFrame, by: str, at: str, after_s: int) -> DataFrame:
    """`(by, gap_s)` for pauses of more than `after_s` between an entity's events; its last time is the state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b["s"]):
            if last is not None and t - last > after_s:
                out.append((k[0], t - last))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(out, columns=[by, "gap_s"])

    rows = events.select(by, F.unix_seconds(at).alias("s"))
    return rows.groupBy(by).applyInPandasWithState(run, f"{by} long, gap_s long", "last long", "append", "NoTimeout")


def drain(df: DataFrame, name: str, mode: str = "append", then: Callable | None = None) -> DataFrame:
    """Run a stream over what is there into a table in memory (for tests and look-sees) and return the table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    if then:
        then(q)
    return df.sparkSession.table(name)
