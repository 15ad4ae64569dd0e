"""Scan of the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetweave.session import shipped


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """`<base>/<name>.parquet`, a file or a folder of files; the executors have this package from here on."""
    return shipped(spark).read.parquet(f"{base}/{name}.parquet")


def present(spark: SparkSession, base: str, names) -> dict[str, DataFrame]:
    """Those of the named tables that are there; one that isn't is left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(n: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/{n}.parquet")
        return p.getFileSystem(conf).exists(p)

    return {n: table(spark, base, n) for n in names if there(n)}


def utc_micros(col) -> "F.Column":
    """Microseconds since 1970 of a timestamp column, with or without zone (read as UTC)."""
    return F.unix_micros(F.col(col).cast(T.TimestampType()) if isinstance(col, str) else col.cast(T.TimestampType()))
