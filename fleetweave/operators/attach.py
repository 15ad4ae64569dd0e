"""Attachment of non-device records to clusters by exact, normalised and fuzzy keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions import text

#: Words that never name a device (fixed values).
REJECT_WORDS = ("iphone", "ipad", "ipod", "laptop", "desktop", "printer", "server", "workstation", "router", "switch", "plotter", "toughbook", "macbook", "monitor", "scanner", "camera", "phone", "tablet", "console")
KEY_COLUMNS = ("source_id", "name_clean", "mac_clean", "serial_number", "asset_tag", "assigned_user")


def keyspace(records: DataFrame, columns=KEY_COLUMNS, scope: list[str] | None = None, unique_only: bool = False) -> DataFrame:
    """`(token, cluster_id)`: every key value in lower case with the smallest cluster that has it (or only tokens of one cluster)."""
    rows = records.where("cluster_id <> ''")
    if scope:
        rows = rows.where(F.col("source").isin(*scope))
    flat = rows.select("cluster_id", F.explode(F.array(*(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in columns))).alias("token")).where("token <> ''")
    out = flat.groupBy("token").agg(F.min("cluster_id").alias("cluster_id"), F.max("cluster_id").alias("_other"))
    return (out.where("cluster_id = _other") if unique_only else out).drop("_other")


def reject_words(records: DataFrame) -> DataFrame:
    """Words that are kinds, makers or systems."""
    spark = records.sparkSession
    fixed = spark.createDataFrame([(w,) for w in REJECT_WORDS], "token string")
    seen = records.select(F.explode(F.array(F.lower("manufacturer"), F.lower("os"))).alias("token")).where("token <> ''")
    return fixed.unionByName(seen).distinct()


def exact(rows: DataFrame, keys: DataFrame, value: Column, transform=None) -> DataFrame:
    """`rows` with `cluster_id` and confidence 1.0 where the value, transformed if asked, is a key."""
    v = transform(value) if transform else value
    hit = rows.withColumn("value", value).withColumn("token", F.lower(F.trim(v))).where("token <> ''").join(keys, "token")
    return hit.drop("token").withColumn("confidence", F.lit(1.0))


def fuzzy(rows: DataFrame, id_column: str, keys: DataFrame, rejected: DataFrame, value: Column, multi: bool, dotted: bool = False) -> DataFrame:
    """`(id, cluster_id, token, confidence)`: clusters named by the words of a text.

    With `multi` every cluster that a word names, else the one of the longest word (the first of equal ones). 0.9 for a
    word, 0.7 for what is left of a dotted one (only with `dotted`, which keeps dots in words).
    """
    words = rows.select(id_column, F.posexplode(text.tokens(value, dotted)).alias("pos", "word"))
    words = words.select(id_column, "pos", F.substring_index("word", ".", 1).alias("token"), F.when(F.col("word").contains("."), 0.7).otherwise(0.9).alias("confidence"))
    found = words.join(rejected, "token", "left_anti").join(keys, "token")
    if multi:
        return found.groupBy(id_column, "cluster_id").agg(F.min_by("token", F.struct("pos", "token")).alias("token"), F.max("confidence").alias("confidence"))
    best = F.max_by(F.struct("cluster_id", "token", "confidence"), F.struct(F.length("token"), -F.col("pos")))
    return found.groupBy(id_column).agg(best.alias("b")).select(id_column, "b.cluster_id", "b.token", "b.confidence")


def attachments(feed_key: str, links: list[DataFrame], payload: str, linked_at: Column) -> DataFrame:
    """Attachment rows of a feed from the results of its links; `value` up to 500 characters."""
    each = [x.select("cluster_id", F.lit(feed_key).alias("feed_key"), "source_id", "field", F.substring("value", 1, 500).alias("value"), F.col("confidence").cast("float").alias("confidence"), F.col(payload).alias("payload"), linked_at.alias("linked_at")) for x in links]
    return reduce(DataFrame.unionByName, each)


def replace_feed(old: DataFrame, new: DataFrame, feed_key: str) -> DataFrame:
    """All attachments of a feed replaced, those of other feeds kept."""
    return old.where(F.col("feed_key") != feed_key).unionByName(new)
