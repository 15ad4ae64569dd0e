"""What is known of each device, for all devices at once: story, state, search, attachments and trace.

Each part is a table by `cluster_id`; a single device is a filter on it, which reaches the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.functions import text
from fleetweave.operators import mart

#: Columns a search may name (fixed values); `name` is another word for device_name, anything else searches all texts.
SEARCHABLE = ("device_name", "serial_number", "mac_clean", "ip_address", "assigned_user", "manufacturer", "model", "os", "os_version", "asset_tag", "imei")
SEARCHED = ("device_name", "serial_number", "mac_address", "manufacturer", "model", "os", "os_version", "assigned_user", "ip_address", "asset_tag")


def story(records: DataFrame, devices: DataFrame, systems: DataFrame, registry: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """`(cluster_id, part, name, value)`: the mart's row, all values, sources of truth, agreement and concepts of each device."""
    row = devices.select("cluster_id", F.col("device_name"), F.size("sources").cast("string").alias("source_count"), F.array_join(F.sort_array("sources"), ",").alias("sources"), F.col("record_count").cast("string").alias("record_count"))
    known = devices.select("cluster_id")
    of = lambda df, part, name, value: df.join(known, "cluster_id", "left_semi").select("cluster_id", F.lit(part).alias("part"), name.alias("name"), value.alias("value"))
    parts = [
        row.unpivot(["cluster_id"], row.columns[1:], "name", "value").select("cluster_id", F.lit("device").alias("part"), "name", "value"),
        of(mart.all_values(records, devices), "values", F.col("field"), F.col("values")),
        of(mart.truth(records, systems), "truth", F.col("field"), F.concat_ws("@", "value", "source", "priority")),
        of(mart.drift(records), "agreement", F.col("field"), F.col("verdict")),
        of(mart.concepts(records, registry), "concept", F.col("concept"), F.col("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def state(metrics: DataFrame, events: DataFrame, hours: int = 168) -> DataFrame:
    """`(cluster_id, kind, name, value)`: the latest number of each metric, and events by severity in the `hours` up to the newest event."""
    latest = metrics.where("value is not null").groupBy("cluster_id", "metric_name").agg(F.max_by("value", F.struct("recorded_at", "metric_id")).alias("value"))
    newest = events.agg(F.max("ingested_at").alias("t")).scalar()
    severity = F.coalesce(F.nullif(F.lower(F.trim("severity")), F.lit("")), F.lit("info"))
    counts = events.where(F.col("ingested_at") >= newest - F.make_dt_interval(F.lit(0), F.lit(hours))).groupBy("cluster_id", severity.alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return latest.select("cluster_id", F.lit("metric").alias("kind"), F.col("metric_name").alias("name"), "value").unionByName(counts.select("cluster_id", F.lit("events").alias("kind"), "name", "value"))


def info(devices: DataFrame) -> DataFrame:
    """A device as lists show it: the sources as a text, and as many as the text names."""
    return devices.select("cluster_id", "device_name", F.size("sources").cast("long").alias("source_count"), F.array_join(F.sort_array("sources"), ", ").alias("sources"), *(text.safe_text(F.col(c)).alias(c) for c in ("serial_number", "mac_address", "manufacturer", "model", "os", "assigned_user", "ip_address")), "record_count")


def search(devices: DataFrame, q: str, field: str = "", limit: int | None = 20) -> DataFrame:
    """Devices whose `field` holds `q` (without case), or any of the searched fields if `field` isn't one of `SEARCHABLE`.

    A mac is compared as a whole, in its clean form. Most sources first, then by id. No `limit` gives all.
    """
    field = "device_name" if field == "name" else field
    low = F.lit(q.lower())
    if field == "mac_clean":
        hexa = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-f]", "")
        hit = hexa(F.col("mac_address")) == hexa(F.lit(q))
    elif field in SEARCHABLE:
        hit = F.lower(field).contains(low)
    else:
        hit = reduce(Column.__or__, [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in SEARCHED])
    found = devices.where(hit).orderBy(F.desc("source_count"), "cluster_id")
    return found if limit is None else found.limit(limit)


def page(devices: DataFrame, least_sources: int, offset: int, limit: int) -> DataFrame:
    """A page of devices with the number of all that fit, from the same filter."""
    fit = devices.where(F.col("source_count") >= least_sources)
    total = fit.agg(F.count(F.lit(1)).alias("n")).scalar()
    return fit.orderBy(F.desc("source_count"), "device_name", "cluster_id").offset(offset).limit(limit).select("cluster_id", "device_name", "source_count", "record_count", total.alias("total"))


def recent_changes(history: DataFrame, most: int = 100) -> DataFrame:
    """The latest changes of each device; groups are limited before they are exchanged."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("changed_at"), F.desc("batch_id"), "source", "source_id", "field", F.asc_nulls_last("old_value"), F.asc_nulls_last("new_value"))
    return history.where("cluster_id is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def shared_values(attachments: DataFrame, most: int = 50) -> DataFrame:
    """Edges `(source, target, type, label)` over attachments: devices to their values, and devices with a value in common.

    A value of more than `most` devices ties them over its own node only, which loses no link and forms no pairs of a crowd.
    """
    a = attachments.where("value <> ''").select("cluster_id", "feed_key", "value").distinct()
    star = a.select(F.col("cluster_id").alias("source"), F.concat(F.lit("value:"), F.sha2("value", 256)).alias("target"), F.concat(F.lit("attached_"), F.col("feed_key")).alias("type"), "feed_key")
    small = a.groupBy("feed_key", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most)).select("feed_key", "value")
    few = a.join(small, ["feed_key", "value"])
    pairs = few.select("feed_key", "value", F.col("cluster_id").alias("source")).join(few.select("feed_key", "value", F.col("cluster_id").alias("target")), ["feed_key", "value"]).where("source < target")
    pairs = pairs.select("source", "target", F.concat(F.lit("shared_"), F.col("feed_key")).alias("type"), "feed_key").distinct()
    return star.unionByName(pairs).select("source", "target", "type", F.col("feed_key").alias("label"))


def discovered(records: DataFrame) -> DataFrame:
    """`(concept, source, key)`: keys of extra attributes by the concept their name says."""
    keys = mart.extra_pairs(records).select("source", "key").distinct()
    return keys.select(text.concept_name(F.col("key")).alias("concept"), "source", "key")


def merged_registry(manual: DataFrame, auto: DataFrame) -> DataFrame:
    """`(concept, source, key, ord)`: the manual registry, and for each concept what was found for sources it doesn't name, after it.

    Both sides have a row per concept, source and key of the feeds, which doesn't grow with the records.
    """
    fresh = auto.join(manual.select("concept", "source").distinct(), ["concept", "source"], "left_anti")
    w = Window.partitionBy("concept").orderBy("source", "key")
    return manual.select("concept", "source", "key", "ord").unionByName(fresh.select("concept", "source", "key", (F.row_number().over(w) + 999).alias("ord")))


def concepts_of(records: DataFrame, registry: DataFrame) -> DataFrame:
    """`(cluster_id, concept, value)`: of each concept the largest value of the first registered (source, key) that has one."""
    hits = mart.extra_pairs(records).where("value <> ''").join(registry, ["source", "key"])
    per = hits.groupBy("cluster_id", "concept", "ord").agg(F.max("value").alias("value"))
    return per.groupBy("cluster_id", "concept").agg(F.min_by("value", "ord").alias("value"))


def item_metrics(items: DataFrame, hosts: DataFrame, records: DataFrame, source: str = "zbx") -> DataFrame:
    """`(cluster_id, source, metric_name, value, text_value, tags, recorded_at)` from the `raw_json` of items and of their hosts.

    An item belongs to the cluster of the record with its host's id, else to that of the record with its host's first name
    label. Items without a host in the mesh, a name or a whole clock, and broken texts, give nothing; a value that is no
    number is a text.
    """
    at = lambda n: F.coalesce(F.get_json_object("raw_json", f"$.{n}"), F.lit(""))
    h = hosts.select(at("hostid").alias("hostid"), F.substring_index(F.lower(F.coalesce(F.nullif(at("host"), F.lit("")), at("name"))), ".", 1).alias("host")).where("hostid <> ''").groupBy("hostid").agg(F.min("host").alias("host"))
    mine = records.where((F.lower("source") == source) & (F.col("cluster_id") != ""))
    by_id = mine.groupBy(F.col("source_id").alias("hostid")).agg(F.min("cluster_id").alias("by_id"))
    by_name = mine.where("name_clean <> ''").groupBy(F.lower("name_clean").alias("host")).agg(F.min("cluster_id").alias("by_name"))
    value, rest = text.number_or_text(F.col("v"))
    i = items.select(at("hostid").alias("hostid"), at("name").alias("metric_name"), F.nullif(at("lastvalue"), F.lit("")).alias("v"), at("lastclock").try_cast("long").alias("clock"), text.tag_list(key=at("key_"), value_type=at("value_type"), units=at("units")).alias("tags"))
    placed = i.where("hostid <> '' and metric_name <> '' and clock is not null").join(by_id, "hostid", "left").join(h, "hostid", "left").join(by_name, "host", "left")
    found = placed.withColumn("cluster_id", F.coalesce("by_id", "by_name")).where("cluster_id is not null")
    return found.select("cluster_id", F.lit(source).alias("source"), "metric_name", value.alias("value"), rest.alias("text_value"), "tags", F.timestamp_seconds("clock").alias("recorded_at"))


def vlans(raw: DataFrame) -> DataFrame:
    """`(vlan, network, first, last)` from the `raw_json` of a list of VLANs; rows without a network and both ends are left out."""
    at = lambda n: F.coalesce(F.get_json_object("raw_json", f"$.fields.{n}"), F.lit(""))
    return raw.select(at("VlanName").alias("vlan"), at("NetworkID").alias("network"), at("StartingIP").alias("first"), at("EndingIP").alias("last")).where("network <> '' and first <> '' and last <> ''")
