"""The device mart: consolidation, sources of truth, quality reports and look-ups over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetweave.functions import text

#: Primary and secondary system of each field (fixed values of the default profile).
TRUTH = {
    "name": ("sp", ""), "serial_number": ("me", "sp"), "mac_address": ("fg", "me"), "ip_address": ("zbx", "fg"), "manufacturer": ("me", "sp"),
    "model": ("me", "sp"), "os": ("me", "sp"), "os_family": ("me", "sp"), "os_version": ("me", "sdp"), "assigned_user": ("sp", "me"), "imei": ("sdp", "me"), "asset_tag": ("sp", "sdp"),
}
DEVICE_FIELDS = ("serial_number", "mac_address", "manufacturer", "model", "os", "os_version", "asset_tag", "assigned_user", "ip_address", "imei")
#: Sources that belong to a system (fixed values).
SYSTEM_SOURCES = {"me": ("me_ec", "me_mdm"), "fg": ("fg", "fg_dhcp"), "sp": ("sp",), "zbx": ("zbx",), "ad": ("ad",), "sdp": ("sdp",)}
FULL_TEXT = ("name", "serial_number", "mac_address", "ip_address", "manufacturer", "model", "os", "assigned_user", "asset_tag")


def full(c: str) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _of(system: str, expand: bool) -> Column:
    return F.col("source").isin(*(SYSTEM_SOURCES.get(system, (system,)) if expand else (system,)))


def consolidated(records: DataFrame, expand: bool = False) -> DataFrame:
    """One row per cluster. Each field: largest value of its primary source, else of its secondary, else the smallest of any, else `''`.

    One hash aggregate with map-side combine (the set of sources in it keeps strings out of a sort aggregate). `expand`
    lets a system stand for all its sources; without it names are compared as they are. Null clusters are one cluster.
    """

    def pick(f: str) -> Column:
        primary, secondary = TRUTH.get(f, ("", ""))
        tries = [F.max(F.when(_of(s, expand) & full(f), F.col(f))) for s in (primary, secondary) if s]
        return F.coalesce(*tries, F.min(F.when(full(f), F.col(f))), F.lit("")).alias(f)

    name = F.coalesce(F.min(F.when(full("name_clean"), F.col("name_clean"))), F.min(F.when(full("name"), F.col("name"))), F.lit("(unnamed)"))
    sources = F.sort_array(F.collect_set("source"))
    return records.groupBy("cluster_id").agg(
        name.alias("device_name"), F.size(sources).cast("long").alias("source_count"), sources.alias("sources"), *(pick(f) for f in DEVICE_FIELDS), F.count(F.lit(1)).alias("record_count")
    )


def long_form(records: DataFrame, fields) -> DataFrame:
    """`(cluster_id, source, source_id, ord, field, value)` of the values that aren't blank, from one scan."""
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f).alias("value")) for i, f in enumerate(fields)))
    return records.select("cluster_id", "source", "source_id", F.explode(F.filter(each, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("x")).select("cluster_id", "source", "source_id", "x.*")


def source_values(records: DataFrame, fields) -> DataFrame:
    """One value per cluster, source and field: of the last record by id."""
    return long_form(records, fields).groupBy("cluster_id", "source", "field", "ord").agg(F.max_by("value", F.struct("source_id", "value")).alias("value"))


def truth(records: DataFrame, systems: DataFrame, expand: bool = False) -> DataFrame:
    """`(cluster_id, field, value, source, priority)`: primary, else secondary, else the source that covers most."""
    coverage = F.broadcast(systems.select("source", "coverage"))  # one row per source
    values = source_values(records, list(TRUTH)).join(coverage, "source", "left")
    rank = F.lit(2)
    for f, (primary, secondary) in TRUTH.items():
        here = F.col("field") == f
        if secondary:
            rank = F.when(here & _of(secondary, expand), 1).otherwise(rank)
        rank = F.when(here & _of(primary, expand), 0).otherwise(rank)
    keyed = values.withColumn("rank", rank).withColumn("cover", -F.coalesce("coverage", F.lit(0.0)))
    best = keyed.groupBy("cluster_id", "field").agg(F.min_by(F.struct("value", "source", "rank"), F.struct("rank", "cover", "source")).alias("b"))
    label = F.element_at(F.array(F.lit("primary"), F.lit("secondary"), F.lit("best_effort")), F.col("b.rank") + 1)
    return best.select("cluster_id", "field", "b.value", "b.source", label.alias("priority"))


def drift(records: DataFrame) -> DataFrame:
    """`(cluster_id, field, verdict)`: do sources agree, without case?"""
    seen = source_values(records, list(TRUTH)).groupBy("cluster_id", "field").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.lower("value")).alias("values"))
    verdict = F.when(F.col("sources") < 2, "SINGLE_SOURCE").when(F.col("values") == 1, "MATCH").otherwise("MISMATCH")
    return seen.select("cluster_id", "field", verdict.alias("verdict"))


def all_values(records: DataFrame, devices: DataFrame) -> DataFrame:
    """`(cluster_id, field, values)`: the mart's value first, then the other values in order of source."""
    golden = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("golden")) for f in DEVICE_FIELDS))).alias("x")
    top = devices.select("cluster_id", golden).select("cluster_id", "x.*").where("golden <> ''")
    rest = source_values(records, DEVICE_FIELDS).groupBy("cluster_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "value"))), lambda x: x["value"]).alias("rest"))  # one per source
    both = top.join(rest, ["cluster_id", "field"], "full_outer")
    head = F.when(F.col("golden").isNotNull(), F.array("golden")).otherwise(F.array().cast("array<string>"))
    return both.select("cluster_id", "field", F.array_join(F.array_distinct(F.concat(head, F.coalesce("rest", F.array().cast("array<string>")))), " | ").alias("values"))


def serial_conflicts(records: DataFrame) -> DataFrame:
    """Annotations: clusters with several serial numbers, and serial numbers in several clusters."""
    serial = text.normalize_serial(F.col("serial_number"))
    pairs = records.where("cluster_id <> ''").select("cluster_id", serial.alias("serial")).where("serial <> ''").distinct()
    within = pairs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("serial")).alias("all")).where("n > 1")
    across = pairs.groupBy("serial").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a = within.select("cluster_id", F.lit("SERIAL_CONFLICT").alias("kind"), F.array_join("all", ", ").alias("values"), "n")
    return a.unionByName(across.select(F.lit("(multiple)").alias("cluster_id"), F.lit("SPLIT_IDENTITY").alias("kind"), F.col("serial").alias("values"), "n"))


def extra_pairs(records: DataFrame) -> DataFrame:
    """`(cluster_id, source, source_id, key, value)` of the flat JSON in extra_attributes; whole texts only."""
    ok = F.try_parse_json("extra_attributes").isNotNull()
    rows = records.where(full("extra_attributes")).where(ok)
    return rows.select("cluster_id", "source", "source_id", F.explode(F.from_json("extra_attributes", "map<string,string>")).alias("key", "value"))


def concepts(records: DataFrame, registry: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """`(cluster_id, concept, value)`: of each concept the largest value of the first registered (source, key) that has one."""
    spark = records.sparkSession
    rows = [(c, i, s, k) for c, pairs in registry for i, (s, k) in enumerate(pairs)]
    reg = F.broadcast(spark.createDataFrame(rows, "concept string, ord int, source string, key string"))  # the registry has a fixed size
    hits = extra_pairs(records).where("value <> ''").join(reg, ["source", "key"])
    per = hits.groupBy("cluster_id", "concept", "ord").agg(F.max("value").alias("value"))
    return per.groupBy("cluster_id", "concept").agg(F.min_by("value", "ord").alias("value"))


def stale(records: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Clusters whose newest record was fetched more than `days` before `as_of`."""
    last = records.groupBy("cluster_id").agg(F.max("fetched_at").alias("last_seen"))
    return last.where(F.col("last_seen") < as_of - F.make_dt_interval(F.lit(days)))


def lookup(queries: DataFrame, devices: DataFrame, records: DataFrame) -> DataFrame:
    """`(query, cluster_id, step)`: the device each query names, by the first of seven steps that hits.

    Id, name, serial and address are equi-joins for all queries at once. Only queries that hit nothing there are
    compared by containment (address, user, all texts), a stated query set against all rows. Ties: most sources, then
    the smallest id. Queries compare in lower case, the id as it is stored.
    """
    q = queries.select(F.col("query"), F.lower(F.trim("query")).alias("low"), F.regexp_replace(F.lower("query"), "[^0-9a-f]", "").alias("hex")).distinct()
    dev = devices.select("cluster_id", "source_count", F.lower("device_name").alias("n"), F.lower("serial_number").alias("s"), F.regexp_replace(F.lower("mac_address"), "[^0-9a-f]", "").alias("m"), F.lower("ip_address").alias("i"), F.lower("assigned_user").alias("u"))
    hits = [
        q.join(dev, F.col("low") == F.col("cluster_id")).select("query", "cluster_id", "source_count", F.lit(1).alias("step")),
        q.join(dev, F.col("low") == F.col("n")).select("query", "cluster_id", "source_count", F.lit(2).alias("step")),
        q.join(dev, F.col("low") == F.col("s")).select("query", "cluster_id", "source_count", F.lit(3).alias("step")),
        q.where("length(hex) = 12").join(dev, F.col("hex") == F.col("m")).select("query", "cluster_id", "source_count", F.lit(4).alias("step")),
        q.where("length(hex) = 12").join(records.select("cluster_id", "mac_clean"), F.col("hex") == F.col("mac_clean")).join(devices.select("cluster_id", "source_count"), "cluster_id").select("query", "cluster_id", "source_count", F.lit(4).alias("step")),
    ]

    def first(found: DataFrame) -> DataFrame:
        best = F.min_by(F.struct("cluster_id", "step"), F.struct("step", -F.col("source_count"), "cluster_id"))
        return found.groupBy("query").agg(best.alias("b")).select("query", "b.cluster_id", "b.step")

    sure = first(reduce(DataFrame.unionByName, hits))
    left = q.join(sure, "query", "left_anti").where("low <> ''")
    ip = left.join(dev, F.col("i").contains(F.col("low"))).select("query", "cluster_id", "source_count", F.lit(5).alias("step"))
    user = left.join(dev, F.col("u").contains(F.col("low"))).select("query", "cluster_id", "source_count", F.lit(6).alias("step"))
    whole = F.lower(F.concat_ws("\x01", *(F.coalesce(c, F.lit("")) for c in FULL_TEXT)))
    texts = records.select("cluster_id", whole.alias("t")).join(devices.select("cluster_id", "source_count"), "cluster_id")
    any_text = left.join(texts, F.col("t").contains(F.col("low"))).select("query", "cluster_id", "source_count", F.lit(7).alias("step"))
    return sure.unionByName(first(ip.unionByName(user).unionByName(any_text)))


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
