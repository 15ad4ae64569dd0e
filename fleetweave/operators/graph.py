"""Networks and neighbours: addresses in ranges, and the graph around devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.functions import net


def in_networks(points: DataFrame, address: str, networks: DataFrame, cidr: str) -> DataFrame:
    """`points` joined with the IPv4 `networks` (CIDR text) that contain their address.

    A network is spelled out as the /16 (or its own prefix, if longer: /24) blocks it covers, and joined on the block, so the join is
    an equi-join with a check of the bounds instead of a nested loop. Networks wider than /8 are cut to whole blocks all the same.
    """
    first, last, n = net.cidr_bounds(F.col(cidr))
    nets = networks.withColumn("_lo", first).withColumn("_hi", last).withColumn("_n", n).where("_lo is not null")
    shift = F.when(F.col("_n") >= 24, 8).otherwise(16)
    div = lambda c, s: F.call_function("div", c, F.pow(F.lit(2.0), s).cast("long"))
    nets = nets.withColumn("_s", shift).withColumn("_b", F.explode(F.sequence(div(F.col("_lo"), F.col("_s")), div(F.col("_hi"), F.col("_s")))))
    p = points.withColumn("_ip", net.ipv4_number(F.col(address))).where("_ip is not null").withColumn("_s", F.explode(F.array(F.lit(8), F.lit(16))))
    p = p.withColumn("_b", div(F.col("_ip"), F.col("_s")))
    return p.join(nets, ["_s", "_b"]).where("_ip between _lo and _hi").drop("_ip", "_lo", "_hi", "_n", "_s", "_b")


def in_ranges(points: DataFrame, address: str, ranges: DataFrame, first: str, last: str) -> DataFrame:
    """`points` joined with the `ranges` (two addresses of one version, both included) that hold their address, IPv4 or IPv6.

    All addresses of a range begin with the digits its ends have in common, so points meet ranges on those digits: an
    equi-join with a check of the bounds. There are at most 33 lengths of common digits, whatever the number of ranges.
    """
    lo, hi = F.hex(net.address_bytes(F.col(first))), F.hex(net.address_bytes(F.col(last)))
    r = ranges.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo is not null and _hi is not null and _lo <= _hi")
    four = lambda c: F.substring(c, 1, 24) == "0" * 20 + "FFFF"
    r = r.where(four("_lo") == four("_hi"))
    n = F.reduce(F.sequence(F.lit(1), F.lit(32)), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(F.col("_lo"), i, F.lit(1)) == F.substring(F.col("_hi"), i, F.lit(1))), i).otherwise(k))
    r = r.withColumn("_n", n).withColumn("_k", F.substring(F.col("_lo"), F.lit(1), F.col("_n")))
    lengths = [x[0] for x in r.select("_n").distinct().collect()]
    p = points.withColumn("_ip", F.hex(net.address_bytes(F.col(address)))).where("_ip is not null")
    p = p.withColumn("_n", F.explode(F.array(*(F.lit(k) for k in lengths)) if lengths else F.array().cast("array<int>"))).withColumn("_k", F.substring(F.col("_ip"), F.lit(1), F.col("_n")))
    return p.join(r, ["_n", "_k"]).where("_ip between _lo and _hi").drop("_n", "_k", "_ip", "_lo", "_hi")


def shared_users(devices: DataFrame, most: int = 50) -> DataFrame:
    """Edges `(source, target, type, label)` between clusters of one user, `source < target`.

    Users of more than `most` devices are groups or placeholders, whose pairs say nothing; they are linked to their
    user's node only (`assigned_to`), which keeps every link without forming the pairs of a group.
    """
    d = devices.where("assigned_user <> ''").select("cluster_id", F.lower("assigned_user").alias("user"))
    small = d.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most)).select("user")
    few = d.join(small, "user")
    pairs = few.select("user", F.col("cluster_id").alias("source")).join(few.select("user", F.col("cluster_id").alias("target")), "user").where("source < target")
    star = d.select(F.col("cluster_id").alias("source"), F.concat(F.lit("user:"), F.col("user")).alias("target"), F.lit("assigned_to").alias("type"), F.col("user").alias("label"))
    return star.unionByName(pairs.select("source", "target", F.lit("shared_user").alias("type"), F.col("user").alias("label")))


def nodes(devices: DataFrame) -> DataFrame:
    """`(id, type, label)` of devices and their users."""
    d = devices.select(F.col("cluster_id").alias("id"), F.lit("device").alias("type"), F.col("device_name").alias("label"))
    u = devices.where("assigned_user <> ''").select(F.lower("assigned_user").alias("label")).distinct()
    return d.unionByName(u.select(F.concat(F.lit("user:"), F.col("label")).alias("id"), F.lit("user").alias("type"), "label"))
