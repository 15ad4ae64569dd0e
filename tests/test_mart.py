"""A mesh of seven records and four devices, and what follows from it."""

import datetime as D

import pytest
from pyspark.sql import functions as F

from fleetweave.operators import attach, capture, graph, linking, mart

COLS = "cluster_id source source_id name name_clean serial_number mac_address mac_clean manufacturer model os os_version asset_tag assigned_user ip_address imei extra_attributes os_family fetched_at".split()
NOW = D.datetime(2025, 6, 1)


def rec(c, s, i, name="", serial="", mac="", maker="", os_="", user="", ip="", imei="", extra="", at=NOW):
    return (c, s, i, name, name.lower(), serial, mac, mac.replace(":", ""), maker, "", os_, "", "", user, ip, imei, extra, "", at)


@pytest.fixture(scope="module")
def mesh(spark):
    rows = [
        rec("c1", "sp", "sp_k7", "LAP31", "QX7781", "3c:52:a1:0e:9b:44", "Dell", "Windows 10", "tmarsh", "172.20.6.31", extra='{"fields.Cost": "12", "a": ""}'),
        rec("c1", "me", "me_q3", "LAP31", "QX7781", "3c:52:a1:0e:9b:44", "Dell", "Windows 11", "tmarsh"),
        rec("c1", "fg", "fg_z1", "lap31", os_="Windows 10", ip="172.20.6.31", extra="{broken"),
        rec("c2", "ad", "ad_t5", "SRV77", "QX7782", "f0:9e:4a:27:d1:08", os_="Server 2022", ip="10.0.0.1", at=D.datetime(2024, 1, 1)),
        rec("c2", "zbx", "zbx_h8", "srv77", "QX7789", ip="10.0.0.1", at=D.datetime(2024, 1, 1)),
        rec("c3", "sp", "sp_m2"),
        rec("c4", "me_mdm", "mdm_p9", "slate04", "QX7781", maker="Apple", os_="iOS 17", user="kvolt", imei="490154203237518"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'timestamp_ntz' if c == 'fetched_at' else 'string'}" for c in COLS))


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_devices(mesh):
    d = by(mart.consolidated(mesh), "cluster_id")
    assert len(d) == 4 and d["c1"].sources == ["fg", "me", "sp"] and d["c1"].source_count == 3 and d["c1"].record_count == 3
    assert d["c1"].os == "Windows 11" and d["c3"].device_name == "(unnamed)" and d["c2"].device_name == "srv77" and d["c2"].os == "Server 2022"
    assert d["c4"].serial_number == "QX7781" and d["c3"].serial_number == ""


def test_truth_and_drift(spark, mesh):
    systems = spark.createDataFrame([("sp", 0.55), ("me_mdm", 0.8), ("fg", 0.3), ("ad", 0.6), ("zbx", 0.4)], "source string, coverage double")
    t = by(mart.truth(mesh, systems), "cluster_id", "field")
    assert (t["c1", "os"].value, t["c1", "os"].priority) == ("Windows 11", "primary") and t["c1", "name"].source == "sp" and t["c2", "serial_number"].priority == "best_effort"
    assert t["c2", "serial_number"].value == "QX7782" and t["c4", "os"].priority == "best_effort"
    assert by(mart.truth(mesh, systems, expand=True), "cluster_id", "field")["c4", "os"].priority == "primary"
    v = by(mart.drift(mesh), "cluster_id", "field")
    assert (v["c1", "name"].verdict, v["c1", "os"].verdict, v["c4", "os"].verdict) == ("MATCH", "MISMATCH", "SINGLE_SOURCE")


def test_annotations(mesh):
    got = {(r.cluster_id, r.kind, r["values"]) for r in mart.serial_conflicts(mesh).collect()}
    assert got == {("c2", "SERIAL_CONFLICT", "QX7782, QX7789"), ("(multiple)", "SPLIT_IDENTITY", "QX7781")}


def test_extras(mesh):
    assert {(r.key, r.value) for r in mart.extra_pairs(mesh).collect()} == {("fields.Cost", "12"), ("a", "")}
    assert [tuple(r) for r in mart.concepts(mesh, [("cost", [("me", "fields.Cost"), ("sp", "fields.Cost")])]).collect()] == [("c1", "cost", "12")]


def test_stale(mesh):
    assert {r.cluster_id for r in mart.stale(mesh, F.lit(NOW), 90).collect()} == {"c2"}


def test_lookup(spark, mesh):
    d = mart.consolidated(mesh)
    q = spark.createDataFrame([(x,) for x in ("c2", "LAP31", "qx7782", "3C-52-A1-0E-9B-44", "f09e4a27d108", "172.20", "kvo", "apple", "nothing", "", None)], "query string")
    got = {r["query"]: (r.cluster_id, r.step) for r in mart.lookup(q, d, mesh).collect()}
    assert got["c2"] == ("c2", 1) and got["LAP31"] == ("c1", 2) and got["qx7782"] == ("c2", 3) and got["3C-52-A1-0E-9B-44"] == ("c1", 4) and got["f09e4a27d108"] == ("c2", 4)
    assert got["172.20"] == ("c1", 5) and got["kvo"] == ("c4", 6) and got["apple"] == ("c4", 7) and "nothing" not in got


def test_attach(spark, mesh):
    keys = attach.keyspace(mesh.withColumn("asset_tag", F.lit("")))
    rows = spark.createDataFrame([("1", "srv77", "QX7781 and lap31 sr01"), ("2", "3C-52-A1-0E-9B-44", "an iphone"), ("3", "", None)], "source_id string, v string, t string")
    assert {(r.source_id, r.cluster_id) for r in attach.exact(rows, keys, F.col("v")).collect()} == {("1", "c2")}
    from fleetweave.functions.text import normalize_mac

    assert {(r.source_id, r.cluster_id, r.confidence) for r in attach.exact(rows, keys, F.col("v"), normalize_mac).collect()} == {("2", "c1", 1.0)}
    none = spark.createDataFrame([("qx7781",)], "token string")
    many = attach.fuzzy(rows, "source_id", keys, none, F.col("t"), multi=True)
    assert {(r.source_id, r.cluster_id, r.token, r.confidence) for r in many.collect()} == {("1", "c1", "lap31", 0.9)}
    single = attach.fuzzy(rows, "source_id", keys, none.limit(0), F.col("t"), multi=False).collect()
    assert [(r.source_id, r.token) for r in single] == [("1", "qx7781")]
    assert attach.keyspace(mesh, unique_only=True).where("token = 'qx7781'").count() == 0


def test_change_capture(spark):
    cols = "source_id string, raw_json string, raw_hash string, fetched_at timestamp_ntz"
    old = spark.createDataFrame([("a", '{"name":"WS-Alpha","os":"W","@m":1}', "h1", NOW), ("b", '{"x":1}', "h2", NOW)], cols)
    new = spark.createDataFrame([("a", '{"name":"--","os":"W","@m":2,"l":[1,2]}', "h3", NOW), ("c", "{}", "h4", NOW)], cols)
    assert {tuple(r) for r in capture.upsert(old, new, "source_id", "raw_hash").collect()} == {("a", "update"), ("b", "keep"), ("c", "insert")}
    assert {(r.source_id, r.raw_hash) for r in capture.merged(old, new, "source_id", "raw_hash").collect()} == {("a", "h3"), ("b", "h2"), ("c", "h4")}
    diff = {tuple(r) for r in capture.field_changes(old, new, "source_id", "raw_json").collect()}
    assert diff == {("a", "name", "WS-Alpha", None), ("a", "l", None, "1,2")}
    assert capture.field_changes(old, old, "source_id", "raw_json").count() == 0


def test_incremental_records(spark):
    cols = "cluster_id string, source string, source_id string, name string"
    mesh = spark.createDataFrame([("c9", "fg", "x", "old"), ("new-fg-1", "fg", "mac1", "o")], cols)
    batch = spark.createDataFrame([("new-fg-aaaa", "fg", "mac1", "n1"), ("fg::04", "fg", "mac1", "n2"), ("new-fg-bbbb", "fg", "mac1", "n3")], cols)
    once = capture.records_after(mesh, batch)
    assert {tuple(r) for r in once.collect()} == {("c9", "fg", "x", "old"), ("fg::04", "fg", "mac1", "n2")}
    assert {tuple(r) for r in capture.records_after(once, batch).collect()} == {tuple(r) for r in once.collect()}
    again = linking.assigned(spark.createDataFrame([("fg", "mac1"), ("me_ec", "q")], "source string, source_id string"), once)
    got = {r.source_id: r.cluster_id for r in again.collect()}
    assert got["mac1"] == "fg::04" and got["q"].startswith("new-me-") and len(got["q"]) == 15


def test_networks(spark):
    p = spark.createDataFrame([("1", "10.1.2.3"), ("2", "10.200.0.1"), ("3", "bad"), ("4", "172.20.5.9")], "id string, ip string")
    n = spark.createDataFrame([("a", "10.0.0.0/9"), ("b", "10.1.2.0/24"), ("c", "172.20.5.8/30"), ("d", "x")], "v string, cidr string")
    assert {(r.id, r.v) for r in graph.in_networks(p, "ip", n, "cidr").collect()} == {("1", "a"), ("1", "b"), ("4", "c")}


def test_clusters_of_edges(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z2", "z1"), ("z1", "z3"), ("q", "q")]
    got = {r.uid: r.cluster_id for r in linking.clusters(spark.createDataFrame(edges, "uid_l string, uid_r string")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61)) and got["z3"] == "z1" and "q" not in got
    assert linking.clusters(spark.createDataFrame([], "uid_l string, uid_r string")).count() == 0


def test_em_finds_truth():
    import random

    r = random.Random(5)
    comps = (linking.Comparison("exact", "a"), linking.Comparison("exact", "b"), linking.Comparison("exact", "c"))
    counts = {}
    for _ in range(20000):
        match = r.random() < 0.2
        g = tuple(int(r.random() < (0.9 if match else 0.1)) for _ in comps)
        counts[g] = counts.get(g, 0) + 1
    u = {c.column: [0.9, 0.1] for c in comps}
    m = linking.expectation_maximisation(list(counts.items()), comps, 0.2, u)
    assert all(abs(m[c.column][1] - 0.9) < 0.05 for c in comps)
