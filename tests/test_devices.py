"""Devices as a whole, and stores, on small tables."""

import datetime as D
import json

from pyspark.sql import functions as F

from fleetweave.operators import devices, graph
from fleetweave.plans import registry
from fleetweave.sources import connectors, default
from fleetweave.sources.tables import table

T0 = D.datetime(2025, 6, 1)


def texts(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "raw_json string")


def test_metrics_of_items(spark):
    items = texts(
        spark, {"hostid": "7", "name": "load", "key_": "k.l", "value_type": "0", "units": "%", "lastvalue": "1.5", "lastclock": "1735689600"}, {"hostid": "8", "name": "state", "lastvalue": "up", "lastclock": "1735689601"},
        {"hostid": "9", "name": "gone", "lastvalue": "1", "lastclock": "1"}, {"hostid": "7", "name": "", "lastclock": "1"}, {"hostid": "7", "name": "x", "lastclock": "soon"}, "{broken", {"hostid": "7", "name": "none", "lastclock": "5"},
    )
    hosts = texts(spark, {"hostid": "8", "host": "Kiln4.example"}, {"hostid": "9", "host": "nobody"}, "{broken")
    records = spark.createDataFrame([("c1", "zbx", "7", "a"), ("c2", "zbx", "zz", "kiln4"), ("c3", "sp", "9", "nobody")], "cluster_id string, source string, source_id string, name_clean string")
    got = {r.metric_name: (r.cluster_id, r.value, r.text_value, r.tags) for r in devices.item_metrics(items, hosts, records).collect()}
    assert got == {"load": ("c1", 1.5, None, ["key=k.l", "value_type=0", "units=%"]), "state": ("c2", None, "up", []), "none": ("c1", None, None, [])}
    assert devices.item_metrics(items.limit(0), hosts, records).count() == 0


def test_networks_of_both_versions(spark):
    nets = devices.vlans(texts(spark, {"fields": {"VlanName": "v4", "NetworkID": "10.1.0.0/16", "StartingIP": "10.1.0.10", "EndingIP": "10.1.2.200"}}, {"fields": {"VlanName": "v6", "NetworkID": "fd00::/64", "StartingIP": "fd00::10", "EndingIP": "fd00::1:ffff"}}, {"fields": {"VlanName": "no end", "NetworkID": "10.0.0.0/8", "StartingIP": "10.0.0.1"}}, {"fields": {"VlanName": "mixed", "NetworkID": "x", "StartingIP": "10.0.0.1", "EndingIP": "fd00::1"}}))
    points = spark.createDataFrame([("a", "10.1.1.1"), ("b", "10.1.0.9"), ("c", "fd00::ff"), ("d", "fd00::2:0"), ("e", "bad"), ("f", None), ("g", "10.1.2.200")], "id string, ip string")
    assert {(r.id, r.vlan) for r in graph.in_ranges(points, "ip", nets, "first", "last").collect()} == {("a", "v4"), ("g", "v4"), ("c", "v6")}
    assert graph.in_ranges(points, "ip", nets.limit(0), "first", "last").count() == 0


def test_search_and_page(spark):
    cols = "cluster_id string, device_name string, source_count long, sources array<string>, serial_number string, mac_address string, manufacturer string, model string, os string, os_version string, asset_tag string, assigned_user string, ip_address string, imei string, record_count long"
    d = spark.createDataFrame([("c1", "kiln4", 2, ["b", "a"], "S1", "3c:52:a1:0e:9b:44", "m", None, "o", "", "", "u", "", "", 3), ("c2", "oven", 1, ["a"], "kiln", "", "nan", "", "", "", "", "", "", "", 1)], cols)
    find = lambda *a, **kw: [r.cluster_id for r in devices.search(d, *a, **kw).collect()]
    assert find("KILN", "name") == ["c1"] and find("KILN") == find("kiln", "cluster_id; drop") == ["c1", "c2"] and find("kiln", limit=1) == ["c1"]
    assert find("3C-52-A1-0E-9B-44", "mac_clean") == ["c1"] and find("zzz") == []
    assert [(r.cluster_id, r.total) for r in devices.page(d, 1, 1, 5).collect()] == [("c2", 2)]
    assert {(r.cluster_id, r.sources, r.manufacturer) for r in devices.info(d).collect()} == {("c1", "a, b", "m"), ("c2", "a", "")}


def test_values_of_a_crowd_form_no_pairs(spark):
    rows = [(f"c{i:02d}", "f", "crowd") for i in range(5)] + [("c00", "f", "x"), ("c01", "f", "x"), ("c01", "f", "x"), ("c02", "f", ""), ("c03", "f", None)]
    got = devices.shared_values(spark.createDataFrame(rows, "cluster_id string, feed_key string, value string"), most=4).collect()
    assert [(r.source, r.target, r.type) for r in got if r.type == "shared_f"] == [("c00", "c01", "shared_f")] and sum(r.type == "attached_f" for r in got) == 7


def test_registry(spark):
    manual = spark.createDataFrame([("cost", "sp", "fields.Cost", 0)], "concept string, source string, key string, ord int")
    auto = spark.createDataFrame([("cost", "sp", "fields.Cost2"), ("cost", "ad", "cost"), ("room", "ad", "inventory.room")], "concept string, source string, key string")
    assert {(r.concept, r.source, r.key, r.ord) for r in devices.merged_registry(manual, auto).collect()} == {("cost", "sp", "fields.Cost", 0), ("cost", "ad", "cost", 1000), ("room", "ad", "inventory.room", 1000)}


def test_labels(spark, small):
    rows = registry.queries()["labelled_pairs"](spark, small).collect()
    assert len({(r.uid_l, r.uid_r) for r in rows}) == len(rows) and {r.label for r in rows} == {0, 1}


def test_a_feed_that_fails_leaves_its_table(spark, tmp_path):
    connectors.register(spark)
    for i in (1, 3):
        (tmp_path / f"p{i}").write_text(json.dumps({"devices": [{"id": i}]}))
    (tmp_path / "p2").write_text("{cut off")
    read = lambda **kw: spark.read.format("paged_json").options(url=f"file://{tmp_path}/p{{page}}", **kw).load()
    good = lambda: texts(spark, {"id": 9})
    root = str(tmp_path / "root")
    assert connectors.ingest(spark, {"a": good, "b": good}, root) == {"a": 1, "b": 1}
    assert connectors.ingest(spark, {"a": lambda: read(strict="true"), "b": lambda: good().limit(0), "c": good}, root) == {"a": -1, "b": 0, "c": 1}
    assert [spark.read.parquet(f"{root}/{n}").first().raw_json for n in "abc"] == [json.dumps({"id": 9})] * 3


def test_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    assert connectors.ensure_store(spark, path, "source_id string, raw_json string").count() == 0
    spark.createDataFrame([("1", "{}")], "source_id string, raw_json string").write.mode("append").parquet(path)
    assert connectors.ensure_store(spark, path, "source_id string, raw_json string").count() == 1
    made = connectors.backup(spark, {"s": path}, str(tmp_path / "b"), "t1")
    assert made == {"stamp": "t1", "tables": {"s": 1}} == connectors.read_state(spark, str(tmp_path / "b" / "t1" / "manifest.json"))
    assert connectors.read_state(spark, str(tmp_path / "none")) == {}
    row = connectors.typed(texts(spark, {"a": {"b": 1}, "l": [1]}), {"x": "a.b", "y": "l", "z": "no"}, {"kind": "pc"}).first()
    assert (row.x, row.y, row.z, row.kind) == ("1", "[1]", "", "pc")
    connectors.write_clusters(spark.createDataFrame([("a::1", "c")], "unique_id string, cluster_id string"), str(tmp_path / "cl"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cl")).first().cluster_id == "c"


def test_systems(spark, small):
    got = default.systems_of(table(spark, small, "source_systems"))
    assert set(got) == set(default.SYSTEMS) and all(0 < s.coverage <= 1 and s.schedule_s > 0 for s in got.values())
