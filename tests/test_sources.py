import datetime as D
import json

import pytest
from pyspark.sql import functions as F

from fleetweave.sources import connectors, default, manifest
from fleetweave.streaming import sync


@pytest.fixture()
def pages(tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return f"file://{tmp_path}/{name}"

    return put


def ids(df):
    return sorted(json.loads(r.raw_json)["id"] for r in df.collect())


def test_readers(spark, pages, tmp_path):
    connectors.register(spark)
    url = pages("one", {"x": {"y": [{"id": 1}, {"id": 2}, 5]}})
    assert ids(spark.read.format("rest_json").option("url", url).option("response_path", "x.y").load()) == [1, 2]
    for i in (1, 2, 3):
        pages(f"p{i}", {"devices": [{"id": i}]})
    assert ids(spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}").option("parallel", "2").load()) == [1, 2, 3]
    second = pages("l2", {"items": [{"id": 9}]})
    first = pages("l1", {"items": [{"id": 8}], "paging": {"next": second}})
    assert ids(spark.read.format("linked_json").option("url", first).load()) == [8, 9]
    pages("c1", {"results": [{"id": 1}, {"id": 2}], "list_info": {"has_more_rows": True}})
    pages("c3", {"results": [{"id": 3}], "list_info": {"has_more_rows": False}})
    assert ids(spark.read.format("cursor").option("url", f"file://{tmp_path}/c{{start}}").option("row_count", "2").load()) == [1, 2, 3]
    assert spark.read.format("rest_json").option("url", "file:///nowhere").load().count() == 0


def test_details_and_latest(spark):
    a = spark.createDataFrame([('{"id":"1","name":"x"}',), ('{"id":"2"}',)], "raw_json string")
    b = spark.createDataFrame([('{"id":"1","NAME":"other","Extra":"e"}',)], "raw_json string")
    got = sorted((json.loads(r.raw_json) for r in connectors.with_details(a, b, "id").collect()), key=lambda x: x["id"])
    assert got == [{"id": "1", "name": "x", "extra": "e"}, {"id": "2"}]
    rows = spark.createDataFrame([("1", "5", "old"), ("1", "12", "new"), ("1", "x", "bad")], "id string, added_time string, v string")
    assert [tuple(r) for r in connectors.latest_of(rows, "id", "added_time", ["v"]).collect()] == [("1", "new")]


def test_raw_store(spark, tmp_path):
    raw = spark.createDataFrame([('{"id":"1","b":2,"a":1}',), ('{"id":"1","a":1,"b":2}',), ('{"x":1}',)], "raw_json string").coalesce(1)
    got = {r.source_id: r for r in connectors.raw_store(raw, "id", F.lit(D.datetime(2025, 1, 1))).collect()}
    assert len(got) == 2 and got["1"].raw_json == '{"id":"1","a":1,"b":2}'
    path = str(tmp_path / "t")
    assert connectors.replace_if_any(raw, path) and not connectors.replace_if_any(raw.limit(0), path)
    assert spark.read.parquet(path).count() == 3


def test_canonical_hash(one):
    from fleetweave.operators.capture import canonical_json

    a, b, c, d = one(canonical_json, '{"a":{"y":[{"q":1,"p":2}],"x":1},"b":2}', '{"b":2, "a":{"x":1,"y":[{"p":2,"q":1}]}}', "{broken", '{"a":{"x":2}}')
    assert a == b and json.loads(a) == {"a": {"x": 1, "y": [{"p": 2, "q": 1}]}, "b": 2} and c == "{broken" and d != a


def test_csv_and_generator(spark, tmp_path):
    made = connectors.generated(spark, 200)
    assert made.select("cluster_id").distinct().count() == 200 and made.count() > 300
    connectors.write_csv_by_source(made, str(tmp_path / "c"))
    back = connectors.read_csv_text(spark, str(tmp_path / "c"))
    assert back.count() == made.count() and back.where("serial_number is null").count() == 0


def test_extraction(spark):
    feed = manifest.Feed("sp", manifest.Role.ANCHOR, "s", "id", "device", spec={"name": ("a.b", "c"), "serial_number": manifest.FieldSpec(("s.0.n",), "serial"), "model": ("l",)})
    docs = ['{"id":"7","a":{"b":"x"},"c":"y","s":[{"n":"SN-1"}],"l":["p","--","q"],"more":{"k":true,"m":null},"lst":[{"z":1}]}', "{broken", '{"id":["1","2"],"a":{"b":"x"},"c":"x"}']
    got = manifest.walk(spark.createDataFrame([(d,) for d in docs], "raw_json string"), feed).collect()
    assert (got[0].source_id, got[0].name, got[0].serial_number, got[0].model) == ("7", "x,y", "1", "p,q")
    assert json.loads(got[0].extra_attributes) == {"more.k": "true", "s": '[{"n": "SN-1"}]', "lst": '[{"z": 1}]'}
    assert (got[1].source_id, got[1].name, got[1].extra_attributes) == ("", "", "") and (got[2].source_id, got[2].name) == ("1,2", "x")


def test_manifest_problems():
    assert manifest.problems(default.MANIFEST, connectors.SOURCES.keys() | {"ldap"}) == []
    F_, L, R = manifest.Feed, manifest.Link, manifest.Role
    bad = manifest.Manifest(
        "no-name", {"s": manifest.System("what", 0, 2)},
        {"f": F_("t", R.ANCHOR, "a b", "", "none", spec={"x": manifest.FieldSpec(("p",), "nope")}), "g": F_("s", R.ATTACHMENT, "g", "id"), "h": F_("s", R.ATTACHMENT, "g", "id", links=(L("a", "q", "z", "odd"), L("a", "p", "z")))},
        {"p": manifest.Profile(("a",), blocking=("b",))},
    )
    text = "\n".join(manifest.problems(bad, {"rest_json"}))
    for part in ("identifier", "unknown strategy", "schedule", "coverage", "unknown system", "store 'a b'", "id_path", "unknown profile 'none'", "transform", "needs a link", "belongs to", "link strategy", "link to unknown", "link on unknown", "'b' isn't a field"):
        assert part in text, part
    assert manifest.as_spec(("x", "name")).transform == "name" and manifest.as_spec(("x", "y")).paths == ("x", "y")


def test_sync(spark, tmp_path):
    land, store, hist = (str(tmp_path / x) for x in ("land", "store", "hist"))
    cols = "source_id string, raw_json string, raw_hash string, fetched_at timestamp"
    t = D.datetime(2025, 1, 1)

    def send(*rows):
        spark.createDataFrame([(i, j, str(hash(j)), t) for i, j in rows], cols).coalesce(1).write.mode("append").parquet(land)
        q = sync.sync_store(spark.readStream.schema(cols).parquet(land), store, hist, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None

    send(("a", '{"n":"1"}'), ("b", '{"n":"1"}'))
    send(("a", '{"n":"2"}'), ("b", '{"n":"1"}'), ("c", "{}"))
    now = {r.source_id: r.raw_json for r in spark.read.parquet(sync.version(spark, store)).collect()}
    assert now == {"a": '{"n":"2"}', "b": '{"n":"1"}', "c": "{}"}
    assert [(r.source_id, r.field, r.old_value, r.new_value) for r in spark.read.parquet(hist).collect()] == [("a", "n", "1", "2")]


def test_event_streams(spark, tmp_path):
    t = D.datetime(2025, 1, 1)
    rows = [(1, 7, t), (1, 7, t), (2, 7, t + D.timedelta(minutes=2)), (3, 7, t + D.timedelta(hours=2)), (4, 8, t + D.timedelta(hours=3))]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(path)
    assert sync.drain(sync.delivered_once(stream(), "event_id", "ts"), "t1").count() == 4
    w = sync.drain(sync.windowed(stream(), "ts", ["user_id"]), "t2", "complete")
    assert sorted((r.user_id, r.n) for r in w.collect()) == [(7, 1), (7, 3), (8, 1)]
    s = sync.drain(sync.sessions(stream(), "ts", "user_id"), "t3", "complete")
    assert sorted((r.user_id, r.n) for r in s.collect()) == [(7, 1), (7, 3), (8, 1)]
    gaps = sync.drain(sync.silent(stream(), "user_id", "ts", 3600), "t4")
    assert [(r.user_id, r.gap_s) for r in gaps.collect()] == [(7, 7080)]
