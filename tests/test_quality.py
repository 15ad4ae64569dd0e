"""p3, p5, p6 and p7 against brute force, and their edges."""

import datetime as D
import json
import random

from pyspark.sql import functions as F

from fleetweave.operators import history, instants, nested, ordered, spikes

T0 = D.datetime(2025, 3, 1)
METRIC = "cluster_id string, source string, metric_name string, metric_id long, value double, tags array<string>, recorded_at timestamp_ntz"


def series(name, values, tags=("units=%",), start=0):
    return [("c", "s", name, start + i, v, list(tags), T0 + D.timedelta(minutes=i)) for i, v in enumerate(values)]


def reasons(spark, rows, **kw):
    df = spark.createDataFrame(rows, METRIC).withColumn("more", F.lit(1))
    got = spikes.readings(df, ["cluster_id", "source", "metric_name"], "metric_id", "value", "tags", "recorded_at", **kw).collect()
    return {r.metric_id: r.reason for r in got}


def wave(n, seed=1):
    r = random.Random(seed)
    return [50 + 5 * ((i % 24) / 24) + round(r.random(), 3) for i in range(n)]


def test_spikes_stuck_impossible(spark):
    a = wave(200)
    a[20], a[21], a[90], a[150] = 80.0, 79.0, 120.0, float("nan")
    a[120:135] = [52.0] * 15
    b = [7.0] * 60  # constant
    c = wave(100) + [x + 30 for x in wave(100, 2)]  # a lasting change of level
    got = reasons(spark, series("a", a) + series("b", b, start=1000) + series("c", c, start=2000) + series("a", a)[20:21])
    want = {20: "spike", 21: "spike", 90: "impossible", 150: "impossible"} | {i: "stuck" for i in range(120, 135)}
    assert got == want


def test_short_level_change_is_none(spark):
    v = wave(200)
    v[100:120] = [x + 30 for x in v[100:120]]  # 20 readings: no spike of a few
    v[50] = 99.0
    assert reasons(spark, series("a", v)) == {}  # 99 is within reach of the other level
    v[50] = 10.0
    assert reasons(spark, series("a", v)) == {50: "spike"}


def test_cut_series_as_whole(spark):
    v = wave(3000)
    for i in (5, 700, 701, 1499, 1500, 2999):
        v[i] = 90.0
    v[990:1010] = [51.0] * 20
    rows = series("a", v) + series("b", wave(50), start=10_000)
    assert reasons(spark, rows, target=400) == reasons(spark, rows)


def test_no_readings(spark):
    assert reasons(spark, []) == {}
    nulls = [("c", None, "m", 1, None, None, T0), (None, None, None, 2, 5.0, None, None), ("c", "s", "m", None, 5.0, ["units="], T0)]
    assert reasons(spark, nulls) == {}


def brute_nodes(v, path=""):
    if isinstance(v, list):
        for i, x in enumerate(v):
            if isinstance(x, dict):
                yield f"{path}[{i}]"
            yield from brute_nodes(x, f"{path}[{i}]")
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from brute_nodes(x, f"{path}.{k}" if path else k)


def test_nested(spark):
    docs = ['{"hw":{"cards":[{"ports":[1,null,{"n":1}]}]},"grid":[[{"a":1},2],[]]}', '[null,{"tags":[{},{"x":[{}]}]}]', "{broken", "", None, "5", '"x"', "[NaN]", '{"a":[{}]} x', '{"a":[{}]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(9, docs[9])], "id long, t string")
    out = nested.flatten(df, "id", "t")
    got = {(r.rec_key, r.node_path) for r in out.where("is_element").collect()}
    want = {(str(i), p) for i, t in enumerate(docs) if t and nested.parse(t) is not NotImplemented for p in brute_nodes(json.loads(t))}
    assert got == want and ("0", "hw.cards[0].ports[2]") in got and ("1", "[1].tags[1]") in got and ("0", "grid[0][0]") in got
    assert out.count() == out.distinct().count()
    up = {(r.rec_key, r.node_path): r.parent_path for r in out.collect()}
    assert up["0", "hw.cards[0].ports[2]"] == "hw.cards[0]" and up["0", "hw.cards[0]"] == "" and up["0", ""] is None
    assert all((k, p) in up for (k, n), p in up.items() if p)  # links lead to rows


def test_nested_texts_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("k", json.dumps({"a.b": '[{"c":[{"d":1}]},null,{"c":[]}]', "e": "[x", "f": '{"g":[{}]}'}))], "id string, t string")
    out = nested.flatten(df, "id", "t", open_texts=True)
    assert {r.node_path for r in out.where("is_element").collect()} == {"a.b[0]", "a.b[2]", "a.b[0].c[0]"}
    nested.write_tables(out, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    t = nested.as_table(back.select(out.columns), "a.b[].c[]", "d int").collect()
    assert [(r.node_path, r.d) for r in t] == [("a.b[0].c[0]", 1)]


def test_nested_deep():
    deep = "[" * 50_000 + '{"a":[{}]}' + "]" * 50_000
    v = nested._parse_deep(deep)
    assert v is not NotImplemented and sum(1 for x in nested.visit(v, payload=False) if x[3]) == 2
    for t in ('{"a":1,}', "[1,]", "[1 2]", '{"a" 1}', "[", '{"a":tru}', "[01]"):
        assert nested._parse_deep(t) is NotImplemented, t
    assert nested._parse_deep('{"a": [1, {"b": null}], "c": "x\\u0041"}') == {"a": [1, {"b": None}], "c": "xA"}


def test_instants(spark):
    zones = spark.createDataFrame([("a", "Europe/Berlin", "dmy"), ("b", "America/New_York", "mdy"), ("c", None, None)], "source string, tz string, date_order string")
    local = [("a", (T0 + D.timedelta(days=d)).strftime("%Y-%m-%d %H:%M:%S"), T0 + D.timedelta(days=d, hours=-1 if d < 29 else -2, seconds=30)) for d in range(0, 200, 3)]
    wrong = [("c", x, y) for _, x, y in local]  # declares nothing, and its clock is Berlin's too
    times = spark.createDataFrame([("e%d" % i, *r) for i, r in enumerate(local + wrong)] + [("n", None, "2025-01-01", T0), ("x", "a", None, None), ("y", "b", "never", T0)], "id string, source string, t string, seen timestamp_ntz")
    found = instants.estimate_zones(times, zones, "source", "t", "seen", "tz", "date_order")
    assert found["a"][0] == "Europe/Berlin" and found["b"][0] == "America/New_York" and found["c"][0] == "Europe/Berlin"
    got = {r.rec_key: r.epoch_us for r in instants.instants(times, F.col("id"), "source", "t", found).collect()}
    assert "x" not in got and "y" not in got and got["n"] == 1_735_689_600_000_000
    assert got["e0"] == int((T0 - D.datetime(1970, 1, 1)).total_seconds() - 3600) * 10**6


CHANGE = "source string, source_id string, field string, old_value string, new_value string, changed_at timestamp_ntz, batch_id string"


def brute_versions(rows):
    clean = lambda v: None if v is None or v.strip().lower() in history.PLACEHOLDERS else v.strip()
    keyed = {}
    for s, i, f, o, n, t, b in rows:
        k = keyed.setdefault((s, i, f), {})
        if t not in k or b > k[t][0]:
            k[t] = (b, clean(o), clean(n))
    out = set()
    for key, by in keyed.items():
        stands, since = None, None
        for t in sorted(by):
            _, o, n = by[t]
            if o == n or n == stands:
                continue
            if stands is not None:
                out.add((*key, since, t))
            stands, since = n, t
        if stands is not None:
            out.add((*key, since, None))
    return out


def random_changes(n, keys, seed):
    r = random.Random(seed)
    vals = ["a", " a", "b", "c ", "", None, "N/A", "--"]
    return [("s", str(r.randrange(keys)), "f", r.choice(vals), r.choice(vals), T0 + D.timedelta(minutes=r.randrange(n)), f"b-{i:05d}") for i in range(n)]


def versions(spark, rows, **kw):
    us = lambda v: None if v == -1 else D.datetime(1970, 1, 1) + D.timedelta(microseconds=v)
    df = spark.createDataFrame(rows, CHANGE).withColumn("value", F.lit("clash")).withColumn("at", F.lit(1))
    got = history.versions(df, ["source", "source_id", "field"], "old_value", "new_value", "changed_at", "batch_id", **kw).collect()
    out = [(r.source, r.source_id, r.field, us(r.valid_from_us), us(r.valid_to_us)) for r in got]
    assert len(out) == len(set(out))
    return set(out)


def test_versions(spark):
    rows = random_changes(800, 9, 1)
    assert versions(spark, rows + rows[:50]) == brute_versions(rows)
    assert versions(spark, rows, periods=3) == brute_versions(rows)
    assert versions(spark, []) == set()


def test_versions_of_long_histories(spark):
    rows = random_changes(1500, 2, 3)
    assert versions(spark, rows, target=100) == brute_versions(rows)


def test_snapshots(spark):
    a = spark.createDataFrame([("1", "x", "p"), ("2", "y", None), ("3", "z", "q")], "id string, a string, b string")
    b = spark.createDataFrame([("1", "x", "p"), ("2", "y2", None), ("4", "n", "m")], "id string, a string, b string")
    diff = history.changes_of_snapshots(a, b, ["id"], ["a", "b"], F.lit("2025-01-01").cast("timestamp"), F.lit("b1"))
    assert {(r.id, r.field, r.old_value, r.new_value) for r in diff.collect()} == {("2", "a", "y", "y2"), ("3", "a", "z", None), ("3", "b", "q", None), ("4", "a", None, "n"), ("4", "b", None, "m")}
    empty = spark.createDataFrame([], "id string, a string, b string, valid_from_us long, valid_to_us long")
    one = history.merge_snapshot(empty, a, ["id"], ["a", "b"], 1)
    two = history.merge_snapshot(one, b, ["id"], ["a", "b"], 2)
    assert {tuple(r) for r in two.collect()} == {("1", "x", "p", 1, -1), ("2", "y", None, 1, 2), ("2", "y2", None, 2, -1), ("3", "z", "q", 1, 2), ("4", "n", "m", 2, -1)}
    again = history.merge_snapshot(two, b, ["id"], ["a", "b"], 3)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in two.collect()}


def test_chunks_cover_all_rows_once(spark):
    rows = [("hot", i % 500, i) for i in range(3000)] + [("cold", i, i) for i in range(30)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    c = ordered.chunked(df, ["k"], "t", ["id"], 4, target=300)
    assert c.cut
    own = c.only_own(c.df)
    assert sorted((r.k or "", r.t, r.id) for r in own.collect()) == sorted((k or "", t, i) for k, t, i in rows)
    back = c.df.withColumn("before", ordered.neighbour(c, [F.col("t"), F.col("id")], F.col("id"), 1))
    got = {(r.t, r.id): r.before for r in c.only_own(back).where("k = 'hot'").collect()}
    srt = sorted((t, i) for k, t, i in rows if k == "hot")
    assert got == {x: (srt[n - 1][1] if n else None) for n, x in enumerate(srt)}
