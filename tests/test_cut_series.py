"""Series cut in time give what whole series give."""

import datetime as D
import random

from fleetweave.operators import spikes


def test_cut_series_with_levels_and_stuck_pieces(spark):
    """A level in one piece widens the range of the others; a piece that stands still is stuck, as the series moves."""
    r = random.Random(1)
    v = [50 + 5 * ((i % 24) / 24) + round(r.random(), 3) for i in range(3000)]
    v[100:120] = [x + 30 for x in v[100:120]]
    v[2500], v[2700] = 99.0, 10.0
    v[1100:2100] = [51.0] * 1000
    rows = [("c", "s", "m", i, x, ["units=%"], D.datetime(2025, 3, 1) + D.timedelta(minutes=i)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cluster_id string, source string, metric_name string, metric_id long, value double, tags array<string>, recorded_at timestamp_ntz")
    found = lambda **kw: {x.metric_id: x.reason for x in spikes.readings(df, ["cluster_id", "source", "metric_name"], "metric_id", "value", "tags", "recorded_at", **kw).collect()}
    want = {2700: "spike"} | {i: "stuck" for i in range(1100, 2100)}
    assert found() == want
    assert found(target=400) == want


def readings(spark, values, step_min=30, **kw):
    rows = [("c", "s", "m", i, x, ["units=%"], D.datetime(2025, 3, 1) + D.timedelta(minutes=step_min * i)) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "cluster_id string, source string, metric_name string, metric_id long, value double, tags array<string>, recorded_at timestamp_ntz")
    return {x.metric_id: x.reason for x in spikes.readings(df, ["cluster_id", "source", "metric_name"], "metric_id", "value", "tags", "recorded_at", **kw).collect()}


def test_daily_course_of_one_hour(spark):
    """What comes back at its hour is a course and widens the range; what goes beyond the course is a spike."""
    r = random.Random(2)
    flat = [20 + round(r.random(), 3) for _ in range(7 * 48)]
    daily = [x + 10 if i % 48 in (12, 13) else x for i, x in enumerate(flat)]
    daily[100] = 31.0  # the course goes as far
    daily[150] = 60.0
    assert readings(spark, daily) == readings(spark, daily, target=60) == {150: "spike"}
    two = [x + 10 if i % 96 in (32, 33, 34, 35) else x for i, x in enumerate(flat[:192])]
    assert readings(spark, two, 15) == {}


def test_wave_after_a_standstill(spark):
    """The shape of equal readings followed by a wave, and a level that lasts elsewhere, cut or not."""
    r = random.Random(3)
    v = [50.0] * 1000 + [50 + 5 * ((i % 24) / 24) + round(r.random(), 3) for i in range(1000)]
    assert readings(spark, v) == readings(spark, v, target=400) == {i: "stuck" for i in range(1000)}
    v = [20 + round(r.random(), 3) for _ in range(2000)]
    v[300:400] = [40 + round(r.random(), 3) for _ in range(100)]
    v[1700] = 41.0
    assert readings(spark, v) == readings(spark, v, target=400) == {}
