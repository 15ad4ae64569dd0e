"""Linkage runs over every record, whatever cluster it has."""

import datetime as D

import pytest

from fleetweave.operators import linking as L
from fleetweave.plans import linking_queries, registry

COLS = "cluster_id source source_id name name_clean name_fallback serial_number mac_address mac_clean manufacturer model os os_version asset_tag assigned_user ip_address imei extra_attributes os_family".split()


def rec(cluster, source, i, name="", serial="", **more):
    fallback = "" if serial else name
    r = {c: "" for c in COLS} | {"cluster_id": cluster, "source": source, "source_id": i, "name": name, "name_clean": name, "name_fallback": fallback, "serial_number": serial} | more
    return (*(r[c] for c in COLS), D.datetime(2025, 1, 1))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """A device known to one source, as a provisional and an unassigned record, another without a serial, and others."""
    rows = [
        rec("c-1", "sp", "1", "ws-1", "SER0001"), rec("new-me-1", "me_ec", "2", "ws-1", "SER0001"), rec("", "zbx", "3", "ws-1", "SER0001"),
        rec("new-fg-1", "fg", "4", "tab-1"), rec("", "fg_dhcp", "5", "tab-1"),
    ] + [rec(("c-", "new-x-", "")[i % 3] + ("" if i % 3 == 2 else str(i)), "ad", str(i), f"pc-{i}", f"SERIAL{i}") for i in range(10, 40)]
    base = tmp_path_factory.mktemp("mixed")
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLS) + ", fetched_at timestamp_ntz").write.parquet(f"{base}/source_records.parquet")
    return str(base)


def test_pairs_of_all_records(spark, mixed):
    q = registry.queries()
    got = {(r.uid_l, r.uid_r, r.match_key) for r in q["blocking_pairs_all"](spark, mixed).collect()}
    serial = {("me_ec::2", "sp::1", "serial_number"), ("me_ec::2", "zbx::3", "serial_number"), ("sp::1", "zbx::3", "serial_number")}
    assert got == serial | {("fg::4", "fg_dhcp::5", "name_clean")}
    for name in ("gamma_levels_all", "weights_by_frequency"):
        assert {(r.uid_l, r.uid_r, r.match_key) for r in q[name](spark, mixed).collect()} == got, name
    assert sum(r.n for r in q["gamma_patterns_all"](spark, mixed).collect()) == 4
    assert {(r.uid_l, r.uid_r) for r in q["training_pairs_all"](spark, mixed).collect()} == {(r.uid_l, r.uid_r) for r in linking_queries.positives(spark, mixed).collect()} != set()


def test_prior_of_all_records(spark, mixed):
    got = registry.queries()["linkage_prior"](spark, mixed).first()[0]
    assert got == pytest.approx(4 / 0.5 / (35 * 34 / 2))


def test_pass_of_a_rule_without_comparison(spark, mixed):
    """Pairs equal on name_fallback are equal on name_clean too, so as first rule they never show; and what a pass can't see it doesn't set."""
    k = linking_queries.keyed(spark, mixed)
    lev = L.levels(L.blocked(k, L.DEVICE_BLOCKING), k, L.DEVICE_COMPARISONS, L.DEVICE_BLOCKING)
    assert [(r.uid_l, r.uid_r) for r in lev.where("b_name_fallback").collect()] == [("fg::4", "fg_dhcp::5")]
    u = {c.column: [0.99] + [0.01 / (c.levels - 1)] * (c.levels - 1) for c in L.DEVICE_COMPARISONS}
    m = L.trained(lev, L.DEVICE_COMPARISONS, ("name_fallback",), 0.01, u)
    default = L.trained(lev, L.DEVICE_COMPARISONS, (), 0.01, u)
    assert m["serial_number"] == default["serial_number"] and m["name_clean"] == default["name_clean"]


def test_mart_of_all_records(spark, mixed):
    devices = registry.queries()["resolved_mart"](spark, mixed).collect()
    assert sum(r.record_count for r in devices) == 35
    assert [(r.cluster_id, r.sources, r.record_count) for r in devices if r.serial_number == "SER0001"] == [("me_ec::2", "me_ec,sp,zbx", 3)]
