"""Each feed reads what its raw store holds; the expected values are picked from the JSON here, not by the specs."""

import json

import pytest
from pyspark.sql import functions as F

from fleetweave.plans import registry
from fleetweave.sources import default, manifest
from fleetweave.sources.tables import table

#: Where a source's raw JSON has the text of a field.
HELD = {
    "sp": {"source_id": "id", "name": "fields.Title", "model": "fields.Model"}, "ad": {"source_id": "id", "name": "fields.Title", "model": "fields.Model"},
    "zbx": {"source_id": "hostid", "name": "host", "os": "inventory.os", "asset_tag": "inventory.tag"}, "me_mdm": {"source_id": "device_id", "mdm_located_time": "locations.0.added_time"},
    "me_ec": {"source_id": "resource_id", "name": "fqdn_name", "os": "os_name"}, "sdp": {"source_id": "id", "name": "fqdn_name", "os": "os_name"},
    "fg": {"source_id": "mac", "ip_address": "ipv4_address"}, "fg_dhcp": {"source_id": "mac", "ip_address": "ipv4_address"},
}
SERIALS = {"ad": "fields.SerialNumber", "sp": "fields.SerialNumber", "zbx": "inventory.serial_no_a", "me_ec": "hardware.board.serial", "sdp": "hardware.board.serial"}


def at(v, path):
    for p in path.split("."):
        v = v[int(p)] if isinstance(v, list) and p.isdigit() and int(p) < len(v) else v.get(p) if isinstance(v, dict) else None
    return v if isinstance(v, str) else ""


def test_fields_held(spark, small):
    from fleetweave.functions import text

    docs = {}
    for r in table(spark, small, "raw_store").select("source", "raw_json").collect():
        try:
            docs.setdefault(r.source, []).append(json.loads(r.raw_json))
        except ValueError:
            docs.setdefault(r.source, []).append({})
    got = registry.queries()["walk_feeds_all"](spark, small)
    rows = got.collect()
    for source, fields in HELD.items():
        mine = [r for r in rows if r.source == source]
        clean = lambda vs, f=text.strip_sentinels: [r.x for r in spark.createDataFrame([(v,) for v in vs], "v string").select(f(F.col("v")).alias("x")).collect()]
        for field, path in fields.items():
            want = clean([at(d, path) for d in docs[source]])
            assert any(want) and sorted(r[field] for r in mine) == sorted(want), (source, field)
        if source in SERIALS:
            want = clean(clean([at(d, SERIALS[source]) for d in docs[source]]), text.normalize_serial)
            assert any(want) and sorted(r.serial_number for r in mine) == sorted(want), source


def test_all_feeds():
    roles = [f.role for f in default.FEEDS.values()]
    assert [roles.count(r) for r in manifest.Role] == [8, 7, 9]


@pytest.mark.parametrize("source", ["ad", "zbx"])
def test_no_blank_feed(spark, small, source):
    rows = registry.queries()["walk_feeds_all"](spark, small).where(f"source = '{source}'").collect()
    full = [r for r in rows if r.source_id and r.name and (r.model if source == "ad" else r.os)]
    assert len(full) > 0.9 * len(rows)
