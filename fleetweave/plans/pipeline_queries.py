"""Queries of extraction and the whole pipeline (P-01 to P-09, SET-01, S rows, section 3.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetweave.operators import mart
from fleetweave.plans.registry import query
from fleetweave.plans.scalar import family_sql, mac_sql, name_sql, serial_sql, strip_sql
from fleetweave.session import staged
from fleetweave.sources import default, manifest
from fleetweave.sources.tables import table


def silver(s, d, extra: bool = True, feeds: dict = default.FEEDS):
    """Records of all anchor feeds from one scan: each raw text extracted by the spec of its source and normalised."""
    raw = table(s, d, "raw_store").select("source", "raw_json")
    mine = {source: feeds[key] for key, source in default.FEED_SOURCES.items()}
    return manifest.normalized(manifest.walk_all(raw.where(F.col("source").isin(*mine)), mine, extra=extra), F.col("source"), default.FIELDS)


def _silver_sql(columns: tuple[str, ...]) -> str:
    parts = []
    for key, source in default.FEED_SOURCES.items():
        f = default.SQL_FEEDS[key]

        def at(p: str) -> str:
            path = "$" + "".join(f"[{x}]" if x.isdigit() else f'."{x}"' for x in p.split("."))
            return strip_sql(f"json_extract_string(j, '{path}')")

        def raw(n: str) -> str:
            if n not in f.spec:
                return "''"
            each = [at(p) for p in manifest.as_spec(f.spec[n]).paths]
            if len(each) == 1:
                return each[0]
            # two paths: the second only if it differs
            return f"concat_ws(',', nullif({each[0]}, ''), case when {each[1]} <> {each[0]} then nullif({each[1]}, '') end)"

        sid = at(f.id_path)
        made = {
            "source": f"'{source}'", "source_id": sid, "name": raw("name"), "name_clean": name_sql(raw("name")), "serial_number": serial_sql(raw("serial_number")), "mac_clean": mac_sql(raw("mac_address")),
            "manufacturer": f"lower({raw('manufacturer')})", "os_family": family_sql(raw("os")), "mdm_latitude": raw("mdm_latitude"), "assigned_user": raw("assigned_user"), "ip_address": raw("ip_address"),
        }
        parts.append(f"select {', '.join(f'{made[c]} as {c}' for c in columns)} from (select case when json_valid(raw_json) then raw_json else '{{}}' end as j from raw_store where source = '{source}')")
    return " union all ".join(parts)


_SHOWN = ("source", "source_id", "name_clean", "serial_number", "mac_clean", "manufacturer", "os_family", "mdm_latitude", "assigned_user", "ip_address")
query("walk_feeds", _silver_sql(_SHOWN))(lambda s, d: silver(s, d, extra=False, feeds=default.SQL_FEEDS).select(*_SHOWN))
query("walk_feeds_all")(silver)
query("feed_extras")(lambda s, d: silver(s, d).select("source", "source_id", "extra_attributes").where("extra_attributes <> ''"))


@query("unique_ids", "select distinct source || '::' || source_id as unique_id from source_records")
def unique_ids(s, d):
    return table(s, d, "source_records").select(F.concat_ws("::", "source", "source_id").alias("unique_id")).distinct()


@query("name_fallback", f"select source, source_id, case when {serial_sql('serial_number')} = '' and {mac_sql('mac_address')} = '' then {name_sql('name')} else '' end as name_fallback from source_records")
def name_fallback(s, d):
    from fleetweave.functions import text

    none = (text.normalize_serial(F.col("serial_number")) == "") & (text.normalize_mac(F.col("mac_address")) == "")
    return table(s, d, "source_records").select("source", "source_id", F.when(none, text.normalize_name(F.col("name"))).otherwise(F.lit("")).alias("name_fallback"))


@query("resolved_mart")
def resolved_mart(s, d):
    """The pipeline from normalised records to the mart: all records, whatever cluster they have, linked, clustered and consolidated.

    Prior, m and u are estimated from the records. It reads source_records, as raw_store holds only some of them.
    """
    from fleetweave.operators import linking as L
    from fleetweave.plans.linking_queries import estimated, keyed

    rows = staged(keyed(s, d), "link")
    lam, m, u = estimated(rows)
    weighed = L.weights(L.levels(L.blocked(rows, L.DEVICE_BLOCKING), rows, L.DEVICE_COMPARISONS), L.DEVICE_COMPARISONS, lam, m, u, rows=rows)
    found = L.with_singles(rows, L.clusters(weighed.where("match_weight >= 5")))
    recs = table(s, d, "source_records")
    labelled = recs.withColumn("uid", F.concat_ws("::", "source", "source_id")).drop("cluster_id").join(found, "uid").drop("uid")
    return mart.consolidated(labelled, expand=True).withColumn("sources", F.array_join("sources", ","))


@query("hardware_fields")
def hardware_fields(s, d):
    """Labelled hardware facts of the texts, one row per field (tested on its own; labels in free text aren't for SQL)."""
    from fleetweave.functions.hardware import hardware_fields as fields
    from fleetweave.functions.text import strip_html

    docs = table(s, d, "documents").where("text is not null").select("doc_id", strip_html(F.col("text")).alias("body"))
    return docs.select("doc_id", F.explode(fields("body")).alias("field", "value"))
