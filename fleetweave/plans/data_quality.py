"""Queries p3, p5, p6 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.operators import history, instants, nested, spikes
from fleetweave.plans.registry import query
from fleetweave.sources.tables import table


def unique_id():
    return F.concat_ws("::", "source", "source_id")


@query("p3_readings")
def p3_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings that can't be believed, with the reason."""
    return spikes.readings(table(spark, d, "metrics"), ["cluster_id", "source", "metric_name"], "metric_id", "value", "tags", "recorded_at")


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_readings(spark, d).select("metric_id")


def _nodes(spark: SparkSession, d: str, payload: bool) -> DataFrame:
    raw = nested.flatten(table(spark, d, "raw_store"), "raw_id", "raw_json", payload=payload)
    records = table(spark, d, "source_records").where("extra_attributes <> ''").select(unique_id().alias("unique_id"), "extra_attributes")
    extra = nested.flatten(records, "unique_id", "extra_attributes", open_texts=True, payload=payload)
    tag = lambda df, f: df.select(F.lit(f).alias("field"), "*")
    return tag(raw, "raw_store.raw_json").unionByName(tag(extra, "source_records.extra_attributes"))


_OPENED = """with recursive src as (
    select 'raw_store.raw_json' as field, raw_id::varchar as rec_key, case when json_valid(raw_json) then raw_json::json end as v, '' as path from raw_store
    union all select 'source_records.extra_attributes', source || '::' || source_id, case when json_valid(extra_attributes) then extra_attributes::json end, '' from source_records where extra_attributes <> ''),
  start as (select field, rec_key, v, path from src where v is not null and field = 'raw_store.raw_json' union
    select field, rec_key, case when json_valid(m.value->>'$') then (m.value->>'$')::json end, m.key from src, json_each(src.v) m where src.v is not null and field <> 'raw_store.raw_json' and json_type(m.value) = 'VARCHAR' and starts_with(m.value->>'$', '[')),
  walk as (select field, rec_key, v, path, false as element from start where v is not null
    union all select w.field, w.rec_key, m.value, case when json_type(w.v) = 'ARRAY' then w.path || '[' || m.key || ']' when w.path = '' then m.key else w.path || '.' || m.key end, json_type(w.v) = 'ARRAY'
    from walk w, json_each(w.v) m where json_type(w.v) in ('ARRAY', 'OBJECT') and json_type(m.value) in ('ARRAY', 'OBJECT'))
  select distinct field, rec_key, path as node_path from walk where element and json_type(v) = 'OBJECT'"""


@query("p5_found", _OPENED)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, payload=False).where("is_element").select("field", "rec_key", "node_path")


@query("p5_tables")
def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """All rows of all tables, with links to the rows above them."""
    return _nodes(spark, d, payload=True)


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    systems, events = table(spark, d, "source_systems"), table(spark, d, "mesh_events")
    zones = instants.estimate_zones(events, systems, "source", "recorded_at", "ingested_at", "tz", "date_order")
    jobs = [
        ("source_records.mdm_located_time", table(spark, d, "source_records").where("mdm_located_time <> ''"), unique_id(), "mdm_located_time"),
        ("raw_store.remote_updated_at", table(spark, d, "raw_store"), F.col("raw_id"), "remote_updated_at"),
        ("mesh_events.recorded_at", events, F.col("event_id"), "recorded_at"),
    ]
    out = [instants.instants(df, key, "source", text, zones).select(F.lit(f).alias("field"), "rec_key", "epoch_us") for f, df, key, text in jobs]
    return instants.all_of(out)


_CLEAN = "case when lower(trim({c})) in ({l}) then null else trim({c}) end"
_EMPTY = ", ".join(f"'{x}'" for x in history.PLACEHOLDERS)
_VERSIONS = f"""with r as (select source, source_id, field, changed_at, arg_max({{'o': coalesce(o, chr(0)), 'n': coalesce(n, chr(0))}}, (batch_id, coalesce(n, ''))) as x from (
    select *, {_CLEAN.format(c='old_value', l=_EMPTY)} as o, {_CLEAN.format(c='new_value', l=_EMPTY)} as n from field_history) group by 1, 2, 3, 4),
  s as (select *, x.n as v, lag(x.n, 1, chr(0)) over w as before from r where x.o <> x.n window w as (partition by source, source_id, field order by changed_at)),
  c as (select *, lead(changed_at) over (partition by source, source_id, field order by changed_at) as ends from s where v <> before)
  select source, source_id, field, epoch_us(changed_at) as valid_from_us, coalesce(epoch_us(ends), -1) as valid_to_us from c where v <> chr(0)"""


@query("p7_found", _VERSIONS)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    v = history.versions(table(spark, d, "field_history"), ["source", "source_id", "field"], "old_value", "new_value", "changed_at", "batch_id")
    return v.select("source", "source_id", "field", "valid_from_us", "valid_to_us")
