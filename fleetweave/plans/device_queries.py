"""Queries of devices as a whole: story, state, search, attachments, trace, registry, reports (Q-, P-, A- and ER- rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetweave.functions import text
from fleetweave.operators import attach, devices, graph, linking
from fleetweave.plans import feed_queries, linking_queries, mart_queries
from fleetweave.plans.registry import _SQL, query
from fleetweave.sources.tables import present, table

R, D = mart_queries.R, mart_queries.D
_DEV = "(select cluster_id from devices)"


query("device_story", f"""select cluster_id, 'device' as part, u.name as name, u.value as value from (select cluster_id, unnest([
    {{'name': 'device_name', 'value': device_name}}, {{'name': 'source_count', 'value': len(sources)::varchar}}, {{'name': 'sources', 'value': array_to_string(list_sort(sources), ',')}}, {{'name': 'record_count', 'value': record_count::varchar}}]) as u from devices)
  union all select cluster_id, 'values', field, "values" from ({_SQL["consolidated_values"]}) where cluster_id in {_DEV}
  union all select cluster_id, 'truth', field, value || '@' || source || '@' || priority from ({_SQL["sot_resolve"]}) where cluster_id in {_DEV}
  union all select cluster_id, 'agreement', field, verdict from ({_SQL["drift_audit"]}) where cluster_id in {_DEV}
  union all select cluster_id, 'concept', concept, value from ({_SQL["enriched_concepts"]}) where cluster_id in {_DEV}""")(
    lambda s, d: devices.story(R(s, d), D(s, d), table(s, d, "source_systems"), mart_queries._CONCEPTS)
)

query("device_state", """select cluster_id, 'metric' as kind, metric_name as name, arg_max(value, (recorded_at, metric_id)) as value from metrics where value is not null group by cluster_id, metric_name
  union all select cluster_id, 'events', coalesce(nullif(lower(trim(severity)), ''), 'info') as name, count(*)::double from (select distinct on (event_id) * from mesh_events order by event_id, ingested_at desc)
  where ingested_at >= (select max(ingested_at) from mesh_events) - interval 168 hour group by cluster_id, 3""")(lambda s, d: devices.state(table(s, d, "metrics"), feed_queries.events_once(s, d)))

query("cluster_info", "select cluster_id, device_name, len(sources)::bigint as source_count, array_to_string(list_sort(sources), ', ') as sources, " + ", ".join(f"case when {c} is null or lower(trim({c})) in ('', 'nan') then '' else {c} end as {c}" for c in ("serial_number", "mac_address", "manufacturer", "model", "os", "assigned_user", "ip_address")) + ", record_count from devices")(
    lambda s, d: devices.info(D(s, d))
)

_LISTED = "select cluster_id, device_name, source_count from devices where {w} order by source_count desc, cluster_id limit 20"


def _search(name: str, q: str, field: str, where: str) -> None:
    query(name, _LISTED.format(w=where))(lambda s, d: devices.search(D(s, d), q, field).select("cluster_id", "device_name", "source_count"))


_search("search_by_alias", "SRV", "name", "contains(lower(device_name), 'srv')")
_search("search_by_model", "Slate", "model", "contains(lower(model), 'slate')")
_search("search_unknown_field", "kelbrand", "cluster_id", " or ".join(f"contains(lower({c}), 'kelbrand')" for c in ("device_name", "serial_number", "mac_address", "manufacturer", "model", "os", "os_version", "assigned_user", "ip_address", "asset_tag")))

query("clusters_page_total", "select cluster_id, device_name, source_count, record_count, (select count(*) from devices where source_count >= 2) as total from devices where source_count >= 2 order by source_count desc, device_name, cluster_id limit 25 offset 25")(
    lambda s, d: devices.page(D(s, d), 2, 25, 25)
)

query("device_changes", """select cluster_id, source, source_id, field, old_value, new_value, epoch_us(changed_at) as changed_at_us from (select *, row_number() over (partition by cluster_id order by changed_at desc, batch_id desc, source, source_id, field, old_value, new_value) as n
  from field_history where cluster_id is not null) where n <= 100""")(
    lambda s, d: devices.recent_changes(table(s, d, "field_history")).select("cluster_id", "source", "source_id", "field", "old_value", "new_value", feed_queries.us("changed_at"))
)


def attachment_rows(s, d):
    """Attachments of two feeds: texts by the words that name devices, stored records by their id."""
    r = R(s, d)
    keys = attach.keyspace(r)
    docs = table(s, d, "documents").where("text is not null")
    named = attach.fuzzy(docs, "doc_id", keys, attach.reject_words(r), F.col("text"), multi=True).join(docs.select("doc_id", F.substring("text", 1, 500).alias("value")), "doc_id")
    named = named.select("cluster_id", F.col("doc_id").cast("string").alias("source_id"), F.lit("text").alias("field"), "value", "confidence", "token")
    stored = attach.exact(table(s, d, "raw_store").select("source_id").distinct(), keys, F.col("source_id")).select("cluster_id", "source_id", F.lit("source_id").alias("field"), "value", "confidence", F.lit("").alias("token"))
    at = F.lit("2025-12-01").cast("timestamp")
    return attach.attachments("sdp_requests", [named], "token", at).unionByName(attach.attachments("raw_store", [stored], "token", at)).drop("linked_at", "payload")


_ATTACHED = f"""select f.cluster_id, 'sdp_requests' as feed_key, f.doc_id::varchar as source_id, 'text' as field, substr(t.text, 1, 500) as value, 0.9::float as confidence from (select distinct doc_id, cluster_id from {feed_queries._FOUND}) f join documents t using (doc_id)
  union all select cluster_id, 'raw_store', source_id, 'source_id', source_id, 1.0::float from (select distinct source_id, lower(trim(source_id)) as token from raw_store) join {feed_queries._KEYS} using (token) where token <> ''"""
query("device_attachments", _ATTACHED)(attachment_rows)
query("trace_attachments", f"""with a as (select distinct cluster_id, feed_key, value from ({_ATTACHED}) where value <> ''), k as (select feed_key, value from a group by 1, 2 having count(*) between 2 and 50)
  select cluster_id as source, 'value:' || sha256(value) as target, 'attached_' || feed_key as type, feed_key as label from a
  union all select distinct l.cluster_id, r.cluster_id, 'shared_' || l.feed_key, l.feed_key from a l join a r using (feed_key, value) join k using (feed_key, value) where l.cluster_id < r.cluster_id""")(
    lambda s, d: devices.shared_values(attachment_rows(s, d))
)


@query("trace_graph", f"""select source, target, type, label from ({_SQL["trace_edges"]}) union all select source, target, type, label from ({_SQL["trace_attachments"]})
  union all select cluster_id, 'vlan:' || vlan, 'on_vlan', vlan from ({_SQL["vlan_range_join"]})""")  # fmt: skip
def trace_graph(s, d):
    """All edges of the trace: users, shared users, attachments and networks; the trace of a device is what it reaches."""
    vlan = feed_queries.vlan_range_join(s, d).select(F.col("cluster_id").alias("source"), F.concat(F.lit("vlan:"), "vlan").alias("target"), F.lit("on_vlan").alias("type"), F.col("vlan").alias("label"))
    return graph.shared_users(D(s, d)).unionByName(devices.shared_values(attachment_rows(s, d))).unionByName(vlan)


_NAMED = r"regexp_replace(lower(regexp_replace(key, '^(fields|inventory)\.', '')), ' ', '_', 'g')"
_AUTO = f"select distinct {_NAMED} as concept, source, key from {mart_queries._PAIRS}"
_MERGED = f"""select concept, source, key, ord from ({mart_queries._REG}) union all select concept, source, key, 999 + row_number() over (partition by concept order by source, key) as ord from ({_AUTO}) x
  where not exists (select 1 from ({mart_queries._REG}) m where m.concept = x.concept and m.source = x.source)"""


def _manual(s):
    return s.createDataFrame([(c, i, a, k) for c, ps in mart_queries._CONCEPTS for i, (a, k) in enumerate(ps)], "concept string, ord int, source string, key string")


query("registry_found", _AUTO)(lambda s, d: devices.discovered(R(s, d)))
query("registry_merged", _MERGED)(lambda s, d: devices.merged_registry(_manual(s), devices.discovered(R(s, d))))
query("enriched_all", f"""select cluster_id, concept, arg_min(value, ord) as value from (select cluster_id, concept, ord, max(value) as value from
  (select cluster_id, source, key, {mart_queries._VALUE} as value from {mart_queries._PAIRS}) p join ({_MERGED}) g using (source, key) where value <> '' group by 1, 2, 3) group by 1, 2""")(
    lambda s, d: devices.concepts_of(R(s, d), devices.merged_registry(_manual(s), devices.discovered(R(s, d))))
)

_REVIEW = ("singletons", "no_name", "no_serial")


@query("review_report", " union all ".join(f"select '{n}' as kind, cluster_id, device_name as detail from ({_SQL[n]}) {n}_rows" for n in _REVIEW) + f" union all select 'hardware_drift', cluster_id, serial_values from ({_SQL['hardware_drift']}) drift_rows union all select kind, cluster_id, \"values\" from ({_SQL['serial_annotations']}) s_rows")
def review_report(s, d):
    """Everything to look at, in one list."""
    from fleetweave.plans.registry import _QUERIES as q

    out = q["hardware_drift"](s, d).select(F.lit("hardware_drift").alias("kind"), "cluster_id", F.col("serial_values").alias("detail"))
    for n in _REVIEW:
        out = out.unionByName(q[n](s, d).select(F.lit(n).alias("kind"), "cluster_id", F.col("device_name").alias("detail")))
    return out.unionByName(q["serial_annotations"](s, d).select("kind", "cluster_id", F.col("values").alias("detail")))


@query("dashboard_report", f"""select 'kpi' as part, kpi as name, n::varchar as value from ({_SQL["dashboard"]}) a union all select 'coverage', field, coverage from ({_SQL["coverage_kpi"]}) b
  union all select 'source', source, n::varchar from ({_SQL["records_per_source"]}) c union all select 'sources', source_count::varchar, n::varchar from ({_SQL["source_count_dist"]}) e union all select 'combination', combo, n::varchar from ({_SQL["source_combo_dist"]}) f""")  # fmt: skip
def dashboard_report(s, d):
    """The whole dashboard as one table."""
    m = mart_queries
    of = lambda df, part, name, value: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    parts = [of(m.dashboard(s, d), "kpi", "kpi", "n"), of(m.coverage_kpi(s, d), "coverage", "field", "coverage"), of(m.records_per_source(s, d), "source", "source", "n"), of(m.source_count_dist(s, d), "sources", "source_count", "n"), of(m.source_combo_dist(s, d), "combination", "combo", "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


query("health", "select 'ok' as status, 1::bigint as n")(lambda s, d: s.range(1).select(F.lit("ok").alias("status"), (F.col("id") + 1).alias("n")))

_TABLES = ("devices", "field_history", "match_pairs", "mesh_events", "metrics", "raw_store", "source_records", "source_systems")


@query("catalog_columns", f"select table_name, column_name, ordinal_position::bigint as position from information_schema.columns where table_name in ({', '.join(repr(t) for t in _TABLES)})")
def catalog_columns(s, d):
    """Columns of the tables, from their schemas; no data is read."""
    return s.createDataFrame([(t, c, i + 1) for t in _TABLES for i, c in enumerate(table(s, d, t).columns)], "table_name string, column_name string, position long")


@query("human_sizes", "select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars / 1024.0 < 1024 then printf('%.1f KB', n_chars / 1024.0) when n_chars / 1048576.0 < 1024 then printf('%.1f MB', n_chars / 1048576.0) else printf('%.2f GB', n_chars / 1073741824.0) end as size from documents")
def human_sizes(s, d):
    return table(s, d, "documents").select("doc_id", text.human_bytes(F.col("n_chars")).alias("size"))


_LAST_SEEN = "(select max(ingested_at) from mesh_events)"
query("severity_week", f"select coalesce(nullif(lower(trim(severity)), ''), 'info') as severity, count(*) as n from {feed_queries._EVENT} where ingested_at >= {_LAST_SEEN} - interval 168 hour group by 1")(
    lambda s, d: devices.state(table(s, d, "metrics").limit(0), feed_queries.events_once(s, d)).groupBy(F.col("name").alias("severity")).agg(F.sum("value").cast("long").alias("n"))
)

query("names_by_sources", "select name_clean, count(distinct source) as sources, count(*) as n from source_records where name_clean <> '' group by 1 order by sources desc, n desc, name_clean limit 10")(
    lambda s, d: R(s, d).where("name_clean <> ''").groupBy("name_clean", "source").agg(F.count(F.lit(1)).alias("k")).groupBy("name_clean").agg(F.count(F.lit(1)).alias("sources"), F.sum("k").alias("n")).orderBy(F.desc("sources"), F.desc("n"), "name_clean").limit(10)
)

query("join_lists", "select source, source_id, array_to_string(list_filter(list_transform(string_split(coalesce(model, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ', ') as result from source_records")(
    lambda s, d: R(s, d).select("source", "source_id", text.join_list(F.col("model")).alias("result"))
)


@query("labelled_pairs")
def labelled_pairs(s, d):
    """Training pairs of both kinds with their label; a pair is of one kind (tested on a fixture)."""
    good = linking_queries.positives(s, d)
    bad = linking.negative_pairs(linking_queries.keyed(s, d), good)
    return good.select("uid_l", "uid_r", F.lit(1).alias("label")).unionByName(bad.select("uid_l", "uid_r", F.lit(0).alias("label")))


@query("stores_scanned", "select 'devices' as name, count(*) as n from devices union all select 'metrics', count(*) from metrics union all select 'raw_store', count(*) from raw_store")
def stores_scanned(s, d):
    """Rows of the stores that are there; a store that isn't is skipped."""
    out = None
    for n, df in present(s, d, ("devices", "metrics", "no_such_store", "raw_store")).items():
        one = df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
