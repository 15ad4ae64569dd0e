"""Queries of time series, histories, attachments, change capture and graphs (Q-11 to Q-19, W, ST, ER-16 to ER-22, J rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetweave.functions import text
from fleetweave.operators import attach, capture, graph, mart
from fleetweave.plans.registry import query
from fleetweave.plans.scalar import mac_sql, tokens_sql
from fleetweave.sources.tables import table, utc_micros


def Mx(s, d):
    return table(s, d, "metrics")


def us(c: str):
    return utc_micros(c).alias(f"{c}_us")


_ONE = "(select distinct on (metric_id) * from metrics order by metric_id, ingested_at desc)"


def delivered_once(s, d):
    """Readings delivered again count once, as delivered last."""
    cols = ["cluster_id", "source", "metric_name", "value", "text_value", "recorded_at", "ingested_at"]
    return capture.last_wins(Mx(s, d).select("metric_id", *cols), ["metric_id"], ["ingested_at"])


@query("metric_names", "select distinct cluster_id, metric_name from metrics")
def metric_names(s, d):
    return Mx(s, d).select("cluster_id", "metric_name").distinct()


@query("metric_summary", "select cluster_id, metric_name, round(avg(value), 2) as avg_value, round(max(value), 2) as max_value, round(min(value), 2) as min_value, count(value) as n, round(arg_max(value, (recorded_at, metric_id)), 2) as latest from metrics where value is not null group by 1, 2")
def metric_summary(s, d):
    return Mx(s, d).where("value is not null").groupBy("cluster_id", "metric_name").agg(F.round(F.avg("value"), 2).alias("avg_value"), F.round(F.max("value"), 2).alias("max_value"), F.round(F.min("value"), 2).alias("min_value"), F.count("value").alias("n"), F.round(F.max_by("value", F.struct("recorded_at", "metric_id")), 2).alias("latest"))


@query("metric_latest", "select distinct on (cluster_id, metric_name) cluster_id, metric_name, source, value, epoch_us(recorded_at) as recorded_at_us from metrics where value is not null order by cluster_id, metric_name, recorded_at desc, metric_id desc")
def metric_latest(s, d):
    best = F.max_by(F.struct("source", "value", "recorded_at"), F.struct("recorded_at", "metric_id"))
    return Mx(s, d).where("value is not null").groupBy("cluster_id", "metric_name").agg(best.alias("b")).select("cluster_id", "metric_name", "b.source", "b.value", utc_micros(F.col("b.recorded_at")).alias("recorded_at_us"))


@query("metrics_delivered_once", f"select metric_id, cluster_id, value, epoch_us(ingested_at) as ingested_at_us from {_ONE}")
def metrics_delivered_once(s, d):
    return delivered_once(s, d).select("metric_id", "cluster_id", "value", us("ingested_at"))


@query("device_metrics", """select metric_id, metric_name, value, epoch_us(recorded_at) as recorded_at_us from metrics where cluster_id = 'c-000051ed27' and metric_name like 'Interface%' and source = 'zbx'
  and recorded_at >= (select max(recorded_at) from metrics where cluster_id = 'c-000051ed27') - interval 24 hour order by recorded_at desc, metric_id, ingested_at limit 500""")  # fmt: skip
def device_metrics(s, d):
    """The last 24 hours of one device's interfaces, newest first; 500 rows are the feature."""
    mine = Mx(s, d).where("cluster_id = 'c-000051ed27'")
    newest = mine.agg(F.max("recorded_at").alias("t"))
    rows = mine.where("metric_name like 'Interface%' and source = 'zbx'").where(F.col("recorded_at") >= newest.scalar() - F.expr("interval 24 hours"))
    return rows.orderBy(F.desc("recorded_at"), "metric_id", "ingested_at").limit(500).select("metric_id", "metric_name", "value", us("recorded_at"))


@query("metric_hourly", "select cluster_id, metric_name, epoch_us(date_trunc('hour', recorded_at)) as hour_us, count(*) as n, round(max(value), 4) as max_value from metrics where value is not null group by 1, 2, 3")
def metric_hourly(s, d):
    hour = F.date_trunc("hour", "recorded_at")
    return Mx(s, d).where("value is not null").groupBy("cluster_id", "metric_name", utc_micros(hour).alias("hour_us")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("max_value"))


@query("metric_buckets", "with b(le) as (values (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0)) select le, count(*) as n from b join metrics on source = 'fg' and metric_name = 'ping_ms' and value <= le group by 1")
def metric_buckets(s, d):
    """Cumulative histogram of response times, all buckets from one scan."""
    les = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
    one = Mx(s, d).where("source = 'fg' and metric_name = 'ping_ms'").agg(*(F.count_if(F.col("value") <= b).alias(str(i)) for i, b in enumerate(les)))
    each = F.array(*(F.struct(F.lit(b).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(les)))
    return one.select(F.explode(each).alias("x")).select("x.*").where("n > 0")


@query("latency_stats", "select source, round(min(value), 4) as min_ms, round(max(value), 4) as max_ms, round(avg(value), 4) as avg_ms, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_disc(value, 0.95), 4) as p95, round(stddev_samp(value), 4) as stdev from metrics where metric_name = 'ping_ms' and value is not null group by 1")
def latency_stats(s, d):
    """Exact quantiles by value counts: `percentile` keeps one counter per distinct value, merged over tasks."""
    return Mx(s, d).where("metric_name = 'ping_ms' and value is not null").groupBy("source").agg(F.round(F.min("value"), 4).alias("min_ms"), F.round(F.max("value"), 4).alias("max_ms"), F.round(F.avg("value"), 4).alias("avg_ms"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.expr("percentile_disc(0.95) within group (order by value)"), 4).alias("p95"), F.round(F.stddev_samp("value"), 4).alias("stdev"))


_EVENT = "(select distinct on (event_id) * from mesh_events order by event_id, ingested_at desc)"


def events_once(s, d):
    return capture.last_wins(table(s, d, "mesh_events"), ["event_id"], ["ingested_at"])


@query("events_delivered_once", f"select event_id, cluster_id, event_type, severity, epoch_us(ingested_at) as ingested_at_us from {_EVENT}")
def events_delivered_once(s, d):
    return events_once(s, d).select("event_id", "cluster_id", "event_type", "severity", us("ingested_at"))


@query("severity_counts", f"select cluster_id, coalesce(nullif(lower(trim(severity)), ''), 'info') as severity, count(*) as n from {_EVENT} group by 1, 2")
def severity_counts(s, d):
    sev = F.coalesce(F.nullif(F.lower(F.trim("severity")), F.lit("")), F.lit("info"))
    return events_once(s, d).groupBy("cluster_id", sev.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("timeline", f"select event_id, event_type, detail, epoch_us(ingested_at) as ingested_at_us from {_EVENT} where cluster_id = 'c-000051ed27' and ingested_at >= (select max(ingested_at) from mesh_events where cluster_id = 'c-000051ed27') - interval 168 hour order by ingested_at desc, event_id limit 100")
def timeline(s, d):
    mine = table(s, d, "mesh_events").where("cluster_id = 'c-000051ed27'")
    newest = mine.agg(F.max("ingested_at").alias("t"))
    rows = capture.last_wins(mine, ["event_id"], ["ingested_at"]).where(F.col("ingested_at") >= newest.scalar() - F.expr("interval 168 hours"))
    return rows.orderBy(F.desc("ingested_at"), "event_id").limit(100).select("event_id", "event_type", "detail", us("ingested_at"))


@query("event_windows", "select event_type, epoch_us(time_bucket(interval 5 minute, ts, timestamp '1970-01-01')) as start_us, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(s, d):
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    return table(s, d, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total")


@query("event_sessions", """select user_id, epoch_us(min(ts)) as start_us, count(*) as n from (select *, sum(b) over (partition by user_id order by ts) as g from (
  select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as b from events)) group by user_id, g""")  # fmt: skip
def event_sessions(s, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    return table(s, d, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("history_latest", "select source, source_id, field, old_value, new_value, epoch_us(changed_at) as changed_at_us, batch_id from field_history order by changed_at desc, batch_id desc, source, source_id, field, old_value, new_value limit 100")
def history_latest(s, d):
    cols = ["source", "source_id", "field", "old_value", "new_value"]
    rows = table(s, d, "field_history").orderBy(F.desc("changed_at"), F.desc("batch_id"), "source", "source_id", "field", F.asc_nulls_last("old_value"), F.asc_nulls_last("new_value"))
    return rows.limit(100).select(*cols, us("changed_at"), "batch_id")


@query("history_clusters", """select h.source, h.source_id, field, coalesce(h.cluster_id, r.cluster_id) as cluster_id, count(*) as n from field_history h left join source_systems y on y.feed_key = h.source
  left join (select source, source_id, min(cluster_id) as cluster_id from source_records group by 1, 2) r on r.source = y.source and r.source_id = h.source_id group by all""")  # fmt: skip
def history_clusters(s, d):
    """Changes with the cluster of their record; the log names the feed, records name the source."""
    feeds = F.broadcast(table(s, d, "source_systems").select("feed_key", F.col("source").alias("_src")))  # one row per source
    recs = table(s, d, "source_records").groupBy(F.col("source").alias("_src"), "source_id").agg(F.min("cluster_id").alias("_c"))
    h = table(s, d, "field_history").groupBy("source", "source_id", "field", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    j = h.join(feeds, h["source"] == feeds["feed_key"], "left").join(recs, ["_src", "source_id"], "left")
    return j.groupBy("source", "source_id", "field", F.coalesce("cluster_id", "_c").alias("cluster_id")).agg(F.sum("n").alias("n"))


@query("history_kept", "select count(*) as n, epoch_us(min(changed_at)) as first_us from field_history where changed_at >= (select max(changed_at) from field_history) - interval 180 day")
def history_kept(s, d):
    h = table(s, d, "field_history")
    newest = h.agg(F.max("changed_at").alias("t"))
    return capture.kept(h, "changed_at", newest.scalar()).agg(F.count(F.lit(1)).alias("n"), utc_micros(F.min("changed_at")).alias("first_us"))


_LAST = "(select distinct on (source, source_id) * from raw_store order by source, source_id, fetched_at desc, raw_id desc)"


@query("last_wins_dedup", f"select source, source_id, raw_id, raw_hash from {_LAST}")
def last_wins_dedup(s, d):
    rows = table(s, d, "raw_store").select("source", "source_id", "raw_id", "raw_hash", "fetched_at")
    return capture.last_wins(rows, ["source", "source_id"], ["fetched_at", "raw_id"]).drop("fetched_at")


def _halves(s, d):
    """Two states of the raw store: rows of even ids as they were, rows of odd ids as they come in."""
    raw = table(s, d, "raw_store").select(F.concat_ws("::", "source", "source_id").alias("id"), "raw_id", "raw_json", "raw_hash", "fetched_at")
    return (capture.last_wins(raw.where(F.col("raw_id") % 2 == k), ["id"], ["fetched_at", "raw_id"]) for k in (0, 1))


_HALF = "(select distinct on (source, source_id) source || '::' || source_id as id, raw_id, raw_json, raw_hash from raw_store where raw_id % 2 = {k} order by source, source_id, fetched_at desc, raw_id desc)"
_OLD, _NEW = _HALF.format(k=0), _HALF.format(k=1)


@query("upsert_actions", f"select coalesce(o.id, n.id) as id, case when o.id is null then 'insert' when n.id is null then 'keep' when o.raw_hash = n.raw_hash then 'skip' else 'update' end as action from {_OLD} o full join {_NEW} n on o.id = n.id")
def upsert_actions(s, d):
    old, new = _halves(s, d)
    return capture.upsert(old, new, "id", "raw_hash")


@query("upsert_merge", f"select coalesce(n.id, o.id) as id, case when n.id is not null and (o.id is null or o.raw_hash <> n.raw_hash) then n.raw_id else o.raw_id end as raw_id from {_OLD} o full join {_NEW} n on o.id = n.id")
def upsert_merge(s, d):
    old, new = _halves(s, d)
    return capture.merged(old, new, "id", "raw_hash").select("id", "raw_id")


@query("field_history_diff")
def field_history_diff(s, d):
    """Fields that differ between the two states (tested against brute force; nested keys aren't for SQL)."""
    old, new = _halves(s, d)
    return capture.field_changes(old, new, "id", "raw_json")


_KEYS = "(select token, min(cluster_id) as cluster_id from (" + " union all ".join(f"select cluster_id, lower(trim({c})) as token from source_records where cluster_id <> ''" for c in attach.KEY_COLUMNS) + ") where token <> '' group by 1)"
_REJECT = "(select unnest([" + ", ".join(f"'{w}'" for w in attach.REJECT_WORDS) + "]) as token union select lower(manufacturer) from source_records union select lower(os) from source_records)"

query("keyspace", f"select token, cluster_id from {_KEYS}")(lambda s, d: attach.keyspace(table(s, d, "source_records")))
query("reject_words", f"select token from {_REJECT} where token <> ''")(lambda s, d: attach.reject_words(table(s, d, "source_records")))


@query("attach_exact", f"select raw_id, cluster_id, 1.0::double as confidence from (select distinct raw_id, lower(trim(source_id)) as token from raw_store) join {_KEYS} using (token)")
def attach_exact(s, d):
    rows = table(s, d, "raw_store").select("raw_id", "source_id").distinct()
    return attach.exact(rows, attach.keyspace(table(s, d, "source_records")), F.col("source_id")).select("raw_id", "cluster_id", "confidence")


@query("attach_normalized", f"select distinct raw_id, cluster_id, 1.0::double as confidence from (select raw_id, {mac_sql('source_id')} as token from raw_store) join {_KEYS} using (token) where token <> ''")
def attach_normalized(s, d):
    rows = table(s, d, "raw_store").select("raw_id", "source_id").distinct()
    return attach.exact(rows, attach.keyspace(table(s, d, "source_records")), F.col("source_id"), text.normalize_mac).select("raw_id", "cluster_id", "confidence")


_WORDS = f"(select doc_id, w[i] as token, i - 1 as pos from (select doc_id, {tokens_sql('text')} as w from documents) q, lateral (select unnest(generate_series(1, len(w))) as i))"
_FOUND = f"(select doc_id, pos, token, cluster_id from {_WORDS} join {_KEYS} using (token) where token not in (select token from {_REJECT} where token is not null))"


@query("attach_fuzzy", f"select doc_id, cluster_id, arg_min(token, (pos, token)) as token, 0.9::double as confidence from {_FOUND} group by 1, 2")
def attach_fuzzy(s, d):
    """Every cluster named by a word of a document."""
    r = table(s, d, "source_records")
    return attach.fuzzy(table(s, d, "documents"), "doc_id", attach.keyspace(r), attach.reject_words(r), F.col("text"), multi=True)


@query("attach_longest", f"select doc_id, b.c as cluster_id, b.t as token, 0.9::double as confidence from (select doc_id, arg_max({{'c': cluster_id, 't': token}}, (length(token), -pos)) as b from {_FOUND} group by 1)")
def attach_longest(s, d):
    r = table(s, d, "source_records")
    return attach.fuzzy(table(s, d, "documents"), "doc_id", attach.keyspace(r), attach.reject_words(r), F.col("text"), multi=False)


@query("vlan_range_join", """with v as (select distinct '10.' || (b // 4) * 4 || '.0.0/14' as vlan, 167772160 + ((b // 4) * 4) * 65536 as lo, 167772160 + ((b // 4) * 4 + 4) * 65536 - 1 as hi
    from (select try_cast(split_part(ip_address, '.', 2) as int) as b from source_records where starts_with(ip_address, '10.')) where b is not null),
  p as (select cluster_id, ((split_part(ip_address, '.', 1)::bigint * 256 + split_part(ip_address, '.', 2)::bigint) * 256 + split_part(ip_address, '.', 3)::bigint) * 256 + split_part(ip_address, '.', 4)::bigint as ip
    from devices where regexp_full_match(ip_address, '\\d+\\.\\d+\\.\\d+\\.\\d+')) select cluster_id, vlan from p join v on ip between lo and hi""".replace("\\\\", "\\"))  # fmt: skip
def vlan_range_join(s, d):
    """Devices in networks of four /16 blocks each."""
    ip = table(s, d, "source_records").where("ip_address like '10.%'").select(F.split("ip_address", r"\.")[1].try_cast("int").alias("b")).where("b is not null")
    vlans = ip.select(F.concat(F.lit("10."), (F.floor(F.col("b") / 4) * 4).cast("string"), F.lit(".0.0/14")).alias("vlan")).distinct()
    return graph.in_networks(table(s, d, "devices").select("cluster_id", "ip_address"), "ip_address", vlans, "vlan").select("cluster_id", "vlan")


query("trace_nodes", """select cluster_id as id, 'device' as type, device_name as label from devices union all select distinct 'user:' || lower(assigned_user), 'user', lower(assigned_user) from devices where assigned_user <> ''""")(lambda s, d: graph.nodes(table(s, d, "devices")))
query("trace_edges", """with d as (select cluster_id, lower(assigned_user) as u from devices where assigned_user <> ''), k as (select u from d group by 1 having count(*) between 2 and 50)
  select cluster_id as source, 'user:' || u as target, 'assigned_to' as type, u as label from d union all
  select a.cluster_id, b.cluster_id, 'shared_user', a.u from d a join d b on a.u = b.u and a.cluster_id < b.cluster_id where a.u in (select u from k)""")(lambda s, d: graph.shared_users(table(s, d, "devices")))  # fmt: skip


@query("shared_attachment", f"select doc_id, count(distinct cluster_id) as clusters from {_FOUND} group by 1 having count(distinct cluster_id) > 1")
def shared_attachment(s, d):
    """Documents that tie several clusters together."""
    return attach_fuzzy(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("clusters")).where("clusters > 1")


@query("cluster_stats", f"""select c.cluster_id, coalesce(m.n, 0) as metrics, coalesce(e.n, 0) as events, coalesce(h.n, 0) as changes from (select cluster_id from devices) c
  left join (select cluster_id, count(*) as n from metrics group by 1) m using (cluster_id) left join (select cluster_id, count(*) as n from {_EVENT} group by 1) e using (cluster_id)
  left join (select cluster_id, count(*) as n from field_history group by 1) h using (cluster_id)""")
def cluster_stats(s, d):
    """Volumes per device; each side is aggregated before it is joined."""
    n = lambda df, name: df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(name))
    out = table(s, d, "devices").select("cluster_id")
    for df, name in ((Mx(s, d), "metrics"), (events_once(s, d), "events"), (table(s, d, "field_history").where("cluster_id is not null"), "changes")):
        out = out.join(n(df, name), "cluster_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


@query("record_freshness", "select source, source_id, epoch_us(max(fetched_at)) as fetched_at_us from raw_store group by 1, 2")
def record_freshness(s, d):
    return table(s, d, "raw_store").groupBy("source", "source_id").agg(utc_micros(F.max("fetched_at")).alias("fetched_at_us"))


@query("top_metric_per_device", "select cluster_id, metric_name, n from (select *, row_number() over (partition by cluster_id order by n desc, metric_name) as k from (select cluster_id, metric_name, count(*) as n from metrics group by 1, 2)) where k <= 3")
def top_metric_per_device(s, d):
    counts = Mx(s, d).groupBy("cluster_id", "metric_name").agg(F.count(F.lit(1)).alias("n"))
    return mart.top_per(counts, ["cluster_id"], [F.desc("n"), F.col("metric_name")], 3)
