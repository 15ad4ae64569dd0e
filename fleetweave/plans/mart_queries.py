"""Queries over the mart: consolidation, dashboards, search, quality reports (A-, W-, O-, Q- rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.functions import text
from fleetweave.operators import mart
from fleetweave.plans.registry import query
from fleetweave.plans.scalar import serial_sql
from fleetweave.sources.tables import table

_CONCEPTS = [("purchase_cost", [("sp", "fields.Cost"), ("sdp", "fields.Cost"), ("ad", "fields.Cost")]), ("location", [("zbx", "inventory.location"), ("sdp", "inventory.location"), ("me_ec", "inventory.location")]), ("vendor_contract", [("sp", "fields.Vendor Contract"), ("zbx", "fields.Vendor Contract")]), ("cpu_cores", [("fg", "hw.cpu.cores"), ("fg_dhcp", "hw.cpu.cores"), ("me_ec", "hw.cpu.cores")])]


def R(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_records")


def D(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "devices")


def _in(system: str, expand: bool) -> str:
    names = mart.SYSTEM_SOURCES.get(system, (system,)) if expand else (system,)
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def devices_sql(expand: bool) -> str:
    def pick(f: str) -> str:
        tries = [f"max(case when source in {_in(s, expand)} and {f} <> '' then {f} end)" for s in mart.TRUTH.get(f, ()) if s]
        return "coalesce(" + ", ".join([*tries, f"min(case when {f} <> '' then {f} end)", "''"]) + f") as {f}"

    return f"""select cluster_id, coalesce(min(case when name_clean <> '' then name_clean end), min(case when name <> '' then name end), '(unnamed)') as device_name,
      count(distinct source) as source_count, array_to_string(list_sort(list(distinct source)), ',') as sources, {", ".join(map(pick, mart.DEVICE_FIELDS))}, count(*) as record_count
      from source_records group by cluster_id"""


@query("devices_consolidated", devices_sql(False))
def devices_consolidated(s, d):
    return mart.consolidated(R(s, d)).withColumn("sources", F.array_join("sources", ","))


@query("devices_by_system", devices_sql(True))
def devices_by_system(s, d):
    return mart.consolidated(R(s, d), expand=True).withColumn("sources", F.array_join("sources", ","))


_SEEN = f"""(select cluster_id, source, field, arg_max(value, (source_id, value)) as value from (
  {" union all ".join(f"select cluster_id, source, source_id, '{f}' as field, {f} as value from source_records where {f} <> ''" for f in mart.TRUTH)}) group by all)"""


def truth_sql(expand: bool) -> str:
    arms = " ".join(f"when field = '{f}' and source in {_in(p, expand)} then 0" + (f" when field = '{f}' and source in {_in(q, expand)} then 1" if q else "") for f, (p, q) in mart.TRUTH.items())
    return f"""select cluster_id, field, b.value as value, b.source as source, case b.rank when 0 then 'primary' when 1 then 'secondary' else 'best_effort' end as priority from (
      select cluster_id, field, arg_min({{'value': value, 'source': source, 'rank': rank}}, (rank, -cover, source)) as b from (
        select v.*, coalesce(coverage, 0) as cover, case {arms} else 2 end as rank from {_SEEN} v left join source_systems using (source)) group by 1, 2)"""


query("sot_resolve", truth_sql(False))(lambda s, d: mart.truth(R(s, d), table(s, d, "source_systems")))
query("sot_by_system", truth_sql(True))(lambda s, d: mart.truth(R(s, d), table(s, d, "source_systems"), expand=True))
query("drift_audit", f"""select cluster_id, field, case when count(distinct source) < 2 then 'SINGLE_SOURCE' when count(distinct lower(value)) = 1 then 'MATCH' else 'MISMATCH' end as verdict
  from {_SEEN} group by 1, 2""")(lambda s, d: mart.drift(R(s, d)))  # fmt: skip
query("source_field_map", f"select cluster_id, source, field, value from {_SEEN}")(lambda s, d: mart.source_values(R(s, d), list(mart.TRUTH)).select("cluster_id", "source", "field", "value"))

_GOLD = " union all ".join(f"select cluster_id, '{f}' as field, {f} as golden from devices where {f} <> ''" for f in mart.DEVICE_FIELDS)
query("consolidated_values", f"""with rest as (select cluster_id, field, list(value order by source) as rest from {_SEEN} where field in ({", ".join(f"'{f}'" for f in mart.DEVICE_FIELDS)}) group by 1, 2),
  al as (select cluster_id, field, golden, rest from ({_GOLD}) g full join rest using (cluster_id, field)),
  flat as (select cluster_id, field, v, i from (select cluster_id, field, unnest(coalesce(rest, [])) as v, generate_subscripts(coalesce(rest, []), 1) as i from al) union all select cluster_id, field, golden, 0 from al where golden is not null)
  select cluster_id, field, string_agg(v, ' | ' order by i) as values from (select cluster_id, field, v, min(i) as i from flat group by 1, 2, 3) group by 1, 2""")(lambda s, d: mart.all_values(R(s, d), D(s, d)))  # fmt: skip

query("serial_annotations", f"""with p as (select distinct cluster_id, {serial_sql("serial_number")} as serial from source_records where cluster_id <> ''), q as (select * from p where serial <> '')
  select cluster_id, 'SERIAL_CONFLICT' as kind, string_agg(serial, ', ' order by serial) as values, count(*) as n from q group by cluster_id having count(*) > 1
  union all select '(multiple)', 'SPLIT_IDENTITY', serial, count(*) from q group by serial having count(*) > 1""")(lambda s, d: mart.serial_conflicts(R(s, d)))  # fmt: skip


@query("records_per_source", "select source, count(*) as n, count(distinct cluster_id) as clusters from source_records group by 1")
def records_per_source(s, d):
    one = R(s, d).groupBy("source", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("source").agg(F.sum("n").alias("n"), F.count("cluster_id").alias("clusters"))


@query("source_count_dist", "select source_count, count(*) as n from devices group by 1")
def source_count_dist(s, d):
    return D(s, d).groupBy("source_count").agg(F.count(F.lit(1)).alias("n"))


@query("source_combo_dist", "select '[' || array_to_string(list_sort(sources), ', ') || ']' as combo, count(*) as n from devices group by 1 order by n desc, combo limit 20")
def source_combo_dist(s, d):
    return D(s, d).groupBy(text.sql_list_text(F.sort_array("sources")).alias("combo")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combo").limit(20)


_COVER = ("serial_number", "mac_address", "assigned_user", "ip_address", "os")


@query("coverage_kpi", " union all ".join(f"select '{f}' as field, count_if({f} <> '') || '/' || count(*) || ' (' || (count_if({f} <> '') * 100 // greatest(count(*), 1)) || '%)' as coverage from devices" for f in _COVER))
def coverage_kpi(s, d):
    """All fields from one scan, then turned into rows."""
    one = D(s, d).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(mart.full(f)).alias(f) for f in _COVER))
    each = F.array(*(F.struct(F.lit(f).alias("field"), text.coverage_text(F.col(f), F.col("total")).alias("coverage")) for f in _COVER))
    return one.select(F.explode(each).alias("x")).select("x.*")


@query("dashboard", """select 'devices' as kpi, count(*) as n from devices union all select 'multi_source', count(*) from devices where source_count > 1
  union all select 'single_source', count(*) from devices where source_count = 1 union all select 'three_or_more', count(*) from devices where source_count >= 3
  union all select 'unnamed', count(*) from devices where device_name = '(unnamed)' union all select 'no_serial', count(*) from devices where serial_number = ''
  union all select 'records', coalesce(sum(record_count), 0)::bigint from devices""")  # fmt: skip
def dashboard(s, d):
    c = lambda cond: F.count_if(F.expr(cond))
    one = D(s, d).agg(F.count(F.lit(1)).alias("devices"), c("source_count > 1").alias("multi_source"), c("source_count = 1").alias("single_source"), c("source_count >= 3").alias("three_or_more"), c("device_name = '(unnamed)'").alias("unnamed"), c("serial_number = ''").alias("no_serial"), F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("records"))
    return one.unpivot([], one.columns, "kpi", "n")


@query("mesh_stats", """select 'records' as stat, count(*) as n from source_records union all select 'clusters', count(distinct cluster_id) from source_records
  union all select 'devices', count(*) from devices union all select 'metrics', count(*) from metrics union all select 'events', count(*) from mesh_events union all select 'history', count(*) from field_history""")  # fmt: skip
def mesh_stats(s, d):
    count = lambda df, name: df.agg(F.lit(name).alias("stat"), F.count(F.lit(1)).alias("n"))
    clusters = R(s, d).select("cluster_id").distinct()
    parts = [(R(s, d), "records"), (clusters, "clusters"), (D(s, d), "devices"), (table(s, d, "metrics"), "metrics"), (table(s, d, "mesh_events"), "events"), (table(s, d, "field_history"), "history")]
    out = count(*parts[0])
    for p in parts[1:]:
        out = out.unionByName(count(*p))
    return out


_TOP = ["cluster_id", "device_name", "source_count", "record_count"]


@query("top_clusters", "select cluster_id, device_name, source_count, record_count from devices order by source_count desc, record_count desc, cluster_id limit 10")
def top_clusters(s, d):
    return D(s, d).select(*_TOP).orderBy(F.desc("source_count"), F.desc("record_count"), "cluster_id").limit(10)


@query("clusters_page", "select cluster_id, device_name, source_count, record_count from devices where source_count >= 2 and list_contains(sources, 'sp') order by source_count desc, device_name, cluster_id limit 50 offset 50")
def clusters_page(s, d):
    rows = D(s, d).where((F.col("source_count") >= 2) & F.array_contains("sources", "sp")).select(*_TOP)
    return rows.orderBy(F.desc("source_count"), "device_name", "cluster_id").offset(50).limit(50)


@query("search_field", "select cluster_id, device_name, source_count, record_count from devices where contains(lower(assigned_user), 'vexley') order by source_count desc, cluster_id limit 100")
def search_field(s, d):
    return D(s, d).where(F.lower("assigned_user").contains("vexley")).select(*_TOP).orderBy(F.desc("source_count"), "cluster_id").limit(100)


_TEN = ("device_name", "serial_number", "mac_address", "manufacturer", "model", "os", "asset_tag", "assigned_user", "ip_address", "imei")


@query("search_fulltext", f"select cluster_id, device_name, source_count, record_count from devices where {' or '.join(f'''contains(lower({c}), 'sw')''' for c in _TEN)} order by source_count desc, cluster_id limit 100")
def search_fulltext(s, d):
    hit = F.lit(False)
    for c in _TEN:
        hit = hit | F.lower(c).contains("sw")
    return D(s, d).where(hit).select(*_TOP).orderBy(F.desc("source_count"), "cluster_id").limit(100)


_ASK = """select case (r.raw_id // 50) % 6 when 0 then s.cluster_id when 1 then s.name_clean when 2 then s.serial_number when 3 then s.mac_address when 4 then s.ip_address else s.assigned_user end as query
  from raw_store r join source_records s using (source, source_id) where r.raw_id % 50 = 0"""


def asked(s, d) -> DataFrame:
    """The query set of look-ups: a value of the record of every raw_id divisible by 50."""
    raw = table(s, d, "raw_store").where("raw_id % 50 = 0").select("raw_id", "source", "source_id")
    j = raw.join(R(s, d), ["source", "source_id"])
    turn = F.call_function("div", F.col("raw_id"), F.lit(50).cast("long")) % 6
    pick = F.when(turn == 0, F.col("cluster_id")).when(turn == 1, F.col("name_clean")).when(turn == 2, F.col("serial_number")).when(turn == 3, F.col("mac_address")).when(turn == 4, F.col("ip_address")).otherwise(F.col("assigned_user"))
    return j.select(pick.alias("query"))


_WHOLE = " || chr(1) || ".join(f"coalesce({c}, '')" for c in mart.FULL_TEXT)


@query("lookup_cascade", rf"""with q as (select distinct query, lower(trim(query)) as low, regexp_replace(lower(query), '[^0-9a-f]', '', 'g') as hex from ({_ASK})),
  dev as (select *, regexp_replace(lower(mac_address), '[^0-9a-f]', '', 'g') as m from devices),
  sure as (select query, cluster_id, source_count, 1 as step from q join dev on low = cluster_id union all select query, cluster_id, source_count, 2 from q join dev on low = lower(device_name)
    union all select query, cluster_id, source_count, 3 from q join dev on low = lower(serial_number) union all select query, cluster_id, source_count, 4 from q join dev on hex = m and length(hex) = 12
    union all select query, s.cluster_id, source_count, 4 from q join source_records s on hex = mac_clean and length(hex) = 12 join devices d on d.cluster_id = s.cluster_id),
  lft as (select * from q where low <> '' and query not in (select query from sure)),
  maybe as (select query, cluster_id, source_count, 5 as step from lft join dev on contains(lower(ip_address), low) union all select query, cluster_id, source_count, 6 from lft join dev on contains(lower(assigned_user), low)
    union all select query, s.cluster_id, source_count, 7 from lft join source_records s on contains(lower({_WHOLE}), low) join devices d on d.cluster_id = s.cluster_id)
  select query, b.c as cluster_id, b.s as step from (select query, arg_min({{'c': cluster_id, 's': step}}, (step, -source_count, cluster_id)) as b from (select * from sure union all select * from maybe) group by 1)""")
def lookup_cascade(s, d):
    return mart.lookup(asked(s, d), D(s, d), R(s, d))


def _review(name: str, cond: str, order: str, n: int) -> None:
    @query(name, f"select cluster_id, device_name, source_count from devices where {cond} order by {order} limit {n}")
    def run(s, d):
        keys = [F.desc(k.split()[0]) if k.endswith("desc") else F.col(k) for k in order.split(", ")]
        return D(s, d).where(cond).select("cluster_id", "device_name", "source_count").orderBy(*keys).limit(n)


_review("singletons", "source_count = 1", "device_name, cluster_id", 50)
_review("no_name", "device_name = '(unnamed)'", "cluster_id", 20)
_review("no_serial", "serial_number = ''", "source_count desc, cluster_id", 30)


@query("hardware_drift", """select cluster_id, count(distinct serial_number) as serials, string_agg(distinct serial_number, ', ' order by serial_number) as serial_values, string_agg(distinct source, ', ' order by source) as sources
  from source_records where serial_number <> '' and cluster_id <> '' group by 1 having count(distinct serial_number) > 1 order by serials desc, cluster_id limit 30""")  # fmt: skip
def hardware_drift(s, d):
    rows = R(s, d).where("serial_number <> '' and cluster_id <> ''").select("cluster_id", "serial_number", "source").distinct()
    out = rows.groupBy("cluster_id").agg(F.sort_array(F.collect_set("serial_number")).alias("v"), F.sort_array(F.collect_set("source")).alias("s"))
    out = out.select("cluster_id", F.size("v").cast("long").alias("serials"), F.array_join("v", ", ").alias("serial_values"), F.array_join("s", ", ").alias("sources"))
    return out.where("serials > 1").orderBy(F.desc("serials"), "cluster_id").limit(30)


@query("review_count", "select count(*) as n from (select cluster_id from source_records where serial_number <> '' and cluster_id <> '' group by 1 having count(distinct serial_number) > 1)")
def review_count(s, d):
    rows = R(s, d).where("serial_number <> '' and cluster_id <> ''").select("cluster_id", "serial_number").distinct()
    return rows.groupBy("cluster_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))


@query("zombies", """select cluster_id, epoch_us(max(fetched_at)) as last_seen_us from source_records group by 1
  having max(fetched_at) < (select max(fetched_at) from source_records) - interval 20 day""")  # fmt: skip
def zombies(s, d):
    """Clusters not fetched for 20 days before the newest record (the window is a parameter; a fixed date keeps results alike)."""
    newest = R(s, d).agg(F.max("fetched_at").alias("as_of"))
    last = R(s, d).groupBy("cluster_id").agg(F.max("fetched_at").alias("last"))
    return last.where(F.col("last") < newest.scalar() - F.expr("interval 20 days")).select("cluster_id", F.unix_micros(F.col("last").cast("timestamp")).alias("last_seen_us"))


_PAIRS = """(select cluster_id, source, source_id, unnest(json_keys(e)) as key, e from (select *, case when json_valid(extra_attributes) then extra_attributes end as e from source_records) where e is not null and json_type(e) = 'OBJECT')"""
_VALUE = """json_extract_string(e, '/' || replace(replace(key, '~', '~0'), '/', '~1'))"""

query("extra_keys", f"select distinct key from {_PAIRS}")(lambda s, d: mart.extra_pairs(R(s, d)).select("key").distinct())
query("unmapped_fields", f"select source, key as field, count(*) as n from {_PAIRS} group by 1, 2 order by n desc, source, field limit 100")(
    lambda s, d: mart.extra_pairs(R(s, d)).groupBy("source", F.col("key").alias("field")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "field").limit(100)
)
query("extra_long", f"select cluster_id, source, source_id, key, {_VALUE} as value from {_PAIRS}")(lambda s, d: mart.extra_pairs(R(s, d)))
_WIDE = ("fields.Cost", "inventory.location", "hw.cpu.cores")
query("extra_wide", "select source, source_id, " + ", ".join(f"""max(case when key = '{k}' then {_VALUE} end) as "{k.replace(".", "_")}" """ for k in _WIDE) + f" from {_PAIRS} group by 1, 2")(
    lambda s, d: mart.extra_pairs(R(s, d)).groupBy("source", "source_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(".", "_")) for k in _WIDE))
)
_REG = " union all ".join(f"select '{c}' as concept, {i} as ord, '{s}' as source, '{k}' as key" for c, ps in _CONCEPTS for i, (s, k) in enumerate(ps))
query("enriched_concepts", f"""select cluster_id, concept, arg_min(value, ord) as value from (select cluster_id, concept, ord, max(value) as value from
  (select cluster_id, source, key, {_VALUE} as value from {_PAIRS}) p join ({_REG}) g using (source, key) where value <> '' group by 1, 2, 3) group by 1, 2""")(lambda s, d: mart.concepts(R(s, d), _CONCEPTS))  # fmt: skip


@query("key_fill", f"""with n as (select source, count(*) as total from source_records where extra_attributes <> '' group by 1),
  k as (select source, key, count_if({_VALUE} <> '') as filled, list(distinct {_VALUE} order by {_VALUE}) as vals from {_PAIRS} group by 1, 2)
  select source, key, filled, round(100.0 * filled / total, 2) as fill_pct, array_to_string(vals[1:4], ' | ') as samples from k join n using (source)""")
def key_fill(s, d):
    """Share of filled values per raw key, with the four smallest samples (kept by a bounded aggregate)."""
    rows = R(s, d).where("extra_attributes <> ''")
    total = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    pairs = mart.extra_pairs(rows)
    keys = pairs.groupBy("source", "key").agg(F.count_if(F.col("value") != "").alias("filled"))
    vals = mart.top_per(pairs.select("source", "key", "value").where("value is not null").distinct(), ["source", "key"], [F.col("value")], 4)
    samples = vals.groupBy("source", "key").agg(F.array_join(F.sort_array(F.collect_list("value")), " | ").alias("samples"))
    return keys.join(samples, ["source", "key"], "left").join(F.broadcast(total), "source").select("source", "key", "filled", F.round(100.0 * F.col("filled") / F.col("total"), 2).alias("fill_pct"), "samples")


_BASE = ("name", "serial_number", "mac_address", "asset_tag", "manufacturer", "model", "os", "assigned_user", "ip_address", "imei")


@query("fill_rate_baseline", " union all ".join(f"select source, '{f}' as field, round(100.0 * count_if({f} <> '') / count(*), 1) as pct from source_records group by 1" for f in _BASE))
def fill_rate_baseline(s, d):
    one = R(s, d).groupBy("source").agg(*(F.round(100.0 * F.count_if(mart.full(f)) / F.count(F.lit(1)), 1).alias(f) for f in _BASE))
    return one.unpivot(["source"], list(_BASE), "field", "pct")


@query("export_coverage", "select " + ", ".join(f"count_if({f} <> '') * 100 // greatest(count(*), 1) as {f}" for f in _COVER) + " from source_records")
def export_coverage(s, d):
    n = F.greatest(F.count(F.lit(1)), F.lit(1).cast("long"))
    return R(s, d).agg(*(F.call_function("div", F.count_if(mart.full(f)) * 100, n).alias(f) for f in _COVER))


@query("rollup_source_family", "select source, os_family, count(*) as n, grouping(source)::bigint * 2 + grouping(os_family)::bigint as level from source_records group by rollup (source, os_family)")
def rollup_source_family(s, d):
    return R(s, d).rollup("source", "os_family").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))
