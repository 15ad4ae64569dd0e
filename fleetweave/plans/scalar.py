"""Queries of scalar functions over whole tables (F-01 to F-31, P-20, P-21, J-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.functions import net, similarity, text
from fleetweave.plans.registry import query
from fleetweave.sources.tables import table

_TRIM = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SENTINELS = "'', 'null', 'None', 'none', 'n/a', 'N/A', '--', '-'"


def trim_sql(c: str) -> str:
    return _TRIM.format(c=c)


def strip_sql(c: str) -> str:
    return f"(case when {c} is null or {trim_sql(c)} in ({_SENTINELS}) then '' else {trim_sql(c)} end)"


def name_sql(c: str) -> str:
    label = f"split_part(lower({strip_sql(c)}), '.', 1)"
    return trim_sql(rf"regexp_replace({label}, '\s*\(\d{{10,}}\)$', '')")


def mac_sql(c: str) -> str:
    one = r"lower(regexp_replace(x, '[:\-,.\s]', '', 'g'))"
    ok = r"regexp_full_match(x, '[0-9a-f]{12}') and not regexp_full_match(x, '0+')"
    return f"coalesce(list_filter(list_transform(string_split({strip_sql(c)}, ','), lambda x: {one}), lambda x: {ok})[1], '')"


def serial_sql(c: str) -> str:
    bare = trim_sql(rf"regexp_replace({strip_sql(c)}, '^(SN[-:]|S/N[:]?|SVC[-]|PC[-]|CND[-]|CN[-])\s*', '', 'i')")
    return rf"(case when regexp_full_match({strip_sql(c)}, '\d{{4}}(-\d{{4}}){{5}}-\d{{2}}') then '' else {bare} end)"


def family_sql(c: str) -> str:
    low = f"lower({strip_sql(c)})"
    return f"""(case when {low} = '' then '' when contains({low}, 'windows') or contains({low}, 'microsoft windows') then 'windows'
      when contains({low}, 'macos') or contains({low}, 'mac os') or contains({low}, 'os x') or contains({low}, 'darwin') then 'macos'
      when contains({low}, 'ios') or contains({low}, 'ipados') then 'ios' when contains({low}, 'android') then 'android'
      when regexp_matches({low}, 'ubuntu|debian|centos|rhel|red hat|fedora|suse|linux') then 'linux' else {low} end)"""


def class_sql(c: str) -> str:
    v = trim_sql(f"coalesce({c}, '')")
    return rf"""(case when {v} = '' or {c} in ({_SENTINELS}) then 'none'
      when regexp_full_match({v}, '([0-9A-Fa-f]{{2}}[:.\s\-]){{5}}[0-9A-Fa-f]{{2}}') then 'mac_address'
      when regexp_full_match({v}, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') then 'ip_address'
      when regexp_full_match({v}, '\d{{15}}') then 'imei'
      when regexp_full_match({v}, '[^@\s]+@[^@\s]+\.[^@\s]+') then 'email'
      when regexp_full_match({v}, '[A-Za-z0-9]{{6,20}}') and regexp_matches({v}, '[A-Za-z]') and regexp_matches({v}, '\d') then 'serial_number'
      when regexp_full_match({v}, '[a-zA-Z0-9][a-zA-Z0-9\-]{{1,14}}[a-zA-Z0-9]') then 'hostname' else 'none' end)"""


def tokens_sql(c: str) -> str:
    low = rf"regexp_replace(lower(coalesce({c}, '')), '([a-z])''s\b', '\1', 'g')"
    return rf"list_filter(regexp_split_to_array({low}, '[^a-z0-9\-]+'), lambda w: length(w) >= 4 and (length(w) >= 6 or regexp_matches(w, '\d')))"


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_records")


_KEY = ["source", "source_id"]


def _per_record(name: str, column: str, build, sql: str) -> None:
    """A query that shows one function over one column of source_records."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return records(spark, d).select(*_KEY, build(F.col(column)).alias("result"))

    run.__name__ = name
    query(name, f"select source, source_id, {sql} as result from source_records")(run)


_per_record("strip_sentinels", "os", text.strip_sentinels, strip_sql("os"))
_per_record("norm_name", "name", text.normalize_name, name_sql("name"))
_per_record("norm_mac", "mac_address", text.normalize_mac, mac_sql("mac_address"))
_per_record("norm_serial", "serial_number", text.normalize_serial, serial_sql("serial_number"))
_per_record("os_family", "os", text.os_family, family_sql("os"))
_per_record("classify_value", "assigned_user", text.classify, class_sql("assigned_user"))
_per_record("first_of_list", "extra_attributes", text.first_of_list, trim_sql("string_split(coalesce(extra_attributes, ''), ',')[1]"))
_per_record("content_hash", "extra_attributes", text.content_hash, "sha256(extra_attributes)")
_per_record("safe_display", "model", lambda c: text.safe_text(c, "-"), "case when model is null or lower(trim(model)) in ('', 'nan') then '-' else model end")
_per_record("title_label", "os_family", text.title_label, "case when os_family = '' then '' else upper(os_family[1]) || os_family[2:] end")


@query("classify_counts", " union all ".join(f"select '{c}' as field, {class_sql(c)} as class, count(*) as n from source_records group by 2" for c in ("serial_number", "mac_address", "ip_address", "imei", "assigned_user", "name", "asset_tag")))
def classify_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the values of seven fields look like: one scan, values unpivoted before they are counted."""
    cols = ["serial_number", "mac_address", "ip_address", "imei", "assigned_user", "name", "asset_tag"]
    long = records(spark, d).select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), text.classify(F.col(c)).alias("class")) for c in cols))).alias("x"))
    return long.groupBy("x.field", "x.class").agg(F.count(F.lit(1)).alias("n"))


@query("url_employee", r"""select doc_id, regexp_extract(u, '/Agreements/([^/]+)__\d+/', 1) as employee
 from (select doc_id, '/Agreements/' || coalesce(source, 'x') || '__' || doc_id || '/contract.pdf' as u from documents)""")  # fmt: skip
def url_employee(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("/Agreements/"), F.coalesce("source", F.lit("x")), F.lit("__"), F.col("doc_id").cast("string"), F.lit("/contract.pdf"))
    return table(spark, d, "documents").select("doc_id", text.employee_from_url(link).alias("employee"))


@query("token_counts", f"select word, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({tokens_sql('text')}) as word from documents) group by 1")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("word"))
    per_doc = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("metric_parse", r"""select metric_id, value, case when value is null then text_value end as rest,
  array_to_string(list_filter(tags, lambda t: t <> ''), ' ') as tags_text,
  regexp_extract(array_to_string(tags, ' '), 'units=(\S+)', 1) as unit from metrics""")
def metric_parse(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metrics")
    return m.select("metric_id", "value", F.when(F.col("value").isNull(), F.col("text_value")).alias("rest"), F.array_join(F.filter("tags", lambda t: t != ""), " ").alias("tags_text"), F.regexp_extract(F.array_join("tags", " "), r"units=(\S+)", 1).alias("unit"))


@query("metric_number_or_text", r"""with x as (select raw_id, json_extract_string(case when json_valid(raw_json) then raw_json end, '$.hostid') as h from raw_store)
select raw_id, try_cast(h as double) as value, case when try_cast(h as double) is null then h end as text_value from x where h is not null""")
def metric_number_or_text(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "raw_store").select("raw_id", F.get_json_object("raw_json", "$.hostid").alias("h")).where("h is not null")
    value, rest = text.number_or_text(F.col("h"))
    whole = table(spark, d, "raw_store").select("raw_id", F.try_parse_json("raw_json").isNotNull().alias("ok")).where("ok").select("raw_id").distinct()
    return h.join(whole, "raw_id", "left_semi").select("raw_id", value.alias("value"), rest.alias("text_value"))


@query("ipv4_numbers", r"""select source, source_id, case when regexp_full_match(ip_address, '((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)')
  then ((split_part(ip_address, '.', 1)::bigint * 256 + split_part(ip_address, '.', 2)::bigint) * 256 + split_part(ip_address, '.', 3)::bigint) * 256 + split_part(ip_address, '.', 4)::bigint end as number from source_records""")
def ipv4_numbers(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select(*_KEY, net.ipv4_number(F.col("ip_address")).alias("number"))


@query("name_similarity", """select r.source, r.source_id, d.cluster_id, round(jaro_winkler_similarity(r.name_clean, d.device_name), 6) as similarity
 from source_records r join devices d using (cluster_id) where r.name_clean <> '' and d.device_name <> ''""")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    j = records(spark, d).where("name_clean <> ''").join(table(spark, d, "devices").where("device_name <> ''").select("cluster_id", "device_name"), "cluster_id")
    return j.select(*_KEY, "cluster_id", F.round(similarity.jaro_winkler("name_clean", "device_name"), 6).alias("similarity"))


@query("edit_levels", """select r.source, r.source_id, d.cluster_id,
  case when r.serial_number = '' or d.serial_number = '' then -1 when r.serial_number = d.serial_number then 3
  when levenshtein(r.serial_number, d.serial_number) <= 1 then 2 when levenshtein(r.serial_number, d.serial_number) <= 2 then 1 else 0 end as level
  from source_records r join devices d using (cluster_id)""")
def edit_levels(spark: SparkSession, d: str) -> DataFrame:
    j = records(spark, d).join(table(spark, d, "devices").select("cluster_id", F.col("serial_number").alias("golden")), "cluster_id")
    return j.select(*_KEY, "cluster_id", similarity.level_edits(F.nullif("serial_number", F.lit("")), F.nullif("golden", F.lit("")), (1, 2)).alias("level"))


@query("html_text", r"""select doc_id, regexp_replace(trim(regexp_replace('<p>' || replace(coalesce(lang, ''), '&', '&amp;') || '</p><b>' || coalesce(source, '') || '</b>', '<[^>]*>', ' ', 'g')), '\s+', ' ', 'g') as body from documents""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<p>"), F.replace(F.coalesce("lang", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("</p><b>"), F.coalesce("source", F.lit("")), F.lit("</b>"))
    return table(spark, d, "documents").select("doc_id", text.strip_html(page).alias("body"))
