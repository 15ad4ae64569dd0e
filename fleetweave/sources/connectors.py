"""Reading from HTTP services as Spark data sources, with the page range or cursor as partitions; and sinks.

Each reader asks for JSON over HTTP (or takes `file://` pages, as tests do) and yields one text per record, so that
whatever a service adds to its records is kept. By default an error ends a feed with what arrived so far; with the option
`strict` it fails the read, so that half a feed never takes a table's place (`replace_if_any`, `ingest`).
"""

from __future__ import annotations

import json
import logging
import urllib.request
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Members in which services wrap their records (fixed values).
WRAPPERS = ("devices", "response", "data", "results", "items", "value", "result")


def fetch(url: str, headers: dict | None = None, body: dict | None = None, timeout: float = 30.0, strict: bool = False):
    """The JSON at `url`, None for no content and, unless `strict`, for errors of the network."""
    data = json.dumps(body).encode() if body is not None else None
    ask = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(ask, timeout=timeout) as r:
            raw = r.read()
        return json.loads(raw) if raw else None
    except (OSError, ValueError):
        if strict:
            raise
        return None


def records_of(answer, path: str | None = None) -> list[dict]:
    """The records in an answer: at a dotted path, in a known wrapper, the list itself or a single object."""
    for p in path.split(".") if path else ():
        answer = answer.get(p) if isinstance(answer, dict) else None
    if isinstance(answer, list):
        return [x for x in answer if isinstance(x, dict)]
    if isinstance(answer, dict):
        for w in WRAPPERS:
            if not path and isinstance(answer.get(w), list):
                return [x for x in answer[w] if isinstance(x, dict)]
        return [answer]
    return []


def _headers(o: dict) -> dict:
    return {"Authorization": o["token"]} if o.get("token") else {}


class _Page(InputPartition):
    def __init__(self, first: int, step: int):
        super().__init__(first)
        self.first, self.step = first, step


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.o = dict(options)

    def partitions(self):
        return [_Page(int(self.o.get("first", 1)), 1)]

    def read(self, partition):
        for x in self.pages(partition):
            yield (json.dumps(x, sort_keys=True, ensure_ascii=False),)

    def pages(self, partition):
        raise NotImplementedError

    def get(self, url: str, body: dict | None = None):
        return fetch(url, _headers(self.o), body, strict=str(self.o.get("strict", "")).lower() == "true")


class _Source(DataSource):
    reader_class: type = _Reader

    def schema(self):
        return "raw_json string"

    def reader(self, schema):
        return self.reader_class(self.options, schema)


class RestReader(_Reader):
    def pages(self, partition):
        return records_of(self.get(self.o["url"]), self.o.get("response_path"))


class RestJson(_Source):
    """One GET; option `response_path` names where the records are."""

    reader_class = RestReader

    @classmethod
    def name(cls):
        return "rest_json"


class PagedReader(_Reader):
    """`{url}` with `{page}` in it, up to the first empty page; `parallel` readers take every n-th page."""

    def partitions(self):
        n = int(self.o.get("parallel", 1))
        return [_Page(int(self.o.get("first", 1)) + i, n) for i in range(n)]

    def pages(self, partition):
        page = partition.first
        while rows := records_of(self.get(self.o["url"].replace("{page}", str(page))), self.o.get("response_path")):
            yield from rows
            page += partition.step


class PagedJson(_Source):
    reader_class = PagedReader

    @classmethod
    def name(cls):
        return "paged_json"


class LinkedReader(_Reader):
    """Follows `paging.next` from answer to answer."""

    def pages(self, partition):
        url, seen = self.o["url"], set()
        while url and url not in seen:
            seen.add(url)
            answer = self.get(url)
            yield from records_of(answer, self.o.get("response_path"))
            url = (answer.get("paging") or {}).get("next") if isinstance(answer, dict) else None


class LinkedJson(_Source):
    reader_class = LinkedReader

    @classmethod
    def name(cls):
        return "linked_json"


class RpcReader(_Reader):
    def pages(self, partition):
        body = {"jsonrpc": "2.0", "id": 1, "method": self.o["method"], "params": json.loads(self.o.get("params", "{}"))}
        return records_of(self.get(self.o["url"], body), "result")


class JsonRpc(_Source):
    reader_class = RpcReader

    @classmethod
    def name(cls):
        return "json_rpc"


class CursorReader(_Reader):
    """`{start}` in the url is the row to begin at; ends on `has_more_rows` false, a short page or an empty one."""

    def pages(self, partition):
        start, rows = int(self.o.get("first", 1)), int(self.o.get("row_count", 100))
        while True:
            answer = self.get(self.o["url"].replace("{start}", str(start)).replace("{rows}", str(rows)))
            got = records_of(answer, self.o.get("response_path"))
            yield from got
            info = (answer or {}).get("list_info", {}) if isinstance(answer, dict) else {}
            if not got or len(got) < rows or info.get("has_more_rows") is False:
                return
            start += len(got)


class Cursor(_Source):
    reader_class = CursorReader

    @classmethod
    def name(cls):
        return "cursor"


SOURCES = {c.name(): c for c in (RestJson, PagedJson, LinkedJson, JsonRpc, Cursor)}


def register(spark: SparkSession) -> None:
    for c in SOURCES.values():
        spark.dataSource.register(c)


def with_details(records: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Records with the members of their detail record, where they lack them: `raw_json` of either side, joined on a member."""
    k = lambda side: F.get_json_object(f"{side}.raw_json", f"$['{key}']")
    j = records.alias("l").join(details.alias("r"), k("l") == k("r"), "left")
    as_map = lambda c: F.from_json(c, "map<string,string>")
    own, more = as_map(F.col("l.raw_json")), as_map(F.coalesce("r.raw_json", F.lit("{}")))
    rest = F.map_filter(F.transform_keys(more, lambda name, _: F.lower(name)), lambda name, _: ~F.array_contains(F.map_keys(own), name))
    return j.select(F.to_json(F.map_concat(own, rest)).alias("raw_json"))


def latest_of(rows: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """Per key the fields of the row with the greatest time."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(F.col(at).try_cast("long"), *fields)).alias("r")).select(key, "r.*")


def raw_store(raw: DataFrame, id_path: str, at) -> DataFrame:
    """Rows for a raw store from fetched texts: id (its content hash without one), canonical hash, time; the last of repeated ids."""
    from fleetweave.operators.capture import canonical_json, last_wins
    from fleetweave.sources.manifest import at_path

    digest = F.sha2(canonical_json(F.col("raw_json")), 256)
    sid = at_path(F.col("raw_json"), id_path)
    rows = raw.withColumn("seq", F.monotonically_increasing_id()).select(F.when(sid == "", digest).otherwise(sid).alias("source_id"), "raw_json", digest.alias("raw_hash"), at.alias("fetched_at"), "seq")
    return last_wins(rows, ["source_id"], ["seq"]).drop("seq")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_if_any(rows: DataFrame, path: str) -> bool:
    """Put new rows in a table's place unless there are none; whether it was done.

    They are written beside the table first. If reading or writing them fails, the table stays as it was.
    """
    spark = rows.sparkSession
    fresh, aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    new, fs = _fs(spark, fresh)
    try:
        rows.write.parquet(fresh)
        if spark.read.schema(rows.schema).parquet(fresh).isEmpty():
            return False
        here, old = _fs(spark, path)[0], _fs(spark, aside)[0]
        if fs.exists(here):
            fs.rename(here, old)
        fs.rename(new, here)
        fs.delete(old, True)
        return True
    finally:
        fs.delete(new, True)


def ensure_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`, made empty with `schema` (DDL) if it isn't there; what is there isn't touched."""
    here, fs = _fs(spark, path)
    if not fs.exists(here):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)


def ingest(spark: SparkSession, feeds: dict, root: str) -> dict[str, int]:
    """Read each feed (`name: () -> DataFrame`) into `root/name`; rows by feed, 0 for none, -1 for a feed that failed.

    A feed that fails or brings nothing leaves its table and the other feeds alone.
    """
    out = {}
    for name, read in feeds.items():
        try:
            out[name] = spark.read.parquet(f"{root}/{name}").count() if replace_if_any(read(), f"{root}/{name}") else 0
        except Exception as error:  # noqa: BLE001 - whatever goes wrong in a feed stays in it
            logging.getLogger(__name__).warning("feed %s failed: %s", name, error)
            out[name] = -1
    return out


def typed(raw: DataFrame, columns: dict[str, str], constants: dict[str, str] | None = None) -> DataFrame:
    """A table of texts from `raw_json`: `columns` maps a name to a dotted path; objects and lists stay JSON, missing ones are `''`."""
    from fleetweave.sources.manifest import json_path

    read = [F.coalesce(F.get_json_object("raw_json", json_path(p)), F.lit("")).alias(n) for n, p in columns.items()]
    return raw.select(*read, *(F.lit(v).alias(n) for n, v in (constants or {}).items()), "raw_json")


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """A small JSON file (a registry, a status), replaced as a whole."""
    new, fs = _fs(spark, f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(state, sort_keys=True, ensure_ascii=False).encode("utf-8")))
    out.close()
    here = _fs(spark, path)[0]
    fs.delete(here, False)
    fs.rename(new, here)


def read_state(spark: SparkSession, path: str) -> dict:
    """What `write_state` wrote, `{}` without a file."""
    here, fs = _fs(spark, path)
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if fs.exists(here) else {}


def backup(spark: SparkSession, tables: dict[str, str], root: str, stamp: str) -> dict:
    """Copies of Parquet tables under `root/stamp`, and a manifest of their rows beside them; the manifest is written last."""
    rows = {}
    for name, path in tables.items():
        target = f"{root}/{stamp}/{name}"
        spark.read.parquet(path).write.mode("overwrite").parquet(target)
        rows[name] = spark.read.parquet(target).count()
    manifest = {"stamp": stamp, "tables": rows}
    write_state(spark, f"{root}/{stamp}/manifest.json", manifest)
    return manifest


def write_clusters(labels: DataFrame, path: str) -> None:
    """`(unique_id, cluster_id)` of every record as CSV with a header."""
    labels.select("unique_id", "cluster_id").write.mode("overwrite").option("header", True).csv(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a text, blanks as `''`."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")


def write_csv_by_source(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("source").option("header", True).csv(path)


def catalogue(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """`(name, rows, columns)` of Parquet tables by path."""
    out = None
    for n, p in tables.items():
        df = spark.read.parquet(p)
        one = df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def generated(spark: SparkSession, devices: int, seed: int = 1) -> DataFrame:
    """Synthetic records of `devices` devices, each in up to five sources (30/30/20/13/7 %), with fields left out at random."""
    sources = F.array(*map(F.lit, ("sp", "me_ec", "fg", "zbx", "ad")))
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    many = F.when(u < 30, 1).when(u < 60, 2).when(u < 80, 3).when(u < 93, 4).otherwise(5)
    rows = spark.range(devices).select("id", F.explode(F.slice(sources, 1, many)).alias("source"))
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))
    keep = lambda salt, c: F.when(F.pmod(F.xxhash64("id", "source", F.lit(salt)), F.lit(100)) < 80, c).otherwise(F.lit(""))
    mac = F.regexp_replace(F.substring(h, 1, 12), "(..)(?!$)", "$1:")
    return rows.select(F.concat(F.lit("c-"), F.substring(h, 1, 10)).alias("cluster_id"), "source", F.col("id").cast("string").alias("source_id"), F.concat(F.lit("WS-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), keep(1, F.upper(F.substring(h, 13, 8))).alias("serial_number"), keep(2, mac).alias("mac_address"))
