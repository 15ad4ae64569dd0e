"""Declarative feeds: what to read from each source, and its compilation into Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetweave.functions import text
from fleetweave.operators.capture import flat_fields


class Role(str, Enum):
    ANCHOR = "anchor"
    ATTACHMENT = "attachment"
    CONTEXT = "context"


@dataclass(frozen=True)
class FieldSpec:
    """A field as the values of dotted paths, in order, and the name of a transform."""

    paths: tuple[str, ...]
    transform: str | None = None


@dataclass(frozen=True)
class Link:
    field: str
    to: str
    on: str
    strategy: str = "exact"
    transform: str | None = None
    multi: bool = False
    scope: tuple[str, ...] = ()


@dataclass(frozen=True)
class Feed:
    system: str
    role: Role
    store: str
    id_path: str
    profile: str | None = None
    updated_path: str | None = None
    spec: dict = field(default_factory=dict)
    links: tuple[Link, ...] = ()


@dataclass(frozen=True)
class System:
    strategy: str
    schedule_s: int = 3600
    coverage: float = 0.0


@dataclass(frozen=True)
class Profile:
    fields: tuple[str, ...]
    derived: dict = field(default_factory=dict)
    blocking: tuple[str, ...] = ()
    truth: dict = field(default_factory=dict)
    cluster_threshold: float = -5.0
    predict_threshold: float = -10.0


@dataclass(frozen=True)
class Manifest:
    project: str
    systems: dict[str, System]
    feeds: dict[str, Feed]
    profiles: dict[str, Profile]


LINK_STRATEGIES = ("exact", "normalized", "extract_fuzzy")


def as_spec(x) -> FieldSpec:
    """`FieldSpec`, a path, or a tuple of paths whose last member is a transform if it is the name of one."""
    if isinstance(x, FieldSpec):
        return x
    if isinstance(x, str):
        return FieldSpec((x,))
    parts = tuple(x)
    if len(parts) == 2 and parts[1] in text.TRANSFORMS:
        return FieldSpec(parts[:1], parts[1])
    return FieldSpec(parts)


def problems(m: Manifest, strategies=None) -> list[str]:
    """What is wrong with a manifest; empty if nothing is."""
    out = []
    if not m.project.isidentifier():
        out.append(f"project {m.project!r} is no identifier")
    for n, s in m.systems.items():
        if strategies is not None and s.strategy not in strategies:
            out.append(f"system {n}: unknown strategy {s.strategy!r}")
        if s.schedule_s <= 0:
            out.append(f"system {n}: schedule must be positive")
        if not 0 <= s.coverage <= 1:
            out.append(f"system {n}: coverage must be within 0..1")
    stores: dict[str, str] = {}
    for n, f in m.feeds.items():
        if f.system not in m.systems:
            out.append(f"feed {n}: unknown system {f.system!r}")
        if not f.store.isidentifier():
            out.append(f"feed {n}: store {f.store!r} is no identifier")
        if stores.setdefault(f.store, n) != n:
            out.append(f"feed {n}: store {f.store!r} belongs to {stores[f.store]}")
        if not f.id_path and f.role is not Role.CONTEXT:
            out.append(f"feed {n}: id_path is missing")
        if f.role is Role.ANCHOR and f.profile not in m.profiles:
            out.append(f"feed {n}: unknown profile {f.profile!r}")
        if f.role is Role.ATTACHMENT and not f.links:
            out.append(f"feed {n}: an attachment needs a link")
        known = set(m.profiles[f.profile].fields) if f.profile in m.profiles else None
        for name, x in f.spec.items():
            s = as_spec(x)
            if known is not None and name not in known:
                out.append(f"feed {n}: field {name!r} isn't in the profile")
            if s.transform and s.transform not in text.TRANSFORMS:
                out.append(f"feed {n}: unknown transform {s.transform!r}")
        for k in f.links:
            if k.strategy not in LINK_STRATEGIES:
                out.append(f"feed {n}: unknown link strategy {k.strategy!r}")
            if k.to not in m.profiles:
                out.append(f"feed {n}: link to unknown profile {k.to!r}")
            elif k.on not in m.profiles[k.to].fields:
                out.append(f"feed {n}: link on unknown field {k.on!r}")
    for n, p in m.profiles.items():
        for c in (*p.blocking, *p.truth, *p.derived):
            if c not in p.fields:
                out.append(f"profile {n}: {c!r} isn't a field")
    return out


def json_path(dotted: str) -> str:
    """`a.0.b` as a JSON path; every name is quoted, whole numbers are positions."""
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else "['" + p.replace("'", "\\'") + "']" for p in dotted.split("."))


def at_path(raw: Column, dotted: str) -> Column:
    """The text at a path; the members of a list joined by commas, `''` without a value."""
    got = F.get_json_object(raw, json_path(dotted))
    members = F.from_json(got, "array<string>")
    is_list = got.startswith("[") & members.isNotNull()
    joined = F.array_join(F.filter(F.transform(members, text.strip_sentinels), lambda x: x != ""), ",")
    return F.when(is_list, joined).otherwise(text.strip_sentinels(got))


def field_value(raw: Column, spec: FieldSpec) -> Column:
    """All distinct values of the paths in order, joined by commas, then transformed."""
    each = F.filter(F.array(*(at_path(raw, p) for p in spec.paths)), lambda x: x != "")
    value = text.stripped(F.array_join(F.array_distinct(each), ","))
    return text.TRANSFORMS[spec.transform](value) if spec.transform else value


def _mapped(spec: dict, drop: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, sorted({p.lower() for x in spec.values() for p in as_spec(x).paths} | set(drop))))


def extra_attributes(raw: Column, spec: dict, drop: tuple[str, ...] = ("id", "source_id")) -> Column:
    """JSON of what the record has besides the mapped paths (compared without case); `''` if nothing is left."""
    return _left(flat_fields(raw), _mapped(spec, drop))


def _left(flat: Column, taken: Column) -> Column:
    left = F.map_filter(flat, lambda k, v: ~F.array_contains(taken, F.lower(k)) & (text.strip_sentinels(v) != ""))
    return F.when(F.size(F.map_keys(left)) > 0, F.to_json(left)).otherwise(F.lit(""))


def walk(raw: DataFrame, feed: Feed, column: str = "raw_json") -> DataFrame:
    """The records of a raw store: every field of the spec, source_id and extra_attributes. Broken texts give blank records."""
    doc = F.when(F.try_parse_json(column).isNotNull(), F.col(column)).otherwise(F.lit("{}"))
    base = raw.select(doc.alias("_raw"))
    cols = [field_value(F.col("_raw"), as_spec(x)).alias(n) for n, x in feed.spec.items() if n != "source_id"]
    return base.select(at_path(F.col("_raw"), feed.id_path).alias("source_id"), *cols, extra_attributes(F.col("_raw"), feed.spec).alias("extra_attributes"))


def walk_all(raw: DataFrame, feeds: dict[str, Feed], column: str = "raw_json", source: str = "source", extra: bool = True) -> DataFrame:
    """`walk` for a store of several sources in one scan: `source` and every field of any spec, by the spec of the row's source.

    A field that a source's feed doesn't have is `''`. Each path is read for the rows of its own sources only.
    """
    doc = F.when(F.try_parse_json(column).isNotNull(), F.col(column)).otherwise(F.lit("{}"))
    base = raw.select(F.col(source).alias("source"), doc.alias("_raw"))
    names = list(dict.fromkeys(n for f in feeds.values() for n in f.spec if n != "source_id"))

    def by_source(make) -> Column:
        same: dict = {}
        for s, f in feeds.items():
            k, c = make(f)
            same.setdefault(k, ([], c))[0].append(s)
        arms = [(F.col("source").isin(*ss), c) for ss, c in same.values() if c is not None]
        return reduce(lambda w, a: w.when(*a), arms[1:], F.when(*arms[0])).otherwise(F.lit(""))

    def field_of(n: str):
        return lambda f: (as_spec(f.spec[n]), field_value(F.col("_raw"), as_spec(f.spec[n]))) if n in f.spec else (None, None)

    cols = [by_source(field_of(n)).alias(n) for n in names]
    sid = by_source(lambda f: (f.id_path, at_path(F.col("_raw"), f.id_path))).alias("source_id")
    if not extra:
        return base.select("source", sid, *cols)
    taken = None
    for s, f in feeds.items():
        mapped = _mapped(f.spec, ("id", "source_id"))
        taken = F.when(F.col("source") == s, mapped) if taken is None else taken.when(F.col("source") == s, mapped)
    flat = base.withColumn("_flat", flat_fields(F.col("_raw")))
    return flat.select("source", sid, *cols, _left(F.col("_flat"), taken).alias("extra_attributes"))


def normalized(records: DataFrame, source: str | Column, fields: tuple[str, ...]) -> DataFrame:
    """Profile records: derived columns, lower-case manufacturer, blanks for missing fields and sentinels."""
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in records.columns}
    get = lambda c: text.strip_sentinels(have[c]) if c in have else F.lit("")
    name, mac, serial = text.normalize_name(get("name")), text.normalize_mac(get("mac_address")), text.normalize_serial(get("serial_number"))
    made = {
        "source": F.lit(source) if isinstance(source, str) else source, "name_clean": name, "mac_clean": mac, "serial_number": serial, "os_family": text.os_family(get("os")), "manufacturer": F.lower(get("manufacturer")),
        "name_fallback": F.when((serial == "") & (mac == ""), name).otherwise(F.lit("")),
    }
    return records.select(*(made.get(c, get(c)).alias(c) for c in fields))


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
