"""Raw stores: last-wins insert, change capture on hashes, field-level history, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetweave.functions import text


def canonical_json(c: Column) -> Column:
    """JSON with the members of all objects in order of name, so that equal content has an equal hash; a text that isn't JSON as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by `order`. A `max_by` with map-side combine, so a key delivered endlessly stays small."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def upsert(store: DataFrame, batch: DataFrame, key: str, hashed: str) -> DataFrame:
    """`(key, action)` of each key: `insert`, `update`, `skip` (equal hash) or `keep` (not in the batch)."""
    l, r = store.select(key, F.col(hashed).alias("_old")), batch.select(key, F.col(hashed).alias("_new"))
    j = l.join(r, key, "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(F.col("_old") == F.col("_new"), "skip").otherwise("update")
    return j.select(key, action.alias("action"))


def merged(store: DataFrame, batch: DataFrame, key: str, hashed: str) -> DataFrame:
    """The store after the batch: changed and new rows from the batch, the others as they were."""
    j = store.alias("l").join(batch.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full_outer")
    take = F.col(f"r.{key}").isNotNull() & (F.col(f"l.{key}").isNull() | ~F.col(f"l.{hashed}").eqNullSafe(F.col(f"r.{hashed}")))
    return j.select(*(F.when(take, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in store.columns))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flat_fields(s):
    """Leaves of a JSON object by dotted name; lists of plain values joined by commas, lists of objects as JSON. Null for anything else."""
    import json

    from fleetweave.operators.nested import parse

    def plain(x):
        return "" if x is None else "true" if x is True else "false" if x is False else str(x)

    def one(t):
        v = parse(t) if t else NotImplemented
        if not isinstance(v, dict):
            return None
        out, todo = {}, [("", v)]
        while todo:
            prefix, obj = todo.pop()
            for k, x in obj.items():
                name = f"{prefix}.{k}" if prefix else k
                if isinstance(x, dict):
                    todo.append((name, x))
                elif isinstance(x, list):
                    out[name] = json.dumps(x, ensure_ascii=False) if any(isinstance(y, (dict, list)) for y in x) else ",".join(map(plain, x))
                else:
                    out[name] = plain(x)
        return out

    return s.map(one)


def null_like(c: Column) -> Column:
    """The trimmed value, null for texts that mean none."""
    t = text.stripped(c)
    return F.when(~F.lower(t).isin("", "null", "none", "n/a", "--", "-"), t)


def field_changes(before: DataFrame, after: DataFrame, key: str, json_column: str) -> DataFrame:
    """`(key, field, old_value, new_value)` of fields that differ between two states of the keys in both; meta members don't count."""
    l, r = before.select(key, flat_fields(F.col(json_column)).alias("o")), after.select(key, flat_fields(F.col(json_column)).alias("n"))
    both = l.join(r, key).select(key, "o", "n", F.explode(F.array_union(F.map_keys("o"), F.map_keys("n"))).alias("field")).where(~text.is_meta_key(F.col("field")))
    rows = both.select(key, "field", null_like(F.try_element_at("o", F.col("field"))).alias("old_value"), null_like(F.try_element_at("n", F.col("field"))).alias("new_value"))
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def kept(history: DataFrame, at: str, as_of: Column, days: int = 180) -> DataFrame:
    """Rows within the retention period."""
    return history.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def records_after(mesh: DataFrame, batch: DataFrame) -> DataFrame:
    """Incremental load of records: rows of the batch replace those of the same (source, source_id); clusters are kept by `linking.assigned`.

    Repeated keys in the batch collapse to one row, of a resolved cluster before a provisional one; loading a batch twice changes nothing.
    """
    rest = [c for c in batch.columns if c not in ("source", "source_id")]
    rank = F.struct(F.col("cluster_id").startswith("new-"), "cluster_id", *(c for c in rest if c != "cluster_id"))
    one = batch.groupBy("source", "source_id").agg(F.min_by(F.struct(*rest), rank).alias("r")).select("source", "source_id", "r.*").select(*batch.columns)
    return mesh.join(one.select("source", "source_id"), ["source", "source_id"], "left_anti").select(*mesh.columns).unionByName(one)
