"""p5: deeply nested records as flat related tables.

One depth-first pass over each text emits a row per object: the tag of the table it belongs to, its key, the key of the
row above it and its own members. Rows of all tables come out of one scan; `write_tables` lays them out by tag and
`as_table` gives a tag its columns.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_constant(_: str):
    raise ValueError("NaN and infinities aren't JSON")


def _whole(s: str):
    return int(s) if len(s) < 4000 else float(s)


_DECODE = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole).decode
#: Member names may hold lone surrogates, which UTF-8 can't.
_clean = lambda s: s.encode("utf-8", "replace").decode("utf-8")


def parse(text: str | None):
    """The value of a whole JSON text, `NotImplemented` for anything else."""
    try:
        return _DECODE(text)
    except RecursionError:
        return _parse_deep(text)
    except (ValueError, TypeError):
        return NotImplemented


def _parse_deep(text: str):
    """Without recursion, for texts nested deeper than the interpreter allows."""
    from json.decoder import scanstring

    stack: list = []
    i, n, value, state = 0, len(text), NotImplemented, "value"
    try:
        while True:
            while i < n and text[i] in " \t\r\n":
                i += 1
            if state == "value":
                c = text[i]
                if c in "[{":
                    stack.append(([] if c == "[" else {}, None))
                    i += 1
                    while text[i] in " \t\r\n":
                        i += 1
                    if text[i] == ("]" if c == "[" else "}"):
                        i += 1
                        value, state = stack.pop()[0], "after"
                    elif c == "{":
                        state = "name"
                    continue
                if c == '"':
                    value, i = scanstring(text, i + 1, True)
                else:
                    j = i
                    while j < n and text[j] not in ",]} \t\r\n":
                        j += 1
                    value, i = _DECODE(text[i:j]), j
                state = "after"
            elif state == "name":
                if text[i] != '"':
                    return NotImplemented
                name, i = scanstring(text, i + 1, True)
                while text[i] in " \t\r\n":
                    i += 1
                if text[i] != ":":
                    return NotImplemented
                stack[-1] = (stack[-1][0], name)
                i, state = i + 1, "value"
            else:
                if not stack:
                    return value if i == n else NotImplemented
                holder, name = stack[-1]
                if isinstance(holder, list):
                    holder.append(value)
                else:
                    holder[name] = value
                c, i = text[i], i + 1
                if c == ",":
                    state = "value" if isinstance(holder, list) else "name"
                elif c == ("]" if isinstance(holder, list) else "}"):
                    value = stack.pop()[0]
                else:
                    return NotImplemented
    except (IndexError, ValueError):
        return NotImplemented


def _plain(name: str, array: list):
    """`(name, members)` of `array` and the arrays within it that are empty or have members that aren't objects or arrays."""
    stack = [(name, array)]
    while stack:
        n, v = stack.pop()
        if (rest := [y for y in v if not isinstance(y, (dict, list))]) or not v:
            yield n, rest
        stack.extend((f"{n}[{i}]", y) for i, y in enumerate(v) if isinstance(y, list))


def visit(value, path: str = "", tag: str = "", parent: str | None = None, payload: bool = True):
    """`(tag, path, parent path, is element, payload)` of each object, depth first.

    The root object has the path and tag `''`. Objects within objects belong to the row of the object around them,
    their members under dotted names; objects in arrays are rows of the table named by their path without positions.
    Array members that aren't objects stay in the payload: those of an array under its name, those of an array within it
    under its name and positions (`grid[0]`), those of an array at the root in a row of the root, which has no name
    (`''`, `[0]`). Empty arrays and objects stay as they are.
    """
    stack = [(value, path, tag, parent, False)]
    if payload and isinstance(value, list) and (own := dict(_plain("", value))):
        yield tag, path, parent, False, own
    while stack:
        v, p, t, up, element = stack.pop()
        if isinstance(v, list):
            stack.extend((x, f"{p}[{i}]", t + "[]", up, True) for i, x in zip(range(len(v) - 1, -1, -1), reversed(v)) if isinstance(x, (dict, list)))
            continue
        if not isinstance(v, dict):
            continue
        own, arrays = {}, []
        inner = [("", v)]
        while inner:
            prefix, obj = inner.pop()
            for k, x in obj.items():
                name = f"{prefix}.{k}" if prefix else k
                if isinstance(x, dict):
                    inner.append((name, x))
                    if payload and not x:
                        own[name] = x
                elif isinstance(x, list):
                    arrays.append((name, x))
                    if payload:
                        own.update(_plain(name, x))
                elif payload:
                    own[name] = x
        yield t, p, up, element, own
        dot = "." if p else ""
        stack.extend((x, f"{p}{dot}{name}", f"{t}{dot}{name}", p, False) for name, x in reversed(arrays))


def flatten(df: DataFrame, key: str, text: str, open_texts: bool = False, payload: bool = True) -> DataFrame:
    """`(rec_key, table_tag, node_path, parent_path, is_element, payload)` of every object in the column `text`.

    `node_path` joins member names with `.` and adds `[n]` for each array; `parent_path` is the path of the row above
    (null at the root); `payload` is JSON of the row's own members, null unless asked for. With `open_texts`, a root
    member that is the text of a JSON array is opened. Null, empty and broken texts give nothing, nor do texts of
    scalars. Rows repeated in full come out once; records are split over tasks as they are read.
    """
    cols = [("rec_key", T.StringType()), ("table_tag", T.StringType()), ("node_path", T.StringType()), ("parent_path", T.StringType()), ("is_element", T.BooleanType()), ("payload", T.StringType())]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                v = parse(t)
                if v is NotImplemented:
                    continue
                if open_texts and isinstance(v, dict):
                    for name, x in v.items():
                        if isinstance(x, str) and x.lstrip(" \t\r\n")[:1] == "[" and isinstance(y := parse(x), list):
                            v[name] = y
                for tag, path, up, element, own in visit(v, payload=payload):
                    for c, x in zip(out, (k, _clean(tag), _clean(path), None if up is None else _clean(up), element, _clean(json.dumps(own, ensure_ascii=False)) if payload else None)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=[c for c, _ in cols])

    schema = T.StructType([T.StructField(c, k) for c, k in cols])
    rows = df.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).distinct()


def write_tables(nodes: DataFrame, path: str) -> None:
    """One folder per table tag below `path`."""
    nodes.write.mode("overwrite").partitionBy("table_tag").parquet(path)


def as_table(nodes: DataFrame, tag: str, schema: str) -> DataFrame:
    """The rows of one table with the columns of `schema` (DDL; names with dots in backticks) read from their payload."""
    typed = F.from_json("payload", schema)
    return nodes.where(F.col("table_tag") == tag).select("rec_key", "node_path", "parent_path", typed.alias("row")).select("rec_key", "node_path", "parent_path", "row.*")
