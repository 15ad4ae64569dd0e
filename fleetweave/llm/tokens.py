"""p8: token ids of a text column, by the automaton of `automaton.py`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetweave.session import default_tokenizer_dir


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return f"{folder or default_tokenizer_dir()}/{name}"


def encode_column(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """`(key, ids)` for every row of `df`.

    Empty and null texts have the empty list. Repeated rows give repeated rows; columns besides `key` and `text` are
    not read. Texts are encoded whole, whatever their length. No shuffle: one pass over the scan.
    """
    from fleetweave.llm.automaton import shared_tables

    tables = shared_tables(df.sparkSession, path or vocabulary())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = tables()
        for b in batches:
            made = [table.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            ends = np.zeros(len(made) + 1, dtype=np.int64)
            np.cumsum([len(m) >> 2 for m in made], out=ends[1:])
            if ends[-1] >= 2**31:
                raise ValueError("lower spark.sql.execution.arrow.maxRecordsPerBatch")
            values = pa.array(np.frombuffer(b"".join(made), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return df.select(key, text).mapInArrow(run, schema)


def count_column(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """`(key, n_tokens)` for every row of `df`; 0 for empty and null texts."""
    from fleetweave.llm.automaton import shared_tables

    tables = shared_tables(df.sparkSession, path or vocabulary())

    def run(batches):
        import pyarrow as pa

        table = tables()
        for b in batches:
            made = [len(table.encode(t)) >> 2 if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], names=[key, "n_tokens"])

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType(), False)])
    return df.select(key, text).mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`(key, text)`: the labels of the arcs, put together. Null ids give a null text."""
    from fleetweave.llm.automaton import shared_tables

    tables = shared_tables(df.sparkSession, path or vocabulary())

    def run(batches):
        import pyarrow as pa

        decode = tables().automaton.decode
        for b in batches:
            made = [None if x is None else decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, "text"])

    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])
    return df.select(key, ids).mapInArrow(run, schema)
