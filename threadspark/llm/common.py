"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.session import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BATCH = 4000
#: Keys of at most two numbers that are broadcast to pick rows; for more of them the rows are shuffled.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and continue from the written copy."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # an empty table may leave no file


def rows_without(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (name -> expression, null equal to null) aren't in the written table ``gone``, with all their columns.

    Rows travel as one struct, so their columns can have any names.
    """
    whole = docs.select(F.struct("*").alias("row"), F.struct(*[c.alias(k) for k, c in keys.items()]).alias("key"))
    few = gone.count() <= BROADCAST_KEYS
    wanted = gone.select(*[F.col(k).alias(f"gone_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"key.{k}").eqNullSafe(F.col(f"gone_{k}")) for k in keys])
    return whole.join(F.broadcast(wanted) if few else wanted.hint("merge"), same, how).select("row.*")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def ascii_lowered(text: str | None) -> bytes:
    """The same for Python, as UTF-8 bytes (``bytes.lower`` touches ASCII letters only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<struct<start:int,stop:int>>": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, ..." for the types used here; workers have no session to ask."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def batches(rows: Iterable[tuple], ddl: str, size: int = ROWS_PER_BATCH, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, cut by row count and by the bytes of their binary and text cells."""
    schema = arrow_schema(ddl)
    held: list[tuple] = []
    weight = 0

    def packed() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= size or weight >= most_bytes:
            yield packed()
            held, weight = [], 0
    if held:
        yield packed()


def rows_of(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    """The rows of Arrow batches as tuples, a slice at a time."""
    for batch in incoming:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
