"""Running Python over Arrow batches of text, and small helpers shared by the operators here."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """A record batch of rows under a Spark schema string whose types are in _KINDS."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    s = pa.schema([(n, _KINDS[k]) for n, k in fields])
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, s)], schema=s)


def map_rows(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str, start: Callable[[], None] | None = None) -> DataFrame:
    """df with f(*row) -> rows applied to each row, in Arrow batches. start: runs once in each task, to build tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start:
            start()
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(f(*row))
                if len(out) >= 4096:
                    yield batch_of(out, schema)
                    out = []
            yield batch_of(out, schema)

    return df.mapInArrow(run, schema)


def non_ascii(c: str) -> Column:
    """Whether the text has any character beyond ASCII; compares two lengths, without a pattern."""
    return F.octet_length(c) > F.length(c)


def only_non_ascii(c: str) -> Column:
    return F.when(non_ascii(c), F.col(c)).alias(c)
