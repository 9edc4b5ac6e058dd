"""Helpers shared by the training-data operators: staging tables, Arrow mapping, the word pattern."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import discard, shared_dir, spread, staged

__all__ = ["WORD", "WORD_RE", "by_size", "discard", "documents", "fresh", "in_parts", "shared_dir", "small", "spread", "staged", "text_bytes"]

#: A word is a run of characters other than ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_size(rows: Iterable, size: Callable, limit: int) -> Iterator[list]:
    """Cuts rows into lists whose sizes sum to about limit; a single larger row is a list of its own."""
    out, total = [], 0
    for r in rows:
        out.append(r)
        total += size(r)
        if total >= limit:
            yield out
            out, total = [], 0
    if out:
        yield out


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_parts(df: DataFrame) -> DataFrame:
    """df, after making its session send at most BATCH_BYTES of rows (or one row) at once to Python workers; a lower setting stays."""
    conf = df.sparkSession.conf
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(BATCH_SETTING))
    if not 0 < now <= BATCH_BYTES:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def small(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about limit bytes of the column's text, so that a worker's memory doesn't follow the size of Spark's batches."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            yield b.slice(s, e - s)
