"""Shared helpers: Arrow batches in and out of tasks, hashes, written intermediates, blocks of documents."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

__all__ = [
    "BLOCK_BYTES", "arrow_rows", "trimmed", "block_of", "blocks_for", "crc_remainder", "cut_lineage", "documents", "map_rows", "private", "table",
]

#: Text bytes that one block of documents holds on average; a block is what one Python call keeps in memory.
BLOCK_BYTES = 12_000_000
#: Whitespace of the word pattern [^\x20\x09-\x0D]+ , which bytes.split() also uses.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def private(name: str) -> str:
    """A column name that a user's table is not expected to have."""
    return f"__tw_{name}"


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def arrow_rows(batches: Iterable[pa.RecordBatch], limit_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about ``limit_bytes`` at most, or a single row."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * limit_bytes / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, min(step, rows - start))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(function: Callable) -> Callable:
    """The function of one to three arguments, giving memory back after each call."""

    def one(a):
        out = function(a)
        give_back()
        return out

    def two(a, b):
        out = function(a, b)
        give_back()
        return out

    def three(a, b, c):
        out = function(a, b, c)
        give_back()
        return out

    return (one, two, three)[function.__code__.co_argcount - 1]


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, limit_bytes: int = 16_000_000) -> DataFrame:
    """``mapInArrow`` with a factory: what ``make`` sets up lives once per task, its result maps one batch of ``limit_bytes`` at most (or one row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in arrow_rows(batches, limit_bytes):
            out = step(batch)
            if out is not None and out.num_rows:
                yield out
        del step
        give_back()

    return df.mapInArrow(run, schema)


def blocks_for(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks for the text of all rows, from one aggregate over its length."""
    total = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(64)).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / block_bytes))


def block_of(blocks: int, *columns: str) -> Column:
    """The block of a row by hash of the given columns (null counts as a value)."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), F.lit(blocks)).cast("int")
