"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, fresh_dir, shared_dir, written

__all__ = ["exists", "fresh_dir", "fresh_name", "give_back", "held_out", "shared_dir", "slices", "small_batches", "table", "written"]

#: Of every three documents, the one whose checksum leaves this remainder is held out of all learning.
FOLDS, HELD_OUT = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While a table of wide rows is written: Arrow batches of so many rows at most, so that a task holds few of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, str(min(int(had), rows) if int(had) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, had)


def fresh_name(what: str) -> str:
    """A column name that no table has."""
    return f"{what}_{uuid.uuid4().hex[:12]}"


def held_out(doc_id: Column | str) -> Column:
    """True for rows kept out of learning; a null id is learned from by nobody and counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def give_back() -> None:
    """Gives the system what this process has freed. Spark keeps Python workers from stage to stage, and their allocators would keep what the largest stage took."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # the C library isn't glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about most_chars bytes of the text column (one text at least): memory stays bounded for long texts. What earlier tasks of the worker have freed goes back first."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
