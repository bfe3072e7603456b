"""Binary market data as a data source: slices of files as partitions, days as options, the price scale from the metadata.

A file holds records of seven little-endian 32-bit integers: minutes since 2000-01-01 UTC, open, high, low and close times
the symbol's price scale, and two unused ones, in order of time. Plain files are cut into slices. First and last day are a
range of minutes; its first and last record in a file are found by bisection, reading 28 bytes at a time, so files and
slices outside the range are never opened by a task. Gzipped files can't be cut or searched: each is one partition,
unzipped as a stream; one whose name holds a day (2024-01-05 or 20240105) is of that day, and is left out by it.

(Days are options, as filters pushed into a source of Python stay in its reader: a second query on one DataFrame that pushes
none would see the first one's.) Driver and tasks open the files themselves, by a path that both see or a URI that Arrow's file systems know.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = 28
#: Records of a slice, and of a batch that a task passes on.
SLICE, BATCH = 4_000_000, 65_536
_START, _DAY = datetime(2000, 1, 1), 24 * 60
_NAMED = re.compile(r"(?<!\d)(\d{4})-?(\d{2})-?(\d{2})(?!\d)")

SCHEMA = "date date, time timestamp_ntz, open double, high double, low double, close double, file string"


def price_scale(info: dict, symbol: str) -> float:
    """The scale that the metadata states for a symbol: {symbol: {"priceScale": n}}."""
    scale = (info.get(symbol) or {}).get("priceScale")
    if not isinstance(scale, int | float) or isinstance(scale, bool) or not scale > 0:
        raise ValueError(f"the metadata has no price scale of {symbol}")
    return float(scale)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _minutes(day: str) -> int:
    return (datetime.fromisoformat(day) - _START) // timedelta(minutes=1)


@dataclass
class Slice(InputPartition):
    """Records from first to last (exclusive) of a plain file; of a gzipped one last is None."""

    path: str
    first: int
    last: int | None

    def __post_init__(self):
        super().__init__(None)


class TickReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options or not {"symbol", "scale"} & options.keys():
            raise ValueError("ticks need a path, and a symbol or a scale")
        self.root, self.slice = options["path"], int(options.get("slice", SLICE))
        # minutes that are asked for, both included
        self.low = _minutes(options["first"]) if "first" in options else -(2**31)
        self.high = _minutes(options["last"]) + _DAY - 1 if "last" in options else 2**31 - 1
        if "scale" in options:
            self.scale = float(options["scale"])
            return
        store, info = _store(options.get("info") or f"{self.root.rstrip('/')}/info.json")
        with store.open_input_stream(info) as f:
            self.scale = price_scale(json.loads(f.read()), options["symbol"])

    def partitions(self) -> list[Slice]:
        store, root = _store(self.root)
        found = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        out: list[Slice] = []
        for info in sorted(found, key=lambda i: i.path):
            if not info.is_file or not re.search(r"\.bin(\.gz)?$", info.path) or "__MACOSX" in info.path or info.base_name.startswith("._"):
                continue
            with store.open_input_file(info.path) as f:
                if f.read(2) == b"\x1f\x8b":
                    named = _NAMED.search(info.base_name)
                    day = _minutes("-".join(named.groups())) if named else None
                    if day is None or (day <= self.high and day + _DAY > self.low):
                        out.append(Slice(info.path, 0, None))
                    continue
                n = info.size // RECORD
                first, last = self._place(f, n, self.low), self._place(f, n, self.high + 1)
            out += [Slice(info.path, at, min(at + self.slice, last)) for at in range(first, last, self.slice)]
        return out or [Slice("", 0, 0)]

    @staticmethod
    def _place(f, n: int, minute: int) -> int:
        """The first of n records that isn't before the minute."""
        low, high = 0, n
        while low < high:
            middle = (low + high) // 2
            f.seek(middle * RECORD)
            if int.from_bytes(f.read(4), "little", signed=True) < minute:
                low = middle + 1
            else:
                high = middle
        return low

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _store(self.root)
        before = -(2**31)
        for data in self._blocks(store, partition):
            x = np.frombuffer(data, dtype="<i4").reshape(-1, 7)
            minutes = x[:, 0].astype(np.int64)
            if len(minutes) and (minutes[0] < before or (np.diff(minutes) < 0).any()):
                raise ValueError(f"records of {partition.path} aren't in order of time")
            before = int(minutes[-1]) if len(minutes) else before
            asked = (minutes >= self.low) & (minutes <= self.high)
            x, minutes = x[asked], minutes[asked]
            if len(x):
                time = np.datetime64(_START, "us") + minutes * np.timedelta64(60_000_000, "us")
                prices = [pa.array(x[:, i] / self.scale) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(time.astype("datetime64[D]")), pa.array(time, pa.timestamp("us")), *prices, pa.array([partition.path] * len(x), pa.string())], ["date", "time", "open", "high", "low", "close", "file"])

    def _blocks(self, store: pyarrow.fs.FileSystem, s: Slice) -> Iterator[bytes]:
        """Whole records, BATCH at a time. A file that ends amid a record loses that record."""
        if s.last is not None:
            with store.open_input_file(s.path) as f:
                f.seek(s.first * RECORD)
                for at in range(s.first, s.last, BATCH):
                    yield f.read(min(BATCH, s.last - at) * RECORD)
            return
        with store.open_input_stream(s.path, compression=None) as f:
            z, left = zlib.decompressobj(31), b""
            while chunk := f.read(1 << 20):
                while chunk:
                    left += z.decompress(chunk, BATCH * RECORD)
                    whole = len(left) // RECORD * RECORD
                    yield left[:whole]
                    left, chunk = left[whole:], z.unconsumed_tail
                    if z.eof:
                        chunk, z = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31)


class Ticks(DataSource):
    """Options: path, symbol, info (the metadata file; <path>/info.json), slice (records), first and last (days as 2024-01-05), scale (instead of a symbol)."""

    @classmethod
    def name(cls) -> str:
        return "causeway_ticks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TickReader:
        return TickReader(dict(self.options))


def read_ticks(spark: SparkSession, path: str, symbol: str, first: date | None = None, last: date | None = None, info: str | None = None, slice_records: int = SLICE) -> DataFrame:
    """SCHEMA of all files *.bin and *.bin.gz under path, of the days from first to last."""
    spark.dataSource.register(Ticks)
    options = {"path": path, "symbol": symbol, "slice": str(slice_records), "info": info, "first": first and first.isoformat(), "last": last and last.isoformat()}
    return spark.read.format("causeway_ticks").options(**{k: v for k, v in options.items() if v is not None}).load()


def daily_bars(ticks: DataFrame) -> DataFrame:
    """date, open, high, low, close of each day."""
    return ticks.groupBy("date").agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"))
