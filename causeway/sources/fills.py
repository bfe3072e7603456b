"""Campaign files: discovery, schema contract, campaign columns from the file name, id handling, completeness."""

from __future__ import annotations

import csv
import difflib
import re
from collections import defaultdict
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ticks import Ticks, daily_bars

#: The contract: names exactly as exported, in the order of the export.
_TEXT = ("accountId", "instrument", "side", "currency", "userGroupId")
_TIME = ("openDateTime", "closeDateTime")
_LONG = ("positionId", "closeTradeId", "closeOrderId", "openOrderId")
_DOUBLE = ("profit", "reverseProfit", "netProfit", "commission", "swap", "amount", "slPrice", "tpPrice", "openPrice", "closePrice", "lotSize", "durationSec", "openTradeCrossPrice", "closeTradeCrossPrice")
FILL_COLUMNS = (*_TEXT, *_TIME, *_LONG, *_DOUBLE)
IDENTIFIERS = ("accountId", *_LONG)
JUNK = r"(^|/)(__MACOSX/|\._)"
NAME = r"(?i)campaign\s*(\d+).*?(\d{1,2})(?:st|nd|rd|th)?[ _-]+([A-Za-z]{3})[a-z]*[ _-]+(\d{4})"
#: Campaigns that were exported without position ids: each is one position.
ONE_POSITION = (41, 66)


def check_contract(columns: list[str], required: tuple[str, ...] = FILL_COLUMNS, source: str = "input") -> None:
    """Refuses missing columns, naming look-alikes, and identifier names that are padded or spelled another way."""
    plain = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in columns}
    padded = [c for c in columns if c != c.strip() and c.strip() in required]
    if padded:
        raise ValueError(f"{source}: padded column names {padded}")
    missing = [c for c in required if c not in columns]
    if missing:
        alike = {m: plain.get(m.lower()) or next(iter(difflib.get_close_matches(m, columns, 1, 0.8)), None) for m in missing}
        raise ValueError(f"{source}: missing columns {missing}; look-alikes {({m: a for m, a in alike.items() if a})}")


def files_under(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of the files under folder, at any depth and sorted, archive junk left out. (Names are collected, contents aren't read.)"""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
        return sorted(p for (p,) in found.collect() if not re.search(JUNK, p))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The first line's fields, read through the path's own file system; no fields in an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else ()


def by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], DataFrame]:
    """The files' rows as text, apart by header: a reader lays one header over all its files by position. Columns are c0, c1, ... in the header's order."""
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for p in paths:
        groups[header_of(spark, p)].append(p)
    read = spark.read.option("header", True).option("enforceSchema", True)
    return {h: read.schema(", ".join(f"c{i} string" for i in range(len(h)))).csv([_escaped(p) for p in ps]) for h, ps in groups.items() if h}


def _escaped(path: str) -> str:
    """A path that is taken as it is, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def campaign_of(path: str) -> tuple[int, datetime]:
    """Campaign and date that a file's name tells; raises where it tells none."""
    name = unquote(path).rpartition("/")[2]
    found = re.search(NAME, name)
    if not found:
        raise ValueError(f"no campaign and date in the name {name}")
    try:
        return int(found[1]), datetime.strptime(f"{found[2]} {found[3].title()} {found[4]}", "%d %b %Y")
    except ValueError:
        raise ValueError(f"no campaign date in the name {name}") from None


def read_fills(spark: SparkSession, folder: str, pattern: str = "*.csv", id_mode: str = "exact", timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """All campaign files under folder (any depth; archive junk left out), with campaign_id and campaign_date from their names.

    Every file's header is checked against the contract, files of one header are read together by name, and columns are
    coerced: what isn't a number or time becomes null. id_mode "legacy_float" keeps position ids as doubles, so that
    neighbours of 19 digits merge as in the old exports. A file whose name tells no campaign or no date, and a folder
    without files, raise.
    """
    paths = files_under(spark, folder, pattern)
    if not paths:
        raise ValueError(f"{folder}: no campaign files")
    for p in paths:
        campaign_of(p)
    rows = None
    for header, df in by_header(spark, paths).items():
        check_contract(list(header), source=folder)
        part = df.select(*[F.col(f"c{header.index(c)}").alias(c) for c in FILL_COLUMNS], F.url_decode("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("source_file"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError(f"{folder}: only empty files")
    part = lambda i: F.regexp_extract("_file", NAME, i)
    day = F.to_date(F.concat_ws(" ", F.lpad(part(2), 2, "0"), F.initcap(part(3)), part(4)), "dd MMM yyyy")
    pid = F.col("positionId").try_cast("double" if id_mode == "legacy_float" else "bigint")
    out = rows.select(
        *[F.col(c) for c in _TEXT], *[F.try_to_timestamp(c, F.lit(timestamp_format)).cast("timestamp_ntz").alias(c) for c in _TIME],
        *[F.col(c).try_cast("bigint").alias(c) for c in _LONG if c != "positionId"], pid.alias("positionId"),
        *[F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")).alias(c) for c in _DOUBLE], part(1).cast("int").alias("campaign_id"), day.alias("campaign_date"), "source_file",
    )
    return out.withColumn("positionId", F.when(F.col("campaign_id").isin(*ONE_POSITION), F.col("campaign_id").cast(out.schema["positionId"].dataType)).otherwise(F.col("positionId")))


def engine_columns(fills: DataFrame) -> DataFrame:
    """The operators' names for a fills table; the tie of equal close times is the file and the closing trade."""
    names = {"accountId": "account_id", "openDateTime": "open_time", "closeDateTime": "close_time", "slPrice": "sl_price", "tpPrice": "tp_price", "openPrice": "open_price", "closePrice": "close_price", "positionId": "position_id", "netProfit": "net_profit"}
    return fills.withColumn("tie", F.struct("source_file", "closeTradeId")).withColumnsRenamed(names)


def completeness(fills: DataFrame, expected: range = range(33, 67)) -> dict[str, list[int]]:
    """Expected campaigns that are missing, and others that are there. (A row per campaign is collected.)"""
    seen = {r[0] for r in fills.select("campaign_id").distinct().collect()}
    return {"missing": sorted(set(expected) - seen), "unexpected": sorted(seen - set(expected))}


def colliding_ids(fills: DataFrame, key: str = "positionId") -> DataFrame:
    return fills.groupBy(key).agg(F.count_distinct("campaign_id").alias("campaigns")).filter("campaigns > 1")


#: Registration headers of both eras, by their plain spelling.
REGISTRATION = {"account": "account", "email": "email", "ipaddress": "ip_address", "telegramusername": "telegram_username", "challengetypeid": "challenge_type_id"}


def registration_name(column: str) -> str:
    """The one name of a registration column; an unknown one is lower-cased with underscores, so that eras align."""
    plain = column.strip().lower()
    return REGISTRATION.get(re.sub(r"[^a-z0-9]", "", plain), re.sub(r"\s+", "_", plain))


def read_registrations(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Registration files of any header era under one set of names, aligned by name; unknown columns stay (null where a file lacks them), the second of duplicate ones goes. No files: an empty table."""
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in REGISTRATION.values()) + ", campaign_id int")
    for header, df in by_header(spark, files_under(spark, folder, pattern)).items():
        seen: dict[str, int] = {}
        for i, c in enumerate(header):
            seen.setdefault(registration_name(c), i)
        number = F.regexp_extract(F.url_decode("_metadata.file_name"), r"(?i)campaign\s*(\d+)", 1).try_cast("int")
        out = out.unionByName(df.select(*[F.col(f"c{i}").alias(n) for n, i in seen.items() if n != "campaign_id"], number.alias("campaign_id")), allowMissingColumns=True)
    return out


def read_ticks(spark: SparkSession, folder: str, scale: float) -> DataFrame:
    """time, open, high, low, close of binary market data (see `ticks`) under a scale that the caller knows."""
    spark.dataSource.register(Ticks)
    return spark.read.format(Ticks.name()).options(path=folder, scale=str(scale)).load().drop("date", "file")


def daily_from_ticks(ticks: DataFrame) -> DataFrame:
    return daily_bars(ticks.withColumn("date", F.to_date("time")))


__all__ = ["FILL_COLUMNS", "check_contract", "colliding_ids", "completeness", "daily_from_ticks", "engine_columns", "files_under", "header_of", "read_fills", "read_registrations", "read_ticks"]
