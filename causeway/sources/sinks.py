"""Tables that are replaced whole or by partition, at once: staged files, then one rename of a manifest.

A table is a folder of versions and a manifest that names the files that count, with rows, digest and bounds of each part.
A run writes new files beside the old ones, and the manifest last. What breaks before leaves the old table as it was; what
runs twice with equal rows changes nothing. Readers go by the manifest, which is read without a job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import delete, exists, read_text, replace_text

MANIFEST = "manifest.json"
#: The column that files are parted by; the table's own column stays in the files.
PART = "part_"


def manifest(spark: SparkSession, path: str) -> dict | None:
    """parts: value -> {folder, rows, digest, low, high}; schema; bounds: the column that low and high are of. None if there is no table."""
    at = f"{path.rstrip('/')}/{MANIFEST}"
    return json.loads(read_text(spark, at)) if exists(spark, at) else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as its manifest has it, whatever else lies in the folder."""
    told = manifest(spark, path)
    if told is None:
        raise ValueError(f"no table at {path}")
    schema = StructType.fromJson(told["schema"])
    folders = [f"{path.rstrip('/')}/{p['folder']}" for _, p in sorted(told["parts"].items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def row_digest(columns: Sequence[str]) -> Column:
    """A sum over rows, so that their order doesn't count; equal rows count each."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")).cast("string")


def publish(df: DataFrame, path: str, by: str | None = None, bounds: str | None = None, key: Sequence[str] = ()) -> dict:
    """Makes df the table at path and returns its manifest; by: replaces only the partitions of that column that df has rows of.

    bounds: a column whose least and greatest value the manifest keeps. key: columns that must tell rows apart, or the run
    is refused. Parts whose rows are the same as before keep their files. Files that no manifest needs any more are deleted
    once the new one stands, but for those that it replaced, which a reader may still be at.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    old = manifest(spark, path)
    if old is not None and StructType.fromJson(old["schema"]) != df.schema and by is not None and old["parts"]:
        raise ValueError("the partitions that stay have another schema")
    run = f"data/{uuid.uuid4().hex}"
    staged = f"{path}/{run}"
    part = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("null")) if by else F.lit("all")
    df.withColumn(PART, part).write.partitionBy(PART).parquet(staged)
    written = spark.read.schema(StructType([*df.schema.fields, StructField(PART, StringType())])).parquet(staged)
    low, high = (f(F.col(f"`{bounds}`")).cast("string") if bounds else F.lit(None).cast("string") for f in (F.min, F.max))
    told = written.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), row_digest(df.columns).alias("digest"), low.alias("low"), high.alias("high")).collect()  # a row per partition
    if key and (twice := written.groupBy(*key).count().filter("count > 1").take(1)):
        delete(spark, staged)
        raise ValueError(f"{dict(zip(key, twice[0], strict=False))} is there {twice[0]['count']} times")
    had = (old or {}).get("parts", {})
    parts = dict(had) if by else {}
    folders = {r[PART]: _folder(written, r[PART]) for r in told}
    for r in told:
        same = had.get(r[PART])
        new = {"folder": f"{run}/{folders[r[PART]]}", "rows": r["rows"], "digest": r["digest"], "low": r["low"], "high": r["high"]}
        parts[r[PART]] = same if same and old["schema"] == df.schema.jsonValue() and (same["rows"], same["digest"]) == (r["rows"], r["digest"]) else new
    if old is not None and parts == had and old["schema"] == df.schema.jsonValue():
        delete(spark, staged)
        return old
    made = {"version": (old or {}).get("version", 0) + 1, "schema": df.schema.jsonValue(), "bounds": bounds, "by": by, "parts": parts, "replaced": sorted({p["folder"] for p in had.values()} - {p["folder"] for p in parts.values()})}
    replace_text(spark, f"{path}/{MANIFEST}", json.dumps(made, sort_keys=True, indent=1))
    for folder in (old or {}).get("replaced", []):
        delete(spark, f"{path}/{folder}")
    return made


def _folder(written: DataFrame, value: str) -> str:
    """The folder of a partition, as the writer spells it."""
    escape = written.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{PART}={escape.escapePathName(value)}"


def high(spark: SparkSession, path: str) -> str | None:
    """The greatest value of the manifest's bounds, as text; None without a table or rows. No job runs."""
    told = manifest(spark, path)
    return max((p["high"] for p in told["parts"].values() if p["high"] is not None), default=None) if told else None


def cached(spark: SparkSession, path: str, column: str, at_least: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if its column reaches at_least (as text, dates as 2024-01-05); else what make returns, published there. A fresh table is told from its manifest, without a job, and make isn't called."""
    reached = high(spark, path)
    if reached is None or reached < at_least:
        publish(make(), path, bounds=column)
    return current(spark, path)


def sanitised_traders(spark: SparkSession, path: str, active: DataFrame) -> DataFrame:
    """The published registrations, six columns of them and each row once, of the accounts (campaign_id, account_id) that traded; accounts without a registration have nulls."""
    rows = current(spark, path).select("campaign_id", F.col("account").alias("account_id"), "challenge_type_id", "trader_key", "shared_ip", "ip_cluster_id").distinct()
    return active.select("campaign_id", "account_id").distinct().join(rows, ["campaign_id", "account_id"], "left")
