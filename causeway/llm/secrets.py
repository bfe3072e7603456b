"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A version is (path, content); its content is addressed by SHA-256. The ledger remembers which (blob, rule version) pairs
have been scanned and what was found. A scan takes the blobs of a batch once each (copies meet in map-side combining),
drops the pairs that the ledger has, runs the rules over the rest, appends to the ledger, and joins findings back to
every path by digest.

A rule's matches are located without a Python function: split(content, rule) gives the pieces between matches and
regexp_extract_all the matches, so running sums of their lengths (code points) are the offsets.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exists, fresh_dir, fresh_name, table


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regular expression that never matches nothing. A match counts if its group `measured` has `least` characters. gate: what a text with a match surely has."""

    kind: str
    pattern: str
    measured: int
    least: int
    gate: str

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}|{self.measured}|{self.least}".encode()).hexdigest()[:16]


# Fixed values of the contract: the three base rules, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
# For these two a failing match holds no other match, so the bound can stand in the pattern that is run.
RUN = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

SCANS = "digest string, kind string, rule_version string"
FINDINGS = "digest string, kind string, rule_version string, start long, end long"


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scanned pairs and findings. A run counts once its scans are written, which happens last: what a broken run left is ignored."""
    if not exists(spark, f"{path}/scans"):
        return spark.createDataFrame([], SCANS + ", run string"), spark.createDataFrame([], FINDINGS + ", run string")
    scans = spark.read.schema(SCANS + ", run string").parquet(f"{path}/scans")
    findings = spark.read.schema(FINDINGS + ", run string").parquet(f"{path}/findings")
    return scans, findings.join(scans.select("run").distinct(), "run", "left_semi")


def _matches(blobs: DataFrame, rule: Rule) -> DataFrame:
    """blobs (digest, content) -> findings of one rule, one row each."""
    run = RUN.get(rule.kind, rule.pattern)
    content = F.col("content")
    cut = blobs.filter(content.rlike(rule.gate)).select(
        "digest",
        F.transform(F.split(content, run, -1), F.length).alias("between"),
        F.transform(F.regexp_extract_all(content, F.lit(run), F.lit(0)), F.length).alias("long"),
        F.transform(F.regexp_extract_all(content, F.lit(run), F.lit(rule.measured)), F.length).alias("measured"),
    )
    each = cut.select("digest", "between", "measured", F.posexplode("long").alias("i", "len")).select("digest", "i", "len", F.col("between")[F.col("i")].alias("gap"), F.col("measured")[F.col("i")].alias("measured"))
    upto = Window.partitionBy("digest").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(upto).cast("long")
    return each.withColumn("end", end).filter(F.col("measured") >= rule.least).select("digest", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("rule_version"), (F.col("end") - F.col("len")).cast("long").alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger hasn't, appends to it, and returns the ledger's findings for the rules: digest, kind, rule_version, start, end.

    versions: (path, content), any number of rows per path and per content; a null content is the empty one; no rows
    give no findings; other columns are ignored. Offsets count code points, end exclusive.
    """
    spark = versions.sparkSession
    content = F.coalesce(F.col("content"), F.lit(""))
    blobs = versions.select(digest(content).alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    scans, _ = _ledger(spark, ledger)
    wanted = [r.version for r in rules]
    had = scans.filter(F.col("rule_version").isin(wanted)).groupBy("digest").agg(F.collect_set("rule_version").alias("had"))
    todo = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("had", F.array().cast("array<string>")))
    fresh = blobs.join(had, "digest", "left").withColumn("todo", todo).filter(F.size("todo") > 0).drop("had")
    # the unseen blobs that any rule could match, and the scanned pairs, both in one pass over the texts
    run = uuid.uuid4().hex
    hits = fresh.select("digest", "todo", F.array_compact(F.array(*[F.when(F.array_contains("todo", r.version) & F.col("content").rlike(r.gate), F.lit(r.kind)) for r in rules])).alias("may"), "content")
    hits = hits.withColumn("content", F.when(F.size("may") > 0, F.col("content")))
    staged = fresh_dir(spark, "blobs")
    hits.write.parquet(staged)
    hits = spark.read.schema(hits.schema).parquet(staged)
    found = None
    for r in rules:
        some = _matches(hits.filter(F.array_contains("may", r.kind)).select("digest", "content"), r)
        found = some if found is None else found.unionByName(some)
    found.write.parquet(f"{ledger}/findings/run={run}")
    version = F.explode("todo").alias("rule_version")
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    hits.select("digest", version).select("digest", kinds[F.col("rule_version")].alias("kind"), "rule_version").write.parquet(f"{ledger}/scans/run={run}")
    return _ledger(spark, ledger)[1].filter(F.col("rule_version").isin(wanted)).select("digest", "kind", "rule_version", "start", "end")


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: digest, found (array of (start, ord, kind, end), sorted)."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    return findings.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("ord"), "kind", "end"))).alias("found"))


def _spans(found: str) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a first scan of documents, joined back to every document.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans. The ledger adds no spans of its own. Repeated rows stay.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    found = by_blob(scan(docs.select(F.col("doc_id").alias("path"), "content"), fresh_dir(spark, "ledger")))
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in RULES]
    summary = found.select("digest", *counts, _spans("found").alias("spans"))
    out = docs.select("doc_id", digest(F.col("content")).alias("digest")).join(summary, "digest", "left")
    spans = F.coalesce("spans", F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in RULES], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of text replaced by mark, n_chars counted again where it changes; other rows and columns stay.

    Overlapping spans are replaced as one. A null text stays null.
    """
    spark = docs.sparkSession
    own_text, own_digest, own_found = map(fresh_name, ("text", "digest", "found"))
    found = by_blob(scan(docs.select(F.lit(None).cast("long").alias("path"), F.col("text").alias("content")), ledger or fresh_dir(spark, "ledger")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.col(own_text).substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.col(own_text).substr((acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    own = docs.select(*[F.col(c) for c in docs.columns], F.coalesce("text", F.lit("")).alias(own_text), digest(F.coalesce("text", F.lit(""))).alias(own_digest))
    joined = own.join(found.select(F.col("digest").alias(own_digest), F.col("found").alias(own_found)), own_digest, "left")
    text = F.when(F.col(own_found).isNull(), F.col("text")).otherwise(F.aggregate(own_found, start, step, finish))
    new = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(own_found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)
