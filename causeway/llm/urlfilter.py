"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join, in DataFrame functions only.

A list holds entries (host, path, verdict). An entry fits a URL if the URL's host is the entry's or a subdomain of it and
the URL's path starts with the entry's; of entries that fit, the longest (host and path together) decides, and a URL that
none fits gets the default verdict.

An entry's key is its canonical URL, host and path joined. A URL could only be fitted by keys made of one of its host
suffixes and one of its path prefixes, of as many labels and of such lengths as occur in the list; these candidates ask the
filter. The filter is a table of blocks of eight 64-bit words. A key's hash names one block and one bit in each word, so a
probe reads one row. What passes is joined to the list on the whole key, which removes false positives.

The blocks, and the list itself, are broadcast only while their counted rows are within a bound; beyond it both joins are
shuffled, and keys that very many candidates share ("com/") are taken out of the shuffle: they are few, by their count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Bits of the filter for each listed key, words of a block, and the fewest blocks.
BITS_A_KEY, WORDS, FEWEST_BLOCKS = 16, 8, 64
#: Entries of the list and blocks of the filter (64 bytes each) that are broadcast at most.
BROADCAST_ENTRIES, BROADCAST_BLOCKS = 200_000, 500_000
#: A key that so many candidates hold is joined through a broadcast; there is at most one for as many candidates.
HOT_CANDIDATES = 1_000_000

# Fixed values of the contract: the rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if url is null or has no ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return _lower(rest)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty if url is null or has no ://."""
    whole = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.instr(whole, "/") > 0, F.substring(whole, F.instr(whole, "/"), F.length(whole))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def entries(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A short list written out in code, as a table (host, path, verdict). Longer lists are read from storage."""
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in ("host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])))


def canonical(listed: DataFrame) -> DataFrame:
    """A list's entries by key (host and path joined; the path starts with / or is empty): key, size (code points), verdict, labels, path_size.

    Host in lower case (A-Z). Entries that can fit nothing (a null, an empty host, a host with / in it, another path) are
    left out; of entries with one key the least verdict stays, so "allow" goes before "block".
    """
    rows = listed.select(_lower(F.col("host")).alias("host"), "path", "verdict").filter("host <> '' AND NOT contains(host, '/') AND (path = '' OR startswith(path, '/')) AND verdict IS NOT NULL")
    return rows.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(F.concat("host", "path").alias("key"), (F.length("host") + F.length("path")).alias("size"), "verdict", F.size(F.split("host", "\\.", -1)).alias("labels"), F.length("path").alias("path_size"))


def _mask(word: int) -> Column:
    """The one bit of a key's second hash in this word of its block."""
    return F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64(key, 7), {6 * word}) & 63 AS INT))")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """keys (key string) -> the filter's blocks that hold anything: block, w0 to w7. Its rows are at most `blocks`, whatever the list."""
    at = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    return keys.select(at, *[_mask(j).alias(f"m{j}") for j in range(WORDS)]).groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(WORDS)])


def possible(candidates: DataFrame, filt: DataFrame, blocks: int) -> DataFrame:
    """The candidates (with a column key) whose bits are all set; no key of the list is ever turned away."""
    near = F.broadcast(filt) if blocks <= BROADCAST_BLOCKS else filt
    asked = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    hits = asked.join(near, "block")
    for j in range(WORDS):
        hits = hits.filter(F.col(f"w{j}").bitwiseAND(_mask(j)) != 0)
    return hits.select(*candidates.columns)


def _exact(hits: DataFrame, own: DataFrame, n: int, most: int, hot: int) -> DataFrame:
    """The hash join on whole keys. Beyond `most` entries it is a shuffled one, without the keys that many candidates share."""
    if n <= most:
        return hits.join(F.broadcast(own), "key")
    hits = written(hits, "url-hits")
    often = F.broadcast(own.join(hits.groupBy("key").count().filter(F.col("count") > hot).select("key"), "key", "left_semi"))
    return hits.join(often, "key").unionByName(hits.join(often.select("key"), "key", "left_anti").join(own, "key"))


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", url: str = "url", most: int = BROADCAST_ENTRIES, hot: int = HOT_CANDIDATES) -> DataFrame:
    """pages with host, path, rule (the key of the entry that decides; null if none) and verdict; columns of those names are replaced.

    listed: host, path, verdict. Every row gets its verdict, repeated rows too. A null URL, or one without ://, has an empty
    host and path and gets the default; so does everything if the list is empty. Of two entries of one length that fit
    (com/en/abcd and xyz.com/en/, say) the least key decides. An empty table stays empty.

    A verdict depends on host and path alone, so each pair of them asks once (copies meet on the map side) and the verdicts
    are joined back; a URL that very many rows share is one row of the smaller side, and adaptive execution splits the other.
    """
    made = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in made]
    own = canonical(listed)
    # one row: what the list holds, so that a URL asks only for keys of shapes that are listed
    n, labels, sizes = own.agg(F.count(F.lit(1)), F.max("labels"), F.collect_set("path_size")).first()
    source = F.col(f"`{url}`")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host_of(source).alias("host"), path_of(source).alias("path"))
    none = rows.filter("host = ''" if n else "true").select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not n:
        return none
    asking = rows.filter("host <> ''")
    parts = F.split("host", "\\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda p: F.concat(t, p))))
    candidates = asking.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    blocks = max(FEWEST_BLOCKS, -(-n * BITS_A_KEY // (64 * WORDS)))
    found = _exact(possible(candidates, bloom(own, blocks), blocks), own.select("key", "size", "verdict"), n, most, hot)
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.col("size")).alias("size"), "key", "verdict")).alias("best"))
    judged = asking.join(best, ["host", "path"], "left").select("row.*", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(none)


def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages by the five rules, every other URL being allowed: page_id, host, path, rule, verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, entries(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")
