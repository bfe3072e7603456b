"""Language identification by rank-order profiles.

A profile is a list of the most frequent letter n-grams (1 to 3, words padded with a space) in order of frequency. A
document's distance to a language is the sum, over the document's own most frequent n-grams, of how far each is out of
place in the language's profile; one that isn't there counts as fully out of place. The nearest language wins.

Language profiles are counted over all training documents: each task counts its texts, counts meet by (language,
n-gram), and only the top of each language (profile rows times languages) reaches the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, held_out, slices, table

#: Rows of a profile, the longest n-gram, and the languages that are told apart at most (what is broadcast is their product).
PROFILE, LONGEST, MOST_LANGUAGES = 300, 3, 2_000
#: Code points counted at once; longer texts are counted in parts and summed.
AT_ONCE = 1_000_000
#: N-grams that a task holds before it hands them on.
HELD_GRAMS = 2_000_000
SALTS = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else a space."""
    out = np.full(0x110000, 32, dtype=np.int64)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i
    return out


def _grams(text: str) -> np.ndarray:
    """Every n-gram as a 63-bit number (three code points of 21 bits); an n-gram lies in one padded word."""
    c = _letters()[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]  # runs of spaces as one
    one, two = c[c != 32], (c[:-1] << 21) | c[1:]
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.concatenate([one, two, three[c[1:-1] != 32]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, in order of their numbers, and how often each occurs. Parts are cut at white space if there is any."""
    if len(text) <= AT_ONCE:
        return np.unique(_grams(text), return_counts=True)
    keys, ns, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + AT_ONCE)
        space = text.rfind(" ", at, end) if end < len(text) else end
        end = space if space > at else end
        k, n = np.unique(_grams(text[at:end]), return_counts=True)
        keys.append(k)
        ns.append(n)
        at = end
    return _summed(keys, ns)


def _summed(keys: list[np.ndarray], ns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, weights=np.concatenate(ns)).astype(np.int64)


def ranked(keys: np.ndarray, ns: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by number."""
    if len(keys) > most:
        least = np.partition(ns, len(ns) - most)[len(ns) - most]
        keys, ns = keys[ns >= least], ns[ns >= least]
    return keys[np.lexsort((keys, -ns))][:most]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (keys, ns) in held.items():
            k, n = _summed(keys, ns)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            k, n = counted(text)
            keys, ns = held.setdefault(lang, ([], []))
            keys.append(k)
            ns.append(n)
            size += len(k)
        if size > HELD_GRAMS:
            held = {lang: tuple([x] for x in _summed(*v)) for lang, v in held.items()}
            size = sum(len(k[0]) for k, _ in held.values())
            if size > HELD_GRAMS // 2:
                yield from out()
                held, size = {}, 0
    yield from out()


def profiles(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """docs (text, lang) -> (lang, gram, n, rank from 0): the top of each language over all rows with neither null.

    Ranking goes in two steps, within parts of a language first, so no task sees all n-grams of a language.
    """
    each = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(*order)
    few = each.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= most).drop("r")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).filter(F.col("rank") < most)


class Profiles:
    """Languages and, per n-gram of any profile, its rank in each language (`absent` where it has none)."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int = PROFILE):
        self.most = most
        self.langs = sorted({r[0] for r in rows})
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages; the profiles of {MOST_LANGUAGES} are broadcast at most")
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        at = np.searchsorted(self.grams, np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks[at, [self.langs.index(r[0]) for r in rows]] = [r[2] for r in rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1); `und` and 0 for a text without a letter, or if there is no profile."""
        keys, ns = counted(text or "")
        keys = keys[ns > 0]
        if not self.langs or not (keys < 1 << 21).any():  # a single letter is among the n-grams of any text that has one
            return "und", 0.0
        own = ranked(keys, ns, self.most)
        at = np.searchsorted(self.grams, own)
        known = (at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == own)
        ranks = self.ranks[np.where(known, at, len(self.grams))]
        out = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        share = out / (self.most * len(own))
        rest = np.delete(share, best).min() if len(out) > 1 else 1.0
        return self.langs[best], float(np.clip(0.5 + 0.5 * (rest - share[best]) / max(rest, 1e-9), 0.0, 1.0)) if rest > 0 else 0.5


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """docs without its text, with lang_pred and score; columns of those names are replaced. Whole texts count. A tie goes to the language that sorts first."""
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(source := fresh_name("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            got = [shared.value.predict(t) for t in batch.column(source).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, rows.drop(source).schema.add("lang_pred", "string").add("score", "double"))


def fit(docs: DataFrame, most: int = PROFILE) -> Profiles:
    """docs (text, lang), all of them."""
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles(docs, most).collect()], most)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
