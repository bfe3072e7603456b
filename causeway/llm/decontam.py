"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are indexed once; every passage of every training text is a query. Weights are BM25's, divided by an item's
own total, so a score is the share of the item's weight that the passage holds and one threshold serves all items.
All items above it are retrieved and then verified: enough of the item's question and of its answer must stand in the
passage as word trigrams.

Most passages are turned away before a list is walked, without loss: per item the rarest terms that carry enough weight
are essential, and a passage whose essential terms can't make up what the item's other terms leave open can't reach the
threshold. What is left goes through block-max WAND.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

K1, B = 1.2, 0.75
#: Share of an item's weight that a passage must hold, and of the trigrams of its question and answer.
THRESHOLD, OVERLAP = 0.6, 0.6
#: Share of the threshold that an item's terms beyond the essential ones may carry.
OPEN = 0.35
#: Share of a long item's pieces that a text must hold, beside its answer.
PIECES = 0.6
#: Words of an indexed entry at most, of the pieces of longer items, postings of a block, entries of one broadcast index.
ENTRY_WORDS, PIECE_WORDS, BLOCK, INDEX_ENTRIES = 256, 128, 64, 20_000
#: Words of a passage at least; it is twice the longest entry, and passages overlap by half, so an entry always lies within one.
PASSAGE_WORDS = 64

_NO_WORD = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_MARKS = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores, in UTF-8; other characters beyond ASCII count as letters but for general punctuation."""
    low = text.lower()
    return (low if low.isascii() else _MARKS.sub(" ", low)).encode("utf-8", "surrogatepass").translate(_NO_WORD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last line with words, or of a single line its last sentence; all before is the question. A single sentence is a question without answer."""
    parts = [w for p in text.splitlines() if (w := words_of(p))]
    if len(parts) == 1:
        parts = [w for p in _SENTENCE.split(text) if (w := words_of(p))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def entries_of(text: str) -> list[tuple[list[bytes], list[bytes], list[bytes], bytes]]:
    """(question, answer, apart, of) entries of an item: itself, or if it is long the overlapping pieces of its question, all but a short question's of PIECE_WORDS; apart is then the answer, to be found anywhere in the text, and of a digest of the item (else empty)."""
    question, answer = question_and_answer(text)
    if len(question) + len(answer) <= ENTRY_WORDS:
        return [(question, answer, [], b"")] if question else []
    last = max(0, len(question) - PIECE_WORDS)
    of = hashlib.blake2b(b" ".join(question) + b"\n" + b" ".join(answer), digest_size=16).digest()
    return [(question[i : i + PIECE_WORDS], [], answer, of) for i in sorted({*range(0, last, PIECE_WORDS // 2), last})]


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


class Index:
    """entries: (item_id, question, answer) or (item_id, *one of entries_of). df, n, mean_words: statistics over all entries of all indexes."""

    def __init__(self, entries: list[tuple], df: dict[bytes, int], n: int, mean_words: float, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.ids = [e[0] for e in entries]
        self.parts = [(trigrams(e[1]), trigrams(e[2])) for e in entries]
        #: Of pieces, by entry: the long item; by long item: its pieces' trigrams, its answer's.
        self.whole = {i: (e[0], e[4]) for i, e in enumerate(entries) if len(e) > 4 and e[4]}
        self.pieces: dict[tuple[int, bytes], set[frozenset]] = defaultdict(set)
        for i, o in self.whole.items():
            self.pieces[o].add(frozenset(self.parts[i][0]))
        self.apart = {self.whole[i]: trigrams(entries[i][3]) for i in self.whole}
        self.longest = max((len(e[1]) + len(e[2]) for e in entries), default=0)
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.open = np.zeros(len(entries))
        for i, (_, q, a, *_) in enumerate(entries):
            tf = Counter(q + a)
            norm = K1 * (1 - B + B * (len(q) + len(a)) / mean_words)
            w = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            total = sum(w.values())
            rest = 1.0
            for t in sorted(w, key=lambda t: (df[t], t)):
                lists[t].append((i, w[t] / total))
                if rest > OPEN * threshold:
                    essential[t].append((i, w[t] / total))
                    rest -= w[t] / total
            self.open[i] = rest
        self.terms = {t: k for k, t in enumerate(lists)}
        self.lists = [self._blocked(v) for v in lists.values()]
        self.essential = {t: k for k, t in enumerate(essential)}
        self.starts = np.cumsum([0, *map(len, essential.values())])
        self.items = np.array([i for v in essential.values() for i, _ in v], dtype=np.int64)
        self.weights = np.array([w for v in essential.values() for _, w in v])

    @staticmethod
    def _blocked(postings: list[tuple[int, float]]) -> tuple[list[int], list[float], list[int], list[float], float]:
        """Items, weights, the last item and greatest weight of each block, and the greatest weight of all."""
        items, weights = [i for i, _ in postings], [w for _, w in postings]
        blocks = range(0, len(items), BLOCK)
        return items, weights, [items[min(b + BLOCK, len(items)) - 1] for b in blocks], [max(weights[b : b + BLOCK]) for b in blocks], max(weights)

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """Every entry whose score is at least the threshold, by block-max WAND."""
        eps = 1e-9
        cursors = [[self.lists[t], 0] for t in terms]
        out = []
        while cursors:
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
            cursors.sort(key=lambda c: c[0][0][c[1]])
            bound, pivot = 0.0, -1
            for p, c in enumerate(cursors):
                bound += c[0][4]
                if bound >= self.threshold - eps:
                    pivot = p
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0][0][cursors[pivot][1]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][0][cursors[pivot + 1][1]] == at:
                pivot += 1
            block_bound, ends = 0.0, []
            for c in cursors[: pivot + 1]:
                k = c[1] // BLOCK
                while k < len(c[0][2]) and c[0][2][k] < at:
                    k += 1
                if k < len(c[0][2]):
                    block_bound += c[0][3][k]
                    ends.append(c[0][2][k])
            if block_bound < self.threshold - eps:
                # nothing up to the nearest block end, nor before the next list begins, can reach the threshold
                to = min([e + 1 for e in ends] + [c[0][0][c[1]] for c in cursors[pivot + 1 : pivot + 2]])
                for c in cursors[: pivot + 1]:
                    self._skip(c, max(to, at + 1) if to > at else at + 1)
            elif cursors[0][0][0][cursors[0][1]] == at:
                score = sum(c[0][1][c[1]] for c in cursors[: pivot + 1])
                if score >= self.threshold - eps:
                    out.append((at, score))
                for c in cursors[: pivot + 1]:
                    c[1] += 1
            else:
                for c in cursors[: pivot + 1]:
                    self._skip(c, at)
        return out

    @staticmethod
    def _skip(cursor: list, to: int) -> None:
        (items, _, last, _, _), at = cursor
        k = at // BLOCK
        while k < len(last) and last[k] < to:
            k += 1
        at = max(at, k * BLOCK)
        while at < len(items) and items[at] < to:
            at += 1
        cursor[1] = at

    def matches(self, text: str) -> list[tuple[int, int, float, float, float]]:
        """(item_id, first word of the passage, score, question share, answer share) of every item that the whole text leaks, its best passage each."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        essential = self.essential
        found = [(i, essential[w]) for i, w in enumerate(words) if w in essential]
        if not found:
            return []
        stride = max(PASSAGE_WORDS // 2, self.longest)
        at, t = np.array(found, dtype=np.int64).T
        # passage p holds words [p * stride, (p + 2) * stride): a word lies in two of them; a term counts once in each
        last = at // stride
        pair = np.concatenate([last * len(essential) + t, (last * len(essential) + t)[last > 0] - len(essential)])
        pair.sort()
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
        passage, t = np.divmod(pair, len(essential))
        longs = self.starts[t + 1] - self.starts[t]
        each = np.repeat(self.starts[t] - (np.cumsum(longs) - longs), longs) + np.arange(int(longs.sum()))
        passage, item, weight = np.repeat(passage, longs), self.items[each], self.weights[each]
        key, where = np.unique(passage * len(self.ids) + item, return_inverse=True)
        could = np.bincount(where, weights=weight) + self.open[key % len(self.ids)] >= self.threshold - 1e-9
        best: dict[int, tuple[int, int, float, float, float]] = {}
        pieces: dict[tuple[int, bytes], dict[frozenset, tuple[float, int]]] = defaultdict(dict)
        for p in np.unique(key[could] // len(self.ids)).tolist():
            own = slice(p * stride, (p + 2) * stride)
            grams = None
            for e, score in self.retrieve({self.terms[w] for w in words[own] if w in self.terms}):
                grams = grams or self._grams(words[own])
                question, answer = self.parts[e]
                a, b = len(question & grams) / len(question), len(answer & grams) / len(answer) if answer else 1.0
                if a >= OVERLAP and e in self.whole:
                    got, piece = pieces[self.whole[e]], frozenset(question)
                    got[piece] = max(got.get(piece, (score, -own.start)), (score, -own.start))
                elif a >= OVERLAP and b >= OVERLAP:
                    row = (self.ids[e], own.start, score, a, b)
                    best[row[0]] = max(best.get(row[0], row), row, key=lambda r: (r[2], -r[1]))
        grams = None
        for of, got in pieces.items():
            held, answer = len(got) / len(self.pieces[of]), self.apart[of]
            if held < PIECES:
                continue
            grams = grams or self._grams(words)
            b = len(answer & grams) / len(answer) if answer else 1.0
            if b >= OVERLAP:
                score, start = max(got.values())
                row = (of[0], -start, score, held, b)
                best[of[0]] = max(best.get(of[0], row), row, key=lambda r: (r[2], -r[1]))
        return list(best.values())

    @staticmethod
    def _grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
        """All that a trigram of a question or answer may be: three words in a row, or fewer where it has no more."""
        return trigrams(words) | {(w,) for w in words} | set(zip(words, words[1:], strict=False))


def indexes(items: DataFrame, threshold: float = THRESHOLD, most: int = INDEX_ENTRIES) -> list[Index]:
    """items (item_id, text) -> indexes of about `most` entries at most, with statistics over all items.

    Null or wordless texts have no entry; rows with a null item_id take no part; repeated items give repeated entries of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(i, *e) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for e in entries_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.binary())), *(pa.array([r[c] for r in rows], pa.list_(pa.binary())) for c in (2, 3)), pa.array([r[4] for r in rows], pa.binary())], ["item_id", "question", "answer", "apart", "of"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    entries = written(rows.mapInArrow(run, "item_id long, question array<binary>, answer array<binary>, apart array<binary>, of binary"), "entries")
    stats = entries.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("question") + F.size("answer")).alias("mean")).first()
    if not stats["n"]:
        return []
    parts = -(-stats["n"] // most)
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))  # all pieces of an item in one
    terms = entries.select(part.alias("part"), F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
    df = written(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    out = []
    for p in range(parts):
        own = [(r["item_id"], [bytes(w) for w in r["question"]], [bytes(w) for w in r["answer"]], [bytes(w) for w in r["apart"]], bytes(r["of"])) for r in entries.filter(part == p).orderBy("item_id").collect()]
        counts = df if parts == 1 else df.join(terms.filter(F.col("part") == p).select("term").distinct(), "term", "left_semi")
        out.append(Index(own, {bytes(r["term"]): r["df"] for r in counts.collect()}, stats["n"], stats["mean"], threshold))
    return out


FOUND = "item_id long, passage long, score double, question_share double, answer_share double"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = INDEX_ENTRIES) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, passage (its first word), score, question_share, answer_share.

    One row for each row of docs and item that it leaks. Null and empty texts leak nothing. Indexes are broadcast one by
    one, each of bounded size; texts are not shuffled.
    """
    spark = docs.sparkSession
    names = [f.split(" ")[0] for f in FOUND.split(", ")]
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL")
    out = spark.createDataFrame([], rows.select("doc_id").schema).selectExpr("doc_id", *[f"CAST(NULL AS {f.split(' ')[1]}) AS {f.split(' ')[0]}" for f in FOUND.split(", ")])
    for index in indexes(items, threshold, most):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                got = [shared.value.matches(t) for t in batch.column("text").to_pylist()]
                found = [m for ms in got for m in ms]
                row = pa.array(np.repeat(np.arange(len(got)), [len(ms) for ms in got]))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), *(pa.array([m[c] for m in found], kind) for c, kind in enumerate(kinds))], ["doc_id", *names])

        out = out.unionByName(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}"))
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id leaks an item; rows with a null doc_id stay."""
    found = written(leaks(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against benchmark: doc_id, item_id, passage, score, question_share, answer_share of every leak."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
