"""Cross-tokenizer alignment: groups of two tokenizers' tokens that cover the same bytes, and links weighed over the corpus.

A text is encoded by A (byte-level BPE, on a space and the text) and by B (pieces with byte fallback, on the text, which it
prefixes with a space itself). Both give the same bytes. Each side's cumulative ends go into a dictionary from end to
index; the keys that both hold, sorted, slice the two id lists into groups; inside a group every A token is linked with
every B token. A pair of ids counts as many documents as hold it linked.

Neither tokenizer's tokens cross from a non-blank character into a space, so a text is cut into chunks there (`chunks_of`),
and every chunk's end is an end on both sides. A task encodes and aligns each distinct chunk once (`ChunkTable`) and a
text is a sum over its chunks. `Pair.check` refuses vocabularies for which that doesn't hold.

One pass over the texts writes each row's figures and its distinct pairs with their links. Counting reads the pairs
(summed within a task before the shuffle), and a last pass adds the counts up. Pairs above a count that leaves at most
`most` of them are broadcast; the others leave the last pass as rows and are joined to the counted table by a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_name, slices, table, written

#: Counted pairs that are broadcast at most (20 bytes each).
HEAD_PAIRS = 2_000_000
#: Chunks and tokens that a task's table holds before it lets go of all but the KEPT_CHUNKS used most, and pairs that a task counts before it passes them on.
OWN_CHUNKS, OWN_TOKENS, KEPT_CHUNKS, OWN_PAIRS = 400_000, 8_000_000, 200_000, 4_000_000
CHUNKS_AT_ONCE = 4_096
#: A group of more links than this is expanded by its distinct ids.
BIG = 4_096

_UNEVEN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def chunks_of(text: str) -> list[str]:
    """A space and the text, cut before every space that follows a non-blank character; each chunk without its first space."""
    spaced = " " + text
    if _UNEVEN.search(spaced):
        return [c[1:] for c in _CUT.split(spaced)]
    return text.split(" ")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, and per id the bytes it stands for."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.check(pieces)
        self.a_longs, self.b_longs = (np.array([len(b) for b in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id in decimal with what follows it: nothing, ",", "|" or ";"
        self.written = [[f"{i}{s}".encode() for i in range(max(len(tokens), len(pieces)))] for s in ("", ",", "|", ";")]
        self.written_long = np.array([[len(w) for w in x] for x in self.written], dtype=np.int64)

    def check(self, pieces: list[str]) -> None:
        """Refuses a B with a piece that goes on from a non-blank into a space: chunks would not be independent then."""
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("tokenizer B has pieces across spaces")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        return a, [ids or [self.space] for ids in self.b.encode(chunks, num_threads=1)]

    @property
    def space(self) -> int:
        """B's piece of the space alone: an empty chunk is the space before it."""
        return self.b.piece_to_id("▁")


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Per group the number of A tokens and of B tokens up to its end: the ends that both sides have, in order."""
    a, b = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a.keys() & b.keys())
    return list(map(a.__getitem__, common)), list(map(b.__getitem__, common))


def _spread(starts: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of each run, one after another."""
    before = np.cumsum(longs) - longs
    return np.repeat(starts - before, longs) + np.arange(int(longs.sum()))


class Aligned:
    """Chunks encoded and aligned together. Per chunk: na, nb, groups, links (odd ones: bytes differ; all zero), text (bytes of its groups), and pairs[p0 : p0 + pn] with times[...]."""

    def __init__(self, of: Pair, chunks: list[str]):
        a, b = of.encode(chunks)
        self.odd = self._odd(of, chunks, a, b)
        if self.odd.any():
            a, b = ([[] if odd else x for x, odd in zip(side, self.odd, strict=True)] for side in (a, b))
        self.na, self.nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, self.na), (b, self.nb)))
        # all chunks as one run of bytes: their own ends are ends of both sides
        ends_a, ends_b = (list(accumulate(long[ids].tolist())) for long, ids in ((of.a_longs, ids_a), (of.b_longs, ids_b)))
        upto_a, upto_b = (np.array(x, dtype=np.int64) for x in cuts(ends_a, ends_b))
        at = np.searchsorted(upto_a, np.cumsum(self.na), side="right")  # groups up to each chunk's end
        self.groups = np.diff(at, prepend=0)
        in_a, in_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        of_group = np.repeat(np.arange(len(chunks)), self.groups)
        links = in_a * in_b
        self.links = np.bincount(of_group, links, len(chunks)).astype(np.int64)
        self._pairs(ids_a, ids_b, upto_a - in_a, in_a, upto_b - in_b, in_b, of_group, len(chunks))
        self.text = self._written(of, ids_a, ids_b, upto_a - in_a, in_a, upto_b - in_b, in_b, at)

    @staticmethod
    def _odd(of: Pair, chunks: list[str], *sides: list[list[int]]) -> np.ndarray:
        """Which chunks a side doesn't give back, byte for byte. They are rare, so all chunks are compared at once first."""
        spaced = [f" {c}".encode() for c in chunks]
        whole, long = b"".join(spaced), np.fromiter(map(len, spaced), np.int64, len(spaced))
        odd = np.zeros(len(chunks), dtype=bool)
        for side, table, longs in zip(sides, (of.a_bytes, of.b_bytes), (of.a_longs, of.b_longs), strict=True):
            ids = list(chain.from_iterable(side))
            n = np.fromiter(map(len, side), np.int64, len(side))
            ends = np.concatenate([[0], np.cumsum(longs[np.array(ids, dtype=np.int64)])])[np.cumsum(n)]
            if not np.array_equal(ends, np.cumsum(long)) or b"".join(map(table.__getitem__, ids)) != whole:
                odd |= np.array([b"".join(map(table.__getitem__, x)) != t for x, t in zip(side, spaced, strict=True)])
        return odd

    def _pairs(self, ids_a, ids_b, from_a, in_a, from_b, in_b, of_group, n: int) -> None:
        """Distinct pairs of each chunk with their number of links. A group of very many tokens is expanded by its distinct ids, not its occurrences."""
        big = in_a * in_b > BIG
        some = np.flatnonzero(~big)
        a_at = _spread(from_a[some], in_a[some])
        fan = np.repeat(in_b[some], in_a[some])
        left = np.repeat(ids_a[a_at], fan)
        right = ids_b[_spread(np.repeat(from_b[some], in_a[some]), fan)]
        chunk, key, times = np.repeat(np.repeat(of_group[some], in_a[some]), fan), left << 32 | right, np.ones(len(left), np.int64)
        for g in np.flatnonzero(big).tolist():
            x, nx = np.unique(ids_a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(ids_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            chunk, key, times = np.append(chunk, np.full(len(x) * len(y), of_group[g])), np.append(key, (x[:, None] << 32 | y).ravel()), np.append(times, np.outer(nx, ny).ravel())
        order = np.lexsort((key, chunk))
        chunk, key, times = chunk[order], key[order], times[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])
        firsts = np.flatnonzero(new)
        self.pairs, self.times = key[firsts], np.add.reduceat(times, firsts) if len(firsts) else times
        self.pn = np.bincount(chunk[firsts], minlength=n).astype(np.int64)
        self.p0 = np.cumsum(self.pn) - self.pn

    def _written(self, of: Pair, ids_a, ids_b, from_a, in_a, from_b, in_b, at) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 of each chunk; a chunk's last id has nothing after it."""
        ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.ones(len(ids_a) + len(ids_b), np.int64)
        ends = np.cumsum(in_a + in_b)
        starts = ends - in_a - in_b
        ids[_spread(starts, in_a)], ids[_spread(starts + in_a, in_b)] = ids_a, ids_b
        sign[starts + in_a - 1], sign[ends - 1] = 2, 3
        last = ends[at[np.diff(at, prepend=0) > 0] - 1] - 1
        sign[last] = 0
        whole = b"".join([of.written[s][i] for s, i in zip(sign.tolist(), ids.tolist(), strict=True)])
        upto = np.concatenate([[0], np.cumsum(of.written_long[sign, ids])])
        tokens = np.concatenate([[0], np.cumsum(self.na + self.nb)])
        cut = upto[tokens].tolist()
        return [whole[x:y] for x, y in zip(cut, cut[1:], strict=False)]


class ChunkTable(dict):
    """chunk -> row, kept from text to text; a chunk that isn't there gets a row, whose values come before `rows` returns."""

    def __init__(self, of: Pair):
        super().__init__()
        self.of, self.pending = of, []
        self.text: list[bytes] = []
        self.values = np.zeros((0, 5), np.int64)  # na, nb, groups, links, odd
        self.p0, self.pn, self.pairs, self.times, self.used = (np.zeros(0, np.int64) for _ in range(5))

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.pending.append(chunk)
        return row

    def shrink(self) -> None:
        """Lets go of all but the chunks used most; of those the counts are halved."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:KEPT_CHUNKS])
        names = list(self)
        self.clear()
        self.update((names[i], row) for row, i in enumerate(kept.tolist()))
        self.text = [self.text[i] for i in kept.tolist()]
        at = _spread(self.p0[kept], self.pn[kept])
        self.pairs, self.times, self.values, self.pn, self.used = self.pairs[at], self.times[at], self.values[kept], self.pn[kept], self.used[kept] // 2
        self.p0 = np.cumsum(self.pn) - self.pn

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > OWN_CHUNKS or int(self.values[:, :2].sum()) > OWN_TOKENS:
            self.shrink()
        found = [np.fromiter(map(self.__getitem__, c), np.int64, len(c)) for c in map(chunks_of, texts)]
        parts = [Aligned(self.of, self.pending[i : i + CHUNKS_AT_ONCE]) for i in range(0, len(self.pending), CHUNKS_AT_ONCE)]
        self.pending = []
        if parts:
            pn = np.concatenate([p.pn for p in parts])
            self.p0 = np.concatenate([self.p0, len(self.pairs) + np.cumsum(pn) - pn])
            self.pn, self.used = np.concatenate([self.pn, pn]), np.concatenate([self.used, np.zeros(len(pn), np.int64)])
            self.pairs, self.times = np.concatenate([self.pairs, *(p.pairs for p in parts)]), np.concatenate([self.times, *(p.times for p in parts)])
            self.values = np.concatenate([self.values, np.stack([np.concatenate([getattr(p, f) for p in parts]) for f in ("na", "nb", "groups", "links", "odd")], axis=1)])
            self.text += [t for p in parts for t in p.text]
        return found

    def told(self, rows: np.ndarray) -> tuple[list[int], str, np.ndarray, np.ndarray] | None:
        """Of a text's chunks: (na, nb, groups, links), the digest of its groups, its distinct pairs and the links of each. None if a chunk is odd."""
        each, n = np.unique(rows, return_counts=True)
        self.used[each] += n
        sums = n @ self.values[each]
        if sums[4]:
            return None
        digest = hashlib.sha256(b";".join(map(self.text.__getitem__, rows.tolist()))).hexdigest()
        at = _spread(self.p0[each], self.pn[each])
        pairs, times = self.pairs[at], self.times[at] * np.repeat(n, self.pn[each])
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        firsts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return sums[:4].tolist(), digest, pairs[firsts], np.add.reduceat(times[order], firsts)


_tables: dict[str, ChunkTable] = {}


def _chunk_table(a_path: str, b_path: str) -> ChunkTable:
    """One per Python worker and pair of tokenizers."""
    key = f"{a_path}\n{b_path}"
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(_pair(a_path, b_path))
    return _tables[key]


PLAIN = ("n_a", "n_b", "n_groups", "n_links")
PAIRS = "a array<int>, b array<int>, times array<long>"


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def aligned(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """rows (row, text) -> row, PLAIN, groups_sha256, and the distinct pairs of each text as PAIRS (A ids, B ids, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunk_table(a_path, b_path)
        for batch in slices(batches, "text"):
            plain, digests, pairs, times = [], [], [], []
            for t, r in zip(texts := batch.column("text").to_pylist(), chunks.rows([t or "" for t in texts]), strict=True):
                sums, digest, p, n = (chunks.told(r) if t else None) or ([0] * 4, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                plain.append(sums)
                digests.append(digest)
                pairs.append(p)
                times.append(n)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pairs])])
            flat, n = np.concatenate(pairs), np.concatenate(times)
            made = [pa.array(c, pa.int64()) for c in zip(*plain, strict=True)]
            lists = [_lists(x, offsets, k) for x, k in ((flat >> 32, pa.int32()), (flat & 0xFFFFFFFF, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made, pa.array(digests, pa.string()), *lists], ["row", *PLAIN, "groups_sha256", "a", "b", "times"])

    ddl = f"{', '.join(f'{n} long' for n in PLAIN)}, groups_sha256 string, {PAIRS}"
    return rows.mapInArrow(run, StructType(rows.select("row").schema.fields + StructType.fromDDL(ddl).fields))


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """All pairs of a batch, one after another."""
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    return a << 32 | b


def pair_counts(told: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n: the number of rows that hold the pair linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            held.append(_flat(batch))
            if sum(map(len, held)) > OWN_PAIRS:
                yield out()
                held = []
        if held:
            yield out()

    return told.select("a", "b").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(counted: DataFrame) -> DataFrame:
    """pair, n -> pair, n, best: whether n is the highest of its A id (ties included). A's vocabulary bounds the broadcast side."""
    a = F.shiftright("pair", 32)
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _head(counted: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of at least some count, a power of two, that leaves at most `most` of them: (that count, pairs in order with counts and bests)."""
    steps = {r["e"]: r["k"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("k")).collect()}
    total, least = 0, None
    for e in sorted(steps, reverse=True):
        total += steps[e]
        if total > most:
            break
        least = e
    if least is None:
        return 1 << 62, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    got = counted.filter(F.col("n") >= 1 << least).toArrow()
    pairs, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return 1 << least, (pairs[order], n[order], best[order].astype(bool))


def weighed(told: DataFrame, head) -> DataFrame:
    """told (from aligned) with n_best and count_sum as far as the broadcast pairs give them, and the pairs that aren't among those, with their links, as `pairs` and `more`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, is_best = head.value
        for batch in batches:
            pairs, times = _flat(batch), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            offsets = batch.column("a").offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            best, total = (np.where(known, x, 0) for x in ((times * is_best[at], times * n[at]) if len(keys) else (0, 0)))
            best, total, far = (np.concatenate([[0], np.cumsum(x)]) for x in (best, total, ~known))
            sums = [pa.array(x[offsets[1:]] - x[offsets[:-1]], pa.int64()) for x in (best, total)]
            lists = [_lists(x[~known], far[offsets], pa.int64()) for x in (pairs, times)]
            keep = ["row", *PLAIN, "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *sums, *lists], [*keep, "n_best", "count_sum", "pairs", "more"])

    schema = told.drop("a", "b", "times").schema
    return told.mapInArrow(run, StructType(schema.fields + StructType.fromDDL("n_best long, count_sum long, pairs array<long>, more array<long>").fields))


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", most: int = HEAD_PAIRS) -> DataFrame:
    """docs without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; columns of those names are replaced.

    A text that is null or empty, or whose tokens don't give back a space and the text on both sides, has zeros and an
    empty groups_sha256, and counts for no pair. Repeated rows count each and get equal values. An empty table stays empty.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in FIELDS and c != text]
    # the row goes through the tasks as one struct, so that none of its names can meet ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).alias(fresh_name("none"))]).alias("row"), F.col(f"`{text}`").alias("text"))
    told = written(aligned(rows, a_path, b_path), "aligned")
    counted = written(best_pairs(written(pair_counts(told), "pairs")), "best-pairs")
    least, head = _head(counted, most)
    done = weighed(told, spark.sparkContext.broadcast(head))
    tail = counted.filter(F.col("n") < least)
    if not tail.isEmpty():
        done = _with_tail(written(done.withColumn("id", F.monotonically_increasing_id()), "weighed"), tail)
    return done.select(*[F.col(f"row.`{c}`") for c in keep], *FIELDS)


def _with_tail(done: DataFrame, tail: DataFrame) -> DataFrame:
    """Adds what the pairs that were not broadcast give. None of them is in more documents than the broadcast's bound, so no key of this join is hot."""
    asked = done.select("id", F.explode(F.arrays_zip("pairs", "more")).alias("p")).select("id", F.col("p.pairs").alias("pair"), F.col("p.more").alias("times"))
    more = asked.join(tail, "pair").groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return done.join(more, "id", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})


def tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents aligned: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, *tokenizers())
