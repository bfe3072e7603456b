"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is the bitwise majority of 64-bit shingle hashes. To link fingerprints that differ in at most k bits, the
64 bits are cut into floor(k / 2) + 1 segments: in one of them such a pair differs in at most one bit. Every fingerprint
is indexed under all its one-wildcard segment variants (a segment with one bit deleted), an equality join on the variant
brings candidates together, and the full distance is verified.

The join is a repartition and sort by variant, read as runs. Within a run pairs are compared in blocks of numpy; a long
run gives a spanning forest of its links, not all pairs. A run beyond MOST_IN_RUN is passed on and indexed again by the
variants of its remaining bits, which keeps every link because the same argument holds for those bits; as fingerprints
are distinct, each level leaves fewer of a run, and it ends.

Removal of near-duplicates takes these links first, verifies them on whole shingle sets, and completes them: fingerprints
of texts at the wanted similarity may lie further apart, so an exact index of shingle prefixes finds the other pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, slices, small_batches, table, written
from .components import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Runs up to this size give all their links; longer ones a spanning forest.
SHORT_RUN = 16
#: Members of a run that one task compares at most (8 bytes each).
MOST_IN_RUN = 32_768
SHINGLES_AT_ONCE = 65_536


def shingle_spans(words: list[bytes], size: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The words joined by spaces, and where each shingle of it starts and ends. Fewer words than size: one shingle; none: none."""
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n, initial=-1))[1:]
    if not words:
        return b"", []
    starts = [0, *(e + 1 for e in ends[:-1])]
    return b" ".join(words), list(zip(starts, ends[size - 1 :], strict=False)) if len(words) > size else [(0, ends[-1])]


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased (A-Z) words of a UTF-8 text, repeats included."""
    joined, spans = shingle_spans(text.lower().split(), size)
    h = xxhash.xxh64_digest
    return np.frombuffer(b"".join([h(joined[a:b], seed) for a, b in spans]), dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give 0."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + SHINGLES_AT_ONCE].astype(">u8"))
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", sizes: tuple[int, ...] = (SHINGLE,), seed: int = SEED) -> DataFrame:
    """docs without its text, with a bigint column fp<size> per shingle size. A null text counts as empty; an empty one has fingerprint 0."""
    names = [f"fp{s}" for s in sizes]
    keep = [c for c in docs.columns if c != text and c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias(source := fresh_name("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            texts = batch.column(source).to_pylist()
            made = [pa.array([majority(shingle_hashes(t, s, seed)) for t in texts], pa.int64()) for s in sizes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])

    schema = rows.drop(source).schema
    for n in names:
        schema = schema.add(n, "long")
    return rows.mapInArrow(run, schema)


def cut(bits: list[int], parts: int) -> list[list[int]]:
    """bits in order, in parts of equal length, the longer ones first."""
    n, more = divmod(len(bits), parts)
    at, out = 0, []
    for i in range(parts):
        out.append(bits[at : at + n + (i < more)])
        at += n + (i < more)
    return [x for x in out if x]


def variants(bits: list[int], parts: int) -> list[int]:
    """Masks of the one-wildcard variants of these bits: each segment less one of its bits."""
    return [sum(1 << b for b in seg if b != gone) for seg in cut(bits, parts) for gone in seg]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers: keys stay exact and spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forest(fps: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that span the links among fps. Whoever has been reached is compared no more."""
    left = np.arange(len(fps))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= most_bits
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), x))
                b.append(got)
                queue.extend(got.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def _run_links(keys: np.ndarray, fps: np.ndarray, most_bits: int, masks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs in rows sorted by key. masks: those of the first level, to give a pair under one of its variants only."""
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    longs = np.diff(np.r_[new, len(keys)])
    size = np.repeat(longs, longs)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    short = np.flatnonzero((size > 1) & (size <= SHORT_RUN))
    for off in range(1, SHORT_RUN):
        i = short[short + off < len(keys)]
        i = i[keys[i] == keys[i + off]]
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + off]) <= most_bits]
        a.append(i)
        b.append(i + off)
    for at, n in zip(new[longs > SHORT_RUN], longs[longs > SHORT_RUN], strict=True):
        x, y = _forest(fps[at : at + n], most_bits)
        a.append(at + x)
        b.append(at + y)
    if not a:
        return np.empty(0, int), np.empty(0, int)
    i, j = np.concatenate(a), np.concatenate(b)
    if masks is not None:
        # A pair counts under the first variant that it shares. A forest's pair of a later variant is left to the run of
        # the first one, where both are and whose forest joins them; so nothing is cut off.
        first = np.argmax(((fps[i] ^ fps[j])[:, None] & masks[None, :]) == 0, axis=1)
        own = first == (keys[i] & np.uint64(63)).astype(np.int64)
        i, j = i[own], j[own]
    return i, j


INDEXED = "key long, fp long, fixed long"
LINKED = "u long, v long, key long, fp long, fixed long"


def _index(parts: int):
    """(fp, key, fixed: the bits that the key holds already) -> a row per variant of the other bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            fp, key, fixed = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "key", "fixed"))
            for at in range(0, len(fp), 4096):
                s = slice(at, at + 4096)
                for have in np.unique(fixed[s]).tolist():
                    if have not in masks:
                        masks[have] = np.array(variants([b for b in range(64) if not have >> b & 1], parts), dtype=np.uint64)
                    m, i = masks[have], np.flatnonzero(fixed[s] == np.uint64(have)) + at
                    v = np.broadcast_to(np.arange(len(m), dtype=np.uint64), (len(i), len(m)))
                    kept = fp[i][:, None] & m
                    # at the first level the low six bits tell the variant; the rest is spread, and a clash only adds a pair that is verified anyway
                    new = (_mixed(kept ^ (v << np.uint64(58)) ^ _mixed(key[i])[:, None] * np.uint64(have != 0)) & ~np.uint64(63)) | (v & np.uint64(63))
                    cols = [new, np.repeat(fp[i], len(m)), np.broadcast_to(m | np.uint64(have), kept.shape)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).reshape(-1).view(np.int64)) for c in cols], ["key", "fp", "fixed"])

    return run


def _link(most_bits: int, masks: np.ndarray | None):
    """Rows sorted by key -> links (u, v), or, of runs that are too long, the rows themselves."""
    names = [x.split(" ")[0] for x in LINKED.split(", ")]

    def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
        none = pa.nulls(len(rows[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *(pa.array(c.view(np.int64)) for c in rows)], names)

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _run_links(rows[0], rows[1], most_bits, masks)
        u, v = rows[1][a], rows[1][b]
        u, v = u[u != v], v[u != v]
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), *[pa.nulls(len(u), pa.int64())] * 3], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64)] * 3
        hot: np.uint64 | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp", "fixed")]
            rows = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            while len(rows[0]):
                keys = rows[0]
                if hot is not None:
                    n = int(np.searchsorted(keys != hot, True)) if (keys != hot).any() else len(keys)
                    if n:
                        yield passed([c[:n] for c in rows])
                    rows = [c[n:] for c in rows]
                    if len(rows[0]):
                        hot = None
                    continue
                last = int(np.argmax(keys == keys[-1]))  # where the run that may go on begins
                if len(keys) - last > MOST_IN_RUN:
                    hot = keys[-1]
                if last:
                    big = [c[:last] for c in rows]
                    for part in _without_hot(big):
                        yield passed(part[1]) if part[0] else links(part[1])
                rows = [c[last:] for c in rows]
                if hot is None:
                    break
            held = rows
        if len(held[0]):
            yield links(held)

    return run


def _without_hot(rows: list[np.ndarray]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Complete runs, those beyond MOST_IN_RUN apart."""
    new = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
    longs = np.diff(np.r_[new, len(rows[0])])
    hot = np.repeat(longs > MOST_IN_RUN, longs)
    for kind in (False, True):
        if (hot == kind).any():
            yield kind, [c[hot == kind] for c in rows]


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """fps (fp: distinct bigints) -> (u, v) of fingerprints: enough links to span all pairs that differ in at most most_bits bits. All links of short runs are given, a spanning forest of long ones; pairs may repeat."""
    parts = most_bits // 2 + 1
    none = F.lit(0).cast("long")
    rows = fps.filter("fp IS NOT NULL").select("fp", none.alias("key"), none.alias("fixed"))
    found, masks = None, np.array(variants(list(range(64)), parts), dtype=np.uint64)
    while True:
        indexed = rows.mapInArrow(_index(parts), INDEXED).repartition("key").sortWithinPartitions("key")
        out = written(indexed.mapInArrow(_link(most_bits, masks), LINKED), "linked")
        some = out.filter("u IS NOT NULL").select("u", "v")
        found = some if found is None else found.unionByName(some)
        rows, masks = out.filter("u IS NULL").select("fp", "key", "fixed"), None
        if not rows.take(1):
            return found


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_components(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """prints (doc_id, fp) -> (doc_id, fp, component_id): the smallest doc_id that links reach, one row per row.

    Rows of one fingerprint meet in map-side minima before anything is indexed, so copies cost one entry. Null doc_ids
    are kept; they name a component only if it has no other id.
    """
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    comp = components(links(each.select("fp"), most_bits))
    named = comp.join(each, comp["node"] == each["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = comp.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    label = each.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(written(label, "labels"), "fp")


# --- removal of near-duplicates ---

#: Words of a shingle, and similarity.
NEAR_WORDS, SIMILARITY = 5, 0.8
#: Shingles are counted in one of so many texts; those met in LEAST_COMMON of them come last in every text's order, the commonest MOST_COMMON at most.
SAMPLED, LEAST_COMMON, MOST_COMMON = 16, 4, 1_000_000
#: A run longer than LONG_RUN in which more pairs than this for each member can be near, or which has more than SCANNED pairs, gives each member's pairs with NEIGHBOURS others only, for ROUNDS rounds at most or until one joins little; then all pairs that are left are verified.
PAIRS_A_MEMBER, LONG_RUN, SCANNED, NEIGHBOURS, ROUNDS = 16, 64, 8_000_000, 4, 3
#: Pairs that one task compares at once.
AT_ONCE = 250_000
#: Keys of texts (some 50 bytes each) that are broadcast at most; more are joined by a shuffle of the texts.
BROADCAST_TEXTS = 200_000
#: Nodes that a task remembers, to index copies once.
REMEMBERED = 100_000


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size)).astype("<u8")


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, ordered as all sets are: rare ones by their hash, then common ones. Two sets that reach the similarity share one of these; a set without shingles has 0."""
    if not len(shingles):
        return np.zeros(1, dtype="<u8")
    often = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), dtype=bool)
    n = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return np.concatenate([shingles[~often], shingles[often]])[:n]


SKETCH = ["s0", "s1", "s2", "s3"]
SKETCH_BYTES = 8 * len(SKETCH)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bytes of parities: how many shingles fall on each bit, of two bits a shingle at least and a power of two. Two sets differ in at least as many shingles as their parities differ in bits."""
    bits = max(8 * SKETCH_BYTES, 2 << max(len(shingles) - 1, 0).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(parity: np.ndarray, to: int) -> np.ndarray:
    """The parities of the same set on fewer bits."""
    while len(parity) > to:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """texts (digest, text) -> the sorted hashes of shingles that occur in many texts. They say only in which order shingles are indexed, so a sample does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    sample = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(SAMPLED)) == 0).select("text")
    counted = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COMMON)
    found = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _prints(size: int, similarity: float, shared):
    """(doc_id, digest, text) -> doc_id, digest, node (of the set), n (shingles in it), fp (of the set), sketch, parity, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) for s in sets]
            parity = [parities(s) for s in sets]
            bits = np.frombuffer(b"".join(folded(p, SKETCH_BYTES).tobytes() for p in parity), dtype="<i8").reshape(-1, len(SKETCH))
            first = [prefix(s, shared.value, similarity).astype("<u8").tobytes() for s in sets]
            made = [pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), *(pa.array(b) for b in np.ascontiguousarray(bits.T)), pa.array([p.tobytes() for p in parity], pa.binary()), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *made], ["doc_id", "digest", "node", "n", "fp", *SKETCH, "parity", "prefix"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, prefix) -> (key, node), of each node once in a task."""
    seen: set[int] = set()
    for batch in slices(batches, "prefix"):
        if len(seen) > REMEMBERED:
            seen.clear()
        new = []
        for i, node in enumerate(batch.column("node").to_pylist()):
            if node not in seen:
                seen.add(node)
                new.append(i)
        batch = batch.take(pa.array(new, pa.int64()))
        first = [np.frombuffer(p, dtype="<i8") for p in batch.column("prefix").to_pylist()]
        row = pa.array(np.repeat(np.arange(len(first)), [len(p) for p in first]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first) if first else np.empty(0, np.int64)), batch.column("node").take(row)], ["key", "node"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column -> the same columns, cut where that column changes only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.argmax(rows[0] == rows[0][-1]))
        if last or (held and held[-1][0][-1] != rows[0][0]):
            if held and held[-1][0][-1] != rows[0][0]:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            if last:
                yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in rows], strict=True)]
                held = []
        held.append([c[last:] for c in rows])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by key and node, each once, without the keys that only one node has."""
    for key, node in _runs(batches):
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[once], node[once]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        longs = np.diff(np.r_[new, len(key)])
        more = np.repeat(longs > 1, longs)
        yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (key, node)], ["key", "node"])


def _pairs(similarity: float, turn: int | None):
    """Postings (key, node, n, group, sketch) sorted by key -> pairs u < v of a run that are of two groups and can be near by sizes and sketches.

    All of them; but in a turn a long run with many pairs gives only each member's neighbours in an order of that turn,
    and a row (null, pairs of two groups in it) that says so.
    """
    apart = (1 - similarity) / (1 + similarity)  # of both sizes, what near sets differ in at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def can(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[ok], j[ok]
            differ = sum((np.bitwise_count((b[i] ^ b[j]).view(np.uint64)).astype(np.int64) for b in bits), np.zeros(len(i), dtype=np.int64))
            ok = differ <= apart * (n[i] + n[j]) + 1e-9
            return i[ok], j[ok]

        def told(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            u, v = node[i], node[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        def all_of(at: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = max(1, AT_ONCE // m)
            for a in range(0, m, step):
                i, j = np.nonzero(np.arange(a, min(a + step, m))[:, None] < np.arange(m)[None, :])
                yield can(at + a + i, at + j)

        for key, node, n, group, *bits in _runs(batches):
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            longs = np.diff(np.r_[new, len(key)])
            size = np.repeat(longs, longs)
            short = np.flatnonzero(size <= LONG_RUN)
            for off in range(1, LONG_RUN):
                i = short[short + off < len(key)]
                i = i[key[i] == key[i + off]]
                if not len(i):
                    break
                yield told(*can(i, i + off))
            for at, m in zip(new[longs > LONG_RUN].tolist(), longs[longs > LONG_RUN].tolist(), strict=True):
                _, each = np.unique(group[at : at + m], return_counts=True)
                left = (m * m - int((each.astype(np.int64) ** 2).sum())) // 2
                if not left:
                    continue
                if turn is None:
                    yield from (told(*pair) for pair in all_of(at, m))
                    continue
                found, total, many = [], 0, m * (m - 1) // 2 > SCANNED
                for pair in all_of(at, m) if not many else ():
                    found.append(pair)
                    total += len(pair[0])
                    if many := total > PAIRS_A_MEMBER * m:
                        break
                if not many:
                    yield from (told(*pair) for pair in found if len(pair[0]))
                    continue
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([left], pa.int64())], ["u", "v"])
                order = at + np.argsort(_mixed(node[at : at + m].view(np.uint64) ^ np.uint64(turn)))
                yield told(*can(np.full(m - 1, order[0]), order[1:]))
                for off in range(1, NEIGHBOURS + 1):
                    yield told(*can(order[:-off], order[off:]))

    return run


def _sets(size: int):
    """(node, text) -> (node, set), of each node once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            if len(seen) > REMEMBERED:
                seen.clear()
            new = {node: t for node, t in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True) if node not in seen}
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([shingle_set(t, size).tobytes() for t in new.values()], pa.binary())], ["node", "set"])

    return run


def _can_be_near(similarity: float):
    """(u, v, nu, nv, a, b: parities) -> the pairs that their parities don't prove apart."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y, n) in enumerate(zip(batch.column("a"), batch.column("b"), (batch.column("nu").to_numpy() + batch.column("nv").to_numpy()).tolist(), strict=True)):
                a, b = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                to = min(len(a), len(b))
                if int(np.bitwise_count((folded(a, to) ^ folded(b, to)).view(np.uint64)).sum()) <= apart * n + 1e-9:
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = np.frombuffer(a.as_py(), dtype="<u8"), np.frombuffer(b.as_py(), dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _listed(keys: DataFrame) -> DataFrame:
    """keys, a written table, to be broadcast if it has BROADCAST_TEXTS rows at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys


def confirmed(pairs: DataFrame, docs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs (u, v) of nodes those whose whole sets reach the similarity. Parities turn most others away before sets travel."""
    half = lambda c, s, n: texts.select(F.col("node").alias(c), F.col("n").alias(n), F.col("parity").alias(s))
    rough = pairs.join(half("u", "a", "nu"), "u").join(half("v", "b", "nv"), "v").select("u", "v", "nu", "nv", "a", "b")
    rough = written(rough.mapInArrow(_can_be_near(similarity), "u long, v long"), "rough")
    nodes = rough.select(F.col("u").alias("node")).unionByName(rough.select(F.col("v").alias("node"))).distinct()
    wanted = _listed(written(texts.join(nodes, "node").select("node", F.col("least.digest").alias("_digest"), F.col("least.doc_id").alias("_id")), "wanted"))
    own = docs.select("doc_id", _digest().alias("digest"), _body().alias("text"))
    bodies = own.join(wanted, (own["digest"] == wanted["_digest"]) & own["doc_id"].eqNullSafe(wanted["_id"]))
    with small_batches(docs.sparkSession):
        sets = written(bodies.select("node", "text").mapInArrow(_sets(size), "node long, set binary").dropDuplicates(["node"]), "sets")
    both = rough.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    with small_batches(docs.sparkSession):
        return written(both.select("u", "v", "a", "b").mapInArrow(_verified(similarity), "u long, v long"), "near")


def _body() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def _digest() -> Column:
    return F.unhex(F.sha2(_body(), 256))


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """texts (node, fp) -> pairs of nodes whose fingerprints are near: of each fingerprint all with its least node, and the least nodes of linked fingerprints."""
    heads = written(texts.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")), "heads")
    same = texts.select("node", "fp").join(heads.filter("m > 1"), "fp").filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    near = links(heads.select("fp")).select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(heads.select(F.col("fp").alias("fu"), F.col("head").alias("x")), "fu").join(heads.select(F.col("fp").alias("fv"), F.col("head").alias("y")), "fv")
    return written(same.unionByName(near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))).distinct(), "candidates")


def near_groups(docs: DataFrame, texts: DataFrame, postings: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, component) of texts: components of all pairs of sets that reach the similarity.

    SimHash links come first. Then shared prefixes bring all other pairs together, of which only those of two groups are
    verified, groups being the components so far: within one, nothing can be added.
    """
    links = confirmed(simhash_pairs(texts), docs, texts, size, similarity)
    turn, before = 0, float("inf")
    while True:
        groups = components(links)
        told = texts.select("node", "n", *SKETCH).join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
        rows = postings.join(told, "node").repartition("key").sortWithinPartitions("key").select("key", "node", "n", "group", *SKETCH)
        found = written(rows.mapInArrow(_pairs(similarity, turn), "u long, v long").distinct(), "pairs")
        left = found.filter("u IS NULL").agg(F.sum("v")).first()[0] or 0
        links = links.unionByName(confirmed(found.filter("u <> v"), docs, texts, size, similarity))
        if not left:
            return components(links)
        turn = None if turn is None or turn + 1 >= ROUNDS or left > before / 2 else turn + 1
        before = left


def drop_near_duplicates(docs: DataFrame, size: int = NEAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group of near-duplicates, that with the smallest doc_id; all columns stay.

    Two texts are linked if the Jaccard similarity of their sets of `size`-word shingles (lower-cased A-Z) reaches
    `similarity`; groups are connected components; texts of equal sets are of one group, empty and null ones too,
    repeated rows count as copies. Candidates are texts with near SimHash fingerprints of their sets, then all that
    share one of their first shingles in a common order, as sets at the similarity must: nothing is missed. Every pair
    is verified on the whole sets unless both are of one group already or sizes and parities prove them apart. Texts of
    one set cost one entry. A null doc_id is kept only where its group has no other.
    """
    own = docs.select("doc_id", _digest().alias("digest"), _body().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(own, size))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, node long, n long, fp long, {', '.join(f'{c} long' for c in SKETCH)}, parity binary, prefix binary"
    with small_batches(docs.sparkSession):
        prints = written(own.mapInArrow(_prints(size, similarity, shared), schema), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    texts = written(prints.groupBy("node").agg(F.min(order).alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", *SKETCH, "parity")]), "texts")
    found = prints.select("node", "prefix").mapInArrow(_postings, "key long, node long")
    postings = written(found.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_repeated, "key long, node long"), "postings")
    linked = near_groups(docs, texts, postings, size, similarity)
    named = texts.select("node", "least").join(linked, "node", "left").withColumn("group", F.coalesce("component", "node"))
    first = named.groupBy("group").agg(F.min("least").alias("first"))
    # rows that go: those that aren't the first of their group
    kept = named.join(first, "group").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    labels = written(prints.select("doc_id", "digest", "node").join(kept, "node").select("doc_id", "digest", ((F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("stays")), "stays")
    gone = _listed(written(labels.filter("NOT stays").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "gone"))
    own_digest = fresh_name("digest")
    marked = docs.withColumn(own_digest, _digest())
    out = marked.join(gone, marked["doc_id"].eqNullSafe(gone["_id"]) & (marked[own_digest] == gone["_digest"]), "left_anti")
    if labels.filter("stays").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        out = out.dropDuplicates(["doc_id", own_digest])
    return out.select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: doc_id, fingerprint, component_id."""
    prints = written(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed(f"fp{SHINGLE}", "fp"), "fingerprints")
    return near_components(prints).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
