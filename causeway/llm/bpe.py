"""BPE encoding and decoding through a distinct-word table.

A word is a run without white space; the tokenizer's own splitting never crosses white space, so the ids of a text are
those of its words one after another. Words are counted over all texts (map-side first), a word is encoded once, and the
ids go back to the texts by position.

The join back is in two parts. Words above a count that leaves at most `head` of them are broadcast (bounded in rows
and in length); every other word is encoded where it stands, once per task's table. A shuffled join at each position
would move several times the input.

What a Python worker makes of the vocabulary and of the broadcast words hangs on the broadcasts' values: Spark takes
broadcasts from a worker with the first task that doesn't use them, so nothing is left in it for the operators after.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_name, slices, table, written

#: Words that are broadcast, at most, and the longest of them.
HEAD_WORDS, HEAD_CHARS = 131_072, 64
#: Words that a task keeps at most besides; then it starts its own table anew.
OWN_WORDS = 150_000
WORDS_AT_ONCE = 2_048
#: Bytes of texts that are encoded at once; words, rows, ids and pieces take some ten times that.
TEXT_AT_ONCE = 2_000_000

_ODD = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def split_words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


class Vocabulary:
    """A tokenizer's file; a process that is asked for the tokenizer or its pieces makes them once. Only the path travels."""

    def __init__(self, path: str):
        self.path = path

    def __reduce__(self):
        return Vocabulary, (self.path,)

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_padding()
        t.no_truncation()
        return t

    @cached_property
    def pieces(self) -> np.ndarray:
        out = np.empty(self.tokenizer.get_vocab_size(), dtype=object)
        out[:] = [self.tokenizer.id_to_token(i) for i in range(len(out))]
        return out

    def encoded(self, words: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(words), WORDS_AT_ONCE) for e in self.tokenizer.encode_batch_fast(words[at : at + WORDS_AT_ONCE], add_special_tokens=False)]

    def decoded(self, ids: np.ndarray) -> str:
        return " ".join(self.pieces[ids].tolist())


class WordTable(dict):
    """word -> row; the ids of a row are flat[start : start + long]. A word that isn't there gets a row, whose ids come with the next fill()."""

    def __init__(self, vocabulary: Vocabulary, words: list[str], longs: np.ndarray, flat: np.ndarray):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.vocabulary, self.head = vocabulary, (words, longs, flat)
        self.longs, self.flat = longs.astype(np.int64), flat.astype(np.uint32)
        self.starts = np.cumsum(self.longs) - self.longs
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.pending.append(word)
        return row

    def fill(self) -> None:
        if self.pending:
            ids = self.vocabulary.encoded(self.pending)
            longs = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(longs.sum()))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(longs) - longs])
            self.longs, self.flat = np.concatenate([self.longs, longs]), np.concatenate([self.flat, flat])
            self.pending = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > len(self.head[0]) + OWN_WORDS:
            self.clear()
            self.__init__(self.vocabulary, *self.head)
        rows = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in map(split_words, texts)]
        self.fill()
        out = []
        for r in rows:
            longs = self.longs[r]
            before = np.cumsum(longs) - longs
            out.append(self.flat[np.repeat(self.starts[r] - before, longs) + np.arange(int(longs.sum()))])
        return out


class Head:
    """The words that are broadcast, the number of ids of each, and the ids. A process makes its table of them once."""

    def __init__(self, words: list[str], longs: np.ndarray, flat: np.ndarray):
        self.parts, self._table = (words, longs, flat), None

    def __reduce__(self):
        return Head, self.parts

    def table(self, vocabulary: Vocabulary) -> WordTable:
        if self._table is None:
            self._table = WordTable(vocabulary, *self.parts)
        return self._table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["word", "n"])

    for batch in slices(batches, "text", TEXT_AT_ONCE):
        for text in batch.column("text").to_pylist():
            if text:
                count.update(split_words(text))
        if len(count) > OWN_WORDS:
            yield out()
            count.clear()
    if count:
        yield out()


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """Every distinct word of all texts: word, n. Null and empty texts have none."""
    return docs.select(F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(spark: SparkSession, path: str) -> Broadcast[Vocabulary]:
    return spark.sparkContext.broadcast(Vocabulary(path))


def encoded_words(counted: DataFrame, vocabulary: Broadcast[Vocabulary]) -> DataFrame:
    """word, n -> word, n, ids array<int>."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = vocabulary.value.encoded(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return counted.mapInArrow(encode, "word string, n long, ids array<int>")


def word_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """Every distinct word of all texts, encoded: word, n, ids."""
    return encoded_words(word_counts(docs, text), _shared(docs.sparkSession, path))


def head_of(counted: DataFrame, vocabulary: Broadcast[Vocabulary], most: int = HEAD_WORDS) -> Head:
    """The words whose count is over a bound that leaves at most `most` of them, encoded."""
    short = counted.filter(F.length("word") <= HEAD_CHARS)
    # how many words have each power of two of a count: at most 64 rows, whatever the corpus
    steps = {r["e"]: r["k"] for r in short.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("k")).collect()}
    total, least = 0, None
    for e in sorted(steps, reverse=True):
        total += steps[e]
        if total > most:
            break
        least = e
    if least is None:
        return Head([], np.empty(0, np.int64), np.empty(0, np.uint32))
    rows = encoded_words(short.filter(F.floor(F.log2("n")) >= least), vocabulary).select("word", "ids").toArrow().combine_chunks()
    ids = rows.column("ids")
    return Head(rows.column("word").to_pylist(), pa.compute.list_value_length(ids).to_numpy().astype(np.int64), pa.compute.list_flatten(ids).to_numpy().astype(np.uint32))


def _mapped(docs: DataFrame, text: str, path: str, fields: dict[str, pa.DataType], ddl: str, made: Callable[[list[np.ndarray], Vocabulary], list[list]], most: int, with_text: bool = True) -> DataFrame:
    """docs with fields made of the texts' ids; columns of those names are replaced, all others pass (the text only with_text)."""
    spark = docs.sparkSession
    vocabulary = _shared(spark, path)
    head = spark.sparkContext.broadcast(head_of(written(word_counts(docs, text), "words"), vocabulary, most))
    keep = [c for c in docs.columns if c not in fields and (c != text or with_text)]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(source := fresh_name("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = head.value.table(vocabulary.value)
        for batch in slices(batches, source, TEXT_AT_ONCE):
            ids = words.encode(batch.column(source).to_pylist())
            new = [pa.array(c, t) for c, t in zip(made(ids, vocabulary.value), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *fields])

    return rows.mapInArrow(run, StructType(rows.drop(source).schema.fields + StructType.fromDDL(ddl).fields))


def encode(docs: DataFrame, path: str, text: str = "text", most: int = HEAD_WORDS) -> DataFrame:
    """docs with ids (array<int>) and n_tokens. A null or empty text has no ids; repeated rows are encoded alike; an empty table stays empty."""
    return _mapped(docs, text, path, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}, "ids array<int>, n_tokens long", lambda ids, _: [[x.astype(np.int32) for x in ids], [len(x) for x in ids]], most)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the text of its ids: every id joined to its piece. Null ids give the empty text; an id without a piece fails the job."""
    keep = [c for c in encoded.columns if c != "decoded"]
    vocabulary = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [vocabulary.value.decoded(np.asarray(x, dtype=np.int64)) if x else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "decoded"])

    return encoded.mapInArrow(run, encoded.select(*keep).schema.add("decoded", "string"))


def round_trips(docs: DataFrame, path: str, text: str = "text", most: int = HEAD_WORDS) -> DataFrame:
    """docs with n_tokens, ids_sha256 (little-endian unsigned 32-bit ids) and decoded_sha256 (the decoded text in UTF-8), without its text: neither texts nor ids leave the tasks."""

    def made(ids: list[np.ndarray], vocabulary: Vocabulary) -> list[list]:
        return [[len(x) for x in ids], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [hashlib.sha256(vocabulary.decoded(x).encode()).hexdigest() for x in ids]]

    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(docs, text, path, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", made, most, False)


def tokenized(docs: DataFrame, path: str, text: str = "text", most: int = HEAD_WORDS) -> DataFrame:
    """docs without its text, with ids, n_tokens and decoded_sha256 (of the text that the ids decode to)."""

    def made(ids: list[np.ndarray], vocabulary: Vocabulary) -> list[list]:
        return [[x.astype(np.int32) for x in ids], [len(x) for x in ids], [hashlib.sha256(vocabulary.decoded(x).encode()).hexdigest() for x in ids]]

    return _mapped(docs, text, path, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded_sha256": pa.string()}, "ids array<int>, n_tokens long, decoded_sha256 string", made, most, False)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trips(docs, vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
