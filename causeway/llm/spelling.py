"""Spelling variants: all pairs of vocabulary words at one edit, by composing automata, and groups of variants under a commonest form.

Two words are near if one inserted, deleted or replaced code point makes one of the other. The pairs are what the minimised
acceptor of the vocabulary, composed with the transducer that makes one edit, composed with the acceptor again, accepts.
Nobody holds the whole acceptor: it is cut by initial states.

A pair is looked for in the class of its shorter length L. Its edit stands at the end of the longest common beginning,
position i. Either i is in the second half of the word: both words have the first half, so both reach one state of the
acceptor by it, and only what is accepted from that state needs composing. Or i is in the first half: then both have the
second half, and the acceptor read backwards gives the state. So a word goes to its two halves as shorter and as longer
word: four rows, whatever the vocabulary. A group is all words of a class with one shared part; its free parts are minimised
(Daciuk's way) and composed, pairs of states being met once each. Every pair comes out exactly once.

A group of more than `most` words is split: the free part is halved, and the words go to both halves with the other half
shared as well, until the groups are small or the free part is one place (then the alphabet bounds the group).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

#: A word of the vocabulary has so many code points and occurrences at least; a form has so many times the occurrences of its variant.
SHORTEST, RAREST, TIMES = 5, 3, 2
#: Of so many different runs in a document, one (by checksum) is misread: it loses a code point.
MISREAD = 97
#: Words of one group that a task composes at once.
MOST_WORDS = 8_192
#: Words that a task counts before it passes them on.
OWN_WORDS = 100_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def runs_of(text: str, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """(word, number) of each distinct run of letters in a text, A-Z in lower case, some misread; a word may come twice. A null doc_id misreads none."""
    before = zlib.crc32(f"{doc_id}:".encode())
    for w, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes know the lower case of A-Z alone
        if doc_id is not None and (h := zlib.crc32(w.encode(), before)) % MISREAD == 0:
            w = w[: h % len(w)] + w[h % len(w) + 1 :]
        yield w, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    for batch in slices(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w, n in runs_of(text, doc_id):
                if len(w) >= SHORTEST:
                    total[w] += n
        if len(total) > OWN_WORDS:
            yield out()
            total.clear()
    if total:
        yield out()


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n of every word that is long and common enough over all texts. A null text has no words."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text <> ''")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


class Acceptor:
    """The minimal deterministic automaton of sorted distinct words. State 0 is the initial one; arcs[s] maps a character to a state, final[s] says whether s accepts."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        spare: list[int] = []
        path = [0]  # states of the last word, not yet minimised
        last = ""

        def settle(depth: int) -> None:
            """Replaces the last word's states below depth by equal ones that are known."""
            while len(path) > depth + 1:
                s = path.pop()
                own = (self.final[s], tuple(self.arcs[s].items()))
                same = known.get(own)
                if same is None:
                    known[own] = s
                else:
                    self.arcs[path[-1]][last[len(path) - 1]] = same
                    spare.append(s)

        for w in words:
            shared = 0
            while shared < len(last) and shared < len(w) and w[shared] == last[shared]:
                shared += 1
            settle(shared)
            for c in w[shared:]:
                if spare:
                    s = spare.pop()
                    self.arcs[s], self.final[s] = {}, False
                else:
                    s = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                self.arcs[path[-1]][c] = s
                path.append(s)
            self.final[path[-1]] = True
            last = w
        settle(0)


def _meeting(a: Acceptor, b: Acceptor):
    """(p, q) -> the strings accepted both from p in a and from q in b; each pair of states is worked out once."""
    known: dict[tuple[int, int], list[str]] = {}

    def meet(p: int, q: int) -> list[str]:
        todo = [(p, q)]
        while todo:
            at = todo[-1]
            if at in known:
                todo.pop()
                continue
            here, there = a.arcs[at[0]], b.arcs[at[1]]
            nexts = [(c, (s, there[c])) for c, s in here.items() if c in there]
            open_ = [n for _, n in nexts if n not in known]
            if open_:
                todo += open_
                continue
            known[at] = ([""] if a.final[at[0]] and b.final[at[1]] else []) + [c + rest for c, n in nexts for rest in known[n]]
            todo.pop()
        return known[p, q]

    return meet


def replaced(a: Acceptor) -> Iterator[tuple[str, str]]:
    """The pairs that a, the transducer replacing one character, and a again accept; each once."""
    meet = _meeting(a, a)
    todo = [(0, "")]  # before the edit both sides are in one state
    while todo:
        p, head = todo.pop()
        arcs = list(a.arcs[p].items())
        for i, (c, s) in enumerate(arcs):
            todo.append((s, head + c))
            for d, t in arcs[:i]:
                for rest in meet(s, t):
                    yield f"{head}{c}{rest}", f"{head}{d}{rest}"


def deleted(a: Acceptor, b: Acceptor, at_end: bool) -> Iterator[tuple[str, str]]:
    """The pairs (longer, shorter) that a, the transducer deleting one character, and b accept; of several places the last counts, and the end only at_end."""
    meet = _meeting(a, b)
    todo = [(0, 0, "")]
    while todo:
        p, q, head = todo.pop()
        for c, s in a.arcs[p].items():
            if c in b.arcs[q]:
                todo.append((s, b.arcs[q][c], head + c))
            for rest in meet(s, q):
                if rest[:1] != c and (rest or at_end):
                    yield f"{head}{c}{rest}", f"{head}{rest}"


KEY = ["len", "low", "high", "shared"]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (len, low, high, shared, word, n) in groups -> per word of a near pair: n_near and the best near word (by n, then by order) of what this task saw."""
    near: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        cols = list(zip(*near.values(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(near.keys(), pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["word", "n_near", "form_n", "form"])

    def link(word: str, other: str, n: int) -> None:
        had = near.get(word)
        if had is None:
            near[word] = [1, n, other]
        else:
            had[0] += 1
            if n > had[1] or (n == had[1] and other < had[2]):
                had[1], had[2] = n, other

    def compose(key: tuple, words: list[tuple[str, int]]) -> None:
        size, low, high, _ = key
        tail = size - high
        sides: tuple[dict, dict] = ({}, {})  # free part -> (word, n) of the shorter words and of the longer ones
        for w, n in words:
            sides[len(w) - size][w[low : len(w) - tail]] = (w, n)
        short, long = sides
        if not short or len(words) < 2:
            return
        a = Acceptor(sorted(short))
        found = [(short[x], short[y]) for x, y in replaced(a)] if len(short) > 1 else []
        if long:
            found += [(long[x], short[y]) for x, y in deleted(Acceptor(sorted(long)), a, not tail)]
        for (x, nx), (y, ny) in found:
            link(x, y, ny)
            link(y, x, nx)

    key, words = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
        for k, w, n in zip(keys, batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if k != key:
                if len(words) > 1:
                    compose(key, words)
                key, words = k, []
            words.append((w, n))
        if len(near) > OWN_WORDS:
            yield out()
            near.clear()
    if len(words) > 1:
        compose(key, words)
    if near:
        yield out()


def _keyed(rows: DataFrame, low, high) -> DataFrame:
    """rows (len, word, n) by the part that stays when the places from low to high (of the shorter word) are free."""
    long = F.length("word")
    shared = F.concat(F.substring("word", F.lit(1), low), F.lit("\x00"), F.substring("word", long - (F.col("len") - high) + 1, F.col("len") - high))
    return rows.select("len", low.alias("low"), high.alias("high"), shared.alias("shared"), "word", "n")


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """words (word, n; distinct) -> word, n_near, form_n, form: of every word with near words their number and the best of them. Words of under 2 code points take no part."""
    size = F.length("word")
    rows = words.filter(size >= 2).select("word", "n", F.explode(F.array(size, size - 1)).alias("len")).filter("len >= 2")
    half = F.floor(F.col("len") / 2).cast("int")
    rows = written(_keyed(rows, F.lit(0), half).unionByName(_keyed(rows, half, F.col("len"))), "halves")
    small = []
    while True:
        group = rows.withColumn("group", F.xxhash64(*KEY))
        # at most one such group for as many rows; two groups under one number are split needlessly, no harm
        large = written(group.groupBy("group").count().filter(F.col("count") > most).select("group"), "large")
        if large.isEmpty():
            small.append(rows)
            break
        wide = F.col("high") - F.col("low") > 1
        parts = group.join(F.broadcast(large.withColumn("is_large", F.lit(True))) if large.count() < 500_000 else large.withColumn("is_large", F.lit(True)), "group", "left")
        split = F.coalesce(F.col("is_large"), F.lit(False)) & wide
        small.append(parts.filter(~split).select(*KEY, "word", "n"))
        own, middle = parts.filter(split), F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        rows = written(_keyed(own, F.col("low"), middle).unionByName(_keyed(own, middle, F.col("high"))), "split")
        if rows.isEmpty():
            break
    dealt = small[0]
    for more in small[1:]:
        dealt = dealt.unionByName(more)
    found = dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_composed, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """links (word, form; a word's form never leads back to it) -> word, root. Every round doubles how far a word has come; words that are there leave."""
    ends = links.join(links.select(F.col("word").alias("form"), F.lit(False).alias("there")), "form", "left")
    rows = written(ends.select("word", F.col("form").alias("root"), F.coalesce("there", F.lit(True)).alias("there")), "forms")
    done = [rows.filter("there")]
    while not (going := rows.filter("NOT there")).isEmpty():
        every = going.unionByName(done[0])
        for more in done[1:]:
            every = every.unionByName(more)
        further = every.select(F.col("word").alias("at"), F.col("root").alias("next"), F.col("there").alias("then"))
        rows = written(going.join(further, going["root"] == further["at"]).select("word", F.col("next").alias("root"), F.col("then").alias("there")), "forms")
        done.append(rows.filter("there"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, most: int = MOST_WORDS) -> DataFrame:
    """words (word, n; distinct) -> word, form, root, n, n_near, form_n.

    form is the near word of largest n (of equal ones the first by code points) if it has at least `times` the word's n, else
    null; root is where the forms lead, the word itself if it has none. No words give no rows; times is at least 2.
    """
    if times < 2:
        raise ValueError("forms could lead in a circle: times must be 2 at least")
    words = words.select("word", "n")
    joined = words.join(near_words(words, most), "word", "left")
    fits = F.col("form_n") >= times * F.col("n")
    known = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "variants")
    return known.join(roots(known.filter("form IS NOT NULL").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents and their commonest forms: word, form, root, n, n_near, form_n."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(written(vocabulary(docs), "vocabulary"))
