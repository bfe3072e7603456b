"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from causeway.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(words, times=2):
    pairs = defaultdict(list)
    for a in words:
        for b in words:
            if near(a, b):
                pairs[a].append((-words[b], b))
    form = {w: (min(v)[1] if -min(v)[0] >= times * words[w] else None) for w, v in pairs.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(pairs[w]), words[f] if f else None))
    return out


def some_words(n, letters, shortest, longest):
    return {"".join(random.choice(letters) for _ in range(random.randint(shortest, longest))): random.randint(1, 40) for _ in range(n)}


@pytest.mark.parametrize(("most", "letters", "longest"), [(8_192, "abc", 8), (40, "ab", 9), (3, "ab", 7), (20, "aé𝄞", 6)])
def test_all_pairs(spark, most, letters, longest):
    """Dense vocabularies, so that groups are split down to one free place."""
    random.seed(most)
    words = some_words(500, letters, 2, longest) | {"x" * 400: 5, "x" * 401: 20, "x" * 200 + "y" + "x" * 199: 2}
    df = spark.createDataFrame([*words.items()], "word string, n long").withColumns({c: F.lit(0) for c in ("len", "low", "high", "shared", "group", "form", "root", "at")}).repartition(5)
    got = [tuple(r) for r in spelling.variants(df, most=most).collect()]
    assert len(got) == len(words) and set(got) == plain(words)


def test_acceptor_is_minimal_and_accepts_just_the_words():
    random.seed(5)
    words = sorted(some_words(300, "abc", 1, 6))
    a = spelling.Acceptor(words)
    seen, todo = [], [(0, "")]
    while todo:
        s, w = todo.pop()
        if a.final[s]:
            seen.append(w)
        todo += [(t, w + c) for c, t in a.arcs[s].items()]
    assert sorted(seen) == words
    reached, todo = {0}, [0]
    while todo:
        for t in a.arcs[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    right = {s: frozenset(_language(a, s)) for s in reached}
    assert len(set(right.values())) == len(reached)  # no two states accept the same


def _language(a, s, head=""):
    if a.final[s]:
        yield head
    for c, t in a.arcs[s].items():
        yield from _language(a, t, head + c)


def test_vocabulary(spark):
    """Case, letters beyond ASCII, misread runs, nulls, and two runs that are misread alike."""
    texts = [(i, f"Grüße Straße ÉTÉXYZ naïve×word don't {'abcdefg ' * 3} x{i}y") for i in range(300)] + [(None, "abcdefg nullid"), (5, None), (6, ""), (None, "nullid nullid"), (7, "longer " * 3000)]
    want = Counter()
    for d, t in texts:
        for run in spelling._RUN.findall(t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("x"))).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} and got["nullid"] == 3 and "étéxyz" not in got and "Étéxyz" not in got


def test_long_chains_of_forms(spark):
    """Every word's form has twice its occurrences, twenty times over."""
    words = {"a" * 10 + "b" * i: 2**i for i in range(20)} | {"zzzzz": 1}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([*words.items()], "word string, n long")).collect()}
    assert all(got[w]["root"] == "a" * 10 + "b" * 19 for w in words if w != "zzzzz") and got["zzzzz"]["root"] == "zzzzz" and got["zzzzz"]["n_near"] == 0
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), times=1)
