"""The queries without SQL, and the stages of the pipeline, over all of the smallest tables against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import bpe, decontam, langid, sharding, simhash, toxicity
from causeway.llm.common import held_out
from causeway.llm.common import table as read
from causeway.llm.queries import QUERIES

SECRET = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [r.asDict() for r in read(spark, sf, "documents").collect()]


def groups_of(items, near):
    """Position -> the smallest position of its group, by comparing all pairs."""
    group = list(range(len(items)))
    for i, x in enumerate(items):
        for j in range(i):
            if group[i] != group[j] and near(x, items[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def leaks_of(docs, items):
    """(doc_id, item_id) -> (passage, score): every passage of every text against every item, no index."""
    entries = [(i["item_id"], *decontam.question_and_answer(i["text"])) for i in items if i["text"]]
    entries = [e for e in entries if e[1]]
    assert all(len(q) + len(a) <= decontam.ENTRY_WORDS for _, q, a in entries)
    mean = sum(len(q) + len(a) for _, q, a in entries) / len(entries)
    df = Counter(w for _, q, a in entries for w in {*q, *a})
    weights = []
    for _, q, a in entries:
        norm = decontam.K1 * (1 - decontam.B + decontam.B * (len(q) + len(a)) / mean)
        w = {t: math.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * f * (decontam.K1 + 1) / (f + norm) for t, f in Counter(q + a).items()}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    stride = max(decontam.PASSAGE_WORDS // 2, max(len(q) + len(a) for _, q, a in entries))
    out = {}
    for d in docs:
        words = decontam.words_of(d["text"] or "")
        for p in range(0, len(words), stride):
            own = words[p : p + 2 * stride]
            grams = {tuple(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}
            here = set(own)
            for (item, q, a), w in zip(entries, weights, strict=True):
                score = sum(x for t, x in w.items() if t in here)
                if score >= decontam.THRESHOLD - 1e-9:
                    share = lambda x: sum(g in grams for g in decontam.trigrams(x)) / len(decontam.trigrams(x)) if x else 1.0  # noqa: B023, E731
                    if share(q) >= decontam.OVERLAP and share(a) >= decontam.OVERLAP:
                        key = (d["doc_id"], item)
                        if key not in out or (score, -p) > (out[key][1], -out[key][0]):
                            out[key] = (p, score)
    return out


def test_op2(spark, sf, documents):
    want = leaks_of(documents, [r.asDict() for r in read(spark, sf, "benchmark").collect()])
    got = {(r["doc_id"], r["item_id"]): (r["passage"], r["score"]) for r in QUERIES["op2_decontam"](spark, sf).collect()}
    assert len(want) >= 3 and got.keys() == want.keys()
    for k, (passage, score) in want.items():
        assert got[k][0] == passage and got[k][1] == pytest.approx(score)


def test_op5(spark, sf, documents):
    held = {r["doc_id"]: r["h"] for r in read(spark, sf, "documents").select("doc_id", held_out("doc_id").alias("h")).collect()}

    def counted(text):
        out = Counter()
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            out.update(f" {w} "[i : i + n] for n in (1, 2, 3) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " ")
        return out

    def top(count):
        return sorted(count, key=lambda g: (-count[g], sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))))[: langid.PROFILE]

    by_lang = defaultdict(Counter)
    for d in documents:
        if not held[d["doc_id"]] and d["lang"] and d["text"]:
            by_lang[d["lang"]].update(counted(d["text"]))
    profile = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in by_lang.items()}
    got = {r["doc_id"]: r for r in QUERIES["op5_langid"](spark, sf).collect()}
    assert len(got) == len(documents)
    for d in documents:
        own, r = top(counted(d["text"] or "")), got[d["doc_id"]]
        assert r["held_out"] == held[d["doc_id"]]
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        distance = sorted((sum(abs(i - p[g]) if g in p else langid.PROFILE for i, g in enumerate(own)), lang) for lang, p in profile.items())
        assert r["lang_pred"] == distance[0][1] and r["score"] == pytest.approx(0.5 + 0.5 * (distance[1][0] - distance[0][0]) / distance[1][0])


def test_op6(spark, sf, documents):
    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d["doc_id"]: fingerprint(d["text"] or "") for d in documents}
    ids = sorted(prints)
    group = groups_of([prints[i] for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", ids[g]) for i, g in zip(ids, group, strict=True)}


def test_op7(spark, sf, documents):
    """Terms by plain counting, and scores that follow the trees' probability over all rows."""
    docs, labels = read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "labels").select("doc_id", "toxic")
    rows = toxicity.training_rows(docs, labels).withColumn("part", F.pmod("doc_id", F.lit(toxicity.PARTS)))
    terms, data = toxicity.learned_terms(rows), rows.collect()
    assert not rows.filter(held_out("doc_id")).count()
    for left_out in (0, None):
        own = [r for r in data if r["part"] != left_out]
        n = Counter(r["label"] for r in own)
        count = {y: Counter(x for r in own if r["label"] == y for x in {x for w in toxicity.words_of(r["text"]) for x in toxicity.terms_of(w)}) for y in (0.0, 1.0)}
        got = terms[-1 if left_out is None else left_out]
        odds = lambda t: math.log((count[1.0][t] + 0.5) / (n[1.0] + 1)) - math.log((count[0.0][t] + 0.5) / (n[0.0] + 1)) - toxicity.ERRORS * math.sqrt(1 / (count[1.0][t] + 0.5) + 1 / (count[0.0][t] + 0.5))  # noqa: B023, E731
        assert all(x == pytest.approx(odds(t)) for t, x in got.items())
        if left_out is None:
            assert {t for t, k in count[1.0].items() if k >= toxicity.LEAST_TOXIC and odds(t) >= toxicity.LEAST_ODDS} == set(got)
    model = toxicity.fit(docs, labels)
    from pyspark.ml.functions import vector_to_array

    p = model.trees.transform(toxicity._assembled(toxicity.add_features(docs, [model.learned]))).select("doc_id", vector_to_array("_probability")[1].alias("p"))
    both = sorted((r["p"], r["score"], r["predicted"]) for r in model.score(docs).join(p, "doc_id").collect())
    assert len(both) == len(documents) and all(a[1] <= b[1] + 1e-12 for a, b in zip(both, both[1:], strict=False)) and all(x == int(s >= 0.7) and 0 <= s <= 1 for _, s, x in both)


def test_toxic_features_by_plain_counting():
    text = "You are a MORON, a stupid m0ron! Nothing here? YOUR house is on s t u p i d street; 12 fine words follow now."
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Odds({"fin": 3.0, "house$": 1.5})), strict=True))
    words = re.findall("[a-z]+", text.lower())
    near = [any(w in toxicity.SECOND_PERSON for w in words[max(i - 6, 0) : i + 7]) for i, x in enumerate(words) if x in ("moron", "stupid", "fine")]
    want = {
        "list_count": 2, "list_distinct": 2, "list_density": 2 / len(words), "learned_max": 3.0, "learned_second": 1.5, "learned_sum": 4.5, "learned_count": 1, "learned_density": 1 / len(words), "near_second_person": sum(near) / len(near),
        "second_person": 3 / len(words), "capitals": sum(c.isupper() for c in text) / sum(c.isalpha() for c in text), "capital_words": 2 / len(words), "exclamations": 1 / len(words), "questions": 1 / len(words),
        "punctuation": sum(c in "!?.,;:#$%&*@" for c in text) / len(words), "obfuscated": 2 / len(words), "obfuscated_hits": 2, "long_text": math.log1p(len(words)),
    }
    assert f == pytest.approx(want)


def test_op8(spark, sf, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    got = {r["doc_id"]: r for r in QUERIES["op8_bpe"](spark, sf).collect()}
    for d in documents:
        ids, r = t.encode(d["text"] or "", add_special_tokens=False).ids, got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10(spark, sf):
    shards = [f"shard-{i:05d}" for i in range(64)]
    own = sharding.lookup_table(shards)
    hashed = {r["doc_id"]: r["h"] for r in read(spark, sf, "documents").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    got = QUERIES["op10_sharding"](spark, sf).collect()
    assert len(got) == len(hashed) and all((r["slot"], r["shard"]) == (hashed[r["doc_id"]] % sharding.SLOTS, shards[own[hashed[r["doc_id"]] % sharding.SLOTS]]) for r in got)


def test_write_shards(spark, sf, tmp_path):
    placed = QUERIES["op10_sharding"](spark, sf)
    sharding.write_shards(placed, f"{tmp_path}/shards", rows_a_file=3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select("doc_id", "slot", "shard").exceptAll(placed).count() == 0 and back.count() == placed.count()


def test_every_stage_of_the_pipeline(spark, sf, documents):
    import corpus_pipeline

    docs, stages = read(spark, sf, "documents"), dict(corpus_pipeline.STAGES)
    of = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    given = {d["doc_id"]: d for d in documents}
    # toxicity: what the model of these rows and labels predicts goes, and nothing else
    clean = stages["toxicity"](spark, docs, sf)
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    kept = of(clean)
    assert clean.columns == docs.columns and kept == {i: d for i, d in given.items() if not scored[i]}
    # near-duplicates: Jaccard of all pairs
    docs = spark.createDataFrame(list(kept.values()), docs.schema)
    single = of(stages["simhash_dedup"](spark, docs, sf))
    ids = sorted(kept)
    sets = [set(simhash.shingle_hashes((kept[i]["text"] or "").encode(), 5).tolist()) for i in ids]
    group = groups_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert single == {i: kept[i] for i, g in zip(ids, group, strict=True) if ids[g] == i} and len(single) < len(kept)
    # benchmark leaks
    docs = spark.createDataFrame(list(single.values()), docs.schema)
    found = {d for d, _ in leaks_of(list(single.values()), [r.asDict() for r in read(spark, sf, "benchmark").collect()])}
    rest = of(stages["decontamination"](spark, docs, sf))
    assert rest == {i: d for i, d in single.items() if i not in found} and found
    # secrets
    docs = spark.createDataFrame(list(rest.values()), docs.schema)
    free = of(stages["secret_scan"](spark, docs, sf))
    for i, d in rest.items():
        text, at, out = d["text"], 0, ""
        spans = [(m.start(), m.end()) for m in SECRET.finditer(text or "") if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        for a, b in sorted(spans):
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        want = out + text[at:] if spans else text
        assert free[i] == d | {"text": want, "n_chars": len(want) if spans else d["n_chars"]}
    assert free.keys() == rest.keys()
    # tokens
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    docs = spark.createDataFrame(list(free.values()), docs.schema)
    last = {r["doc_id"]: r for r in stages["bpe"](spark, docs, sf).collect()}
    assert last.keys() == free.keys()
    for i, d in free.items():
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        assert last[i]["ids"] == ids and last[i]["n_tokens"] == len(ids) and last[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
