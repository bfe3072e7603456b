"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a word list and of words learned from labels, how near hits are to the second person, capitals,
punctuation, and obfuscation. Words are learned by their log odds, with their beginnings, so that rare inflections count
too; a training row is shown the odds of the other parts of the sample only (cross-fitting), as a new text would be. Trees
are fitted on one part of a bounded sample of labelled rows and calibrated on the other; every text is scored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, written

#: Labelled rows that are learned from: about so many, by a hash of the id.
SAMPLE_ROWS = 20_000
#: A learned term is a word or a beginning of one; it stands in so many toxic training texts, and so far above one (natural log) lies its odds ratio less ERRORS standard errors; the strongest are kept.
LEAST_TOXIC, ERRORS, LEAST_ODDS, LEARNED_TERMS = 3, 1.0, 1.0, 20_000
#: Lengths of beginnings, and the longest word that is learned or looked up.
BEGINNINGS, LONGEST_WORD = (3, 4, 5, 6, 7, 8), 32
#: Odds from which on a word counts as a hit.
HIT_ODDS = 2.0
#: Terms that a task counts before it passes the counts on.
COUNTED = 200_000
#: Masked words whose answer is kept.
KNOWN_MASKS = 100_000
#: Parts of the training rows; the terms that a row is shown are learned from the other parts.
PARTS = 4
#: A hit and a second-person word so many words apart are near.
NEAR_WORDS = 6
TREES, DEPTH = 20, 3
THRESHOLD = 0.7
#: Share of the score that is the trees' own probability.
TRACE = 0.001

# Insults, and words of the second person, in four languages.
INSULTS = frozenset("""
    asshole bastard bitch clown coward creep cretin crap cunt damn degenerate dickhead disgusting dumb dumbass filth filthy
    fool freak fuck fucking garbage hate idiot idiotic imbecile jerk liar loser lunatic maggot moron moronic nasty parasite
    pathetic pig prick psycho rat repulsive retard scum shit shut slut stupid sucker thug trash ugly vermin whore
    worthless wretch
    abschaum arschloch blödmann depp dreckig dumm dummkopf hurensohn idiotin mistkerl schwein trottel versager wertlos
    abruti bouffon connard connasse crétin débile dégueulasse imbécile minable ordure pourriture salaud salope stupide
    asqueroso basura cabrón escoria estúpido gilipollas idiota imbécil inútil mierda patético payaso puta
    """.split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton tes vous votre vos tú tus ti usted ustedes vosotros".split())
LEET = bytes.maketrans(b"@$!|013457", b"asiioieast")

FEATURES = (
    "list_density", "list_count", "list_distinct", "learned_max", "learned_second", "learned_sum", "learned_density", "learned_count", "near_second_person", "second_person",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_hits", "long_text",
)

_PUNCTUATION = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f]")
_NO_LETTER = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_CAPITALS, _SHOUT = re.compile(rb"[A-Z]{3,}"), re.compile(rb"\b[A-Z]{3,}\b")
#: What every masked word holds; it turns most texts and tokens away.
_HINT = re.compile(rb"[@$!|*0-9][a-z]")
_MASKED = re.compile(rb"[a-z]+[@$!|*0-9]+[a-z]+|[@$!|0-9][a-z]+[@$!|*0-9]*[a-z]+")
_SPACED = re.compile(rb"\b(?:[a-z][ .\-_*]){3,}[a-z]\b")
_UPPER, _LETTERS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!?.,;:#$%&*@"


class Odds:
    """The odds of words: the largest of the learned terms that they are or begin with, 0 without any."""

    def __init__(self, terms: Mapping[str, float]):
        self.terms = terms
        self.starts = frozenset(t[: BEGINNINGS[0]] for t in terms)
        #: Words that count as hits, by length, first and last letter, which a mask leaves.
        self.masks: dict[tuple[int, str, str], list[str]] = defaultdict(list)
        for w in INSULTS | {t[:-1] for t, x in terms.items() if x >= HIT_ODDS and t[-1] == "$"}:
            self.masks[len(w), w[0], w[-1]].append(w)
        self.hidden: dict[str, bool] = {}

    def hides(self, masked: str) -> bool:
        """Whether a word with stars inside is a hit with letters for the stars; looked up once per distinct word."""
        found = self.hidden.get(masked)
        if found is None:
            if len(self.hidden) > KNOWN_MASKS:
                self.hidden.clear()
            found = self.hidden[masked] = any(all(a in ("*", b) for a, b in zip(masked, w, strict=True)) for w in self.masks.get((len(masked), masked[0], masked[-1]), ()))
        return found

    def __getitem__(self, word: str) -> float:
        return max([self.terms.get(t, 0.0) for t in terms_of(word)], default=0.0) if word[: BEGINNINGS[0]] in self.starts else 0.0


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; characters beyond ASCII count as such but for general punctuation."""
    low = text.lower()
    low = low if low.isascii() else _PUNCTUATION.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_NO_LETTER).decode("utf-8", "surrogatepass").split()


def terms_of(word: str) -> list[str]:
    """The word (ended by a mark) and its beginnings; none of an over-long word."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if n <= len(word))] if 3 <= len(word) <= LONGEST_WORD else []


def _unmasked(token: bytes, odds: Odds) -> bool:
    plain = token.translate(LEET).decode()
    if "*" not in plain:
        return plain in INSULTS or odds[plain] >= HIT_ODDS
    return odds.hides(plain)


def features(text: str, odds: Odds) -> list[float]:
    """FEATURES of a whole text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    words = words_of(text)
    n = max(len(words), 1)
    count = Counter(words)
    listed = [w for w in count if w in INSULTS]
    starts = odds.starts
    told = sorted(((x, w) for w in count if w[: BEGINNINGS[0]] in starts and (x := odds[w]) > 0.0), reverse=True)
    own = [w for x, w in told if x >= HIT_ODDS]
    hits, learned = sum(count[w] for w in listed), sum(count[w] for w in own)
    near, marked = 0, {*listed, *own}
    if marked:
        before = list(accumulate((w in SECOND_PERSON for w in words), initial=0))
        near = sum(before[min(i + NEAR_WORDS + 1, len(words))] > before[max(i - NEAR_WORDS, 0)] for i, w in enumerate(words) if w in marked)
    masked = [m for t in (low.split() if _HINT.search(low) else ()) if _HINT.search(t) for m in _MASKED.findall(t) if len(m) <= 24]
    single = sum(k for w, k in count.items() if len(w) == 1)
    spaced = [re.sub(rb"[ .\-_*]", b"", m).decode() for m in _SPACED.findall(low)] if single >= 4 else []
    unmasked = sum(_unmasked(m, odds) for m in masked) + sum(m in INSULTS or odds[m] >= HIT_ODDS for m in spaced)
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    strongest = [x for x, _ in told[:2]] + [0.0, 0.0]
    return [
        hits / n, float(hits), float(len(listed)), strongest[0], strongest[1], sum(x for x, _ in told), learned / n, float(learned), near / max(sum(count[w] for w in marked), 1), sum(count[w] for w in SECOND_PERSON if w in count) / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / max(letters, 1), (len(_SHOUT.findall(raw)) if _CAPITALS.search(raw) else 0) / n, raw.count(b"!") / n, raw.count(b"?") / n, (len(raw) - len(raw.translate(None, _MARKS))) / n,
        (len(masked) + len(spaced)) / n, float(unmasked), float(np.log1p(len(words))),
    ]


def _featured(docs: DataFrame, learned: list[dict[str, float]], text: str = "text", part: str | None = None, with_text: bool = False) -> DataFrame:
    """Columns row (a struct of all of docs' columns, without its text unless with_text) and a double per feature. learned: terms with their odds; with a column part, those of row's part."""
    names = [f"f_{f}" for f in FEATURES]
    keep = [c for c in docs.columns if c != text or with_text]
    which = F.lit(0) if part is None else F.col(f"`{part}`").cast("int")
    # the text travels once, and no column of docs can meet one of ours
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias(text))
    rows = docs.select(row.alias("row"), which.alias("part"), *([] if with_text else [F.col(f"`{text}`").alias("text")]))
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = [Odds(x) for x in shared.value]
        told = (b.append_column("text", b.column("row").field(keep.index(text))) for b in batches) if with_text else batches
        for batch in slices(told, "text"):
            x = np.array([features(t or "", odds[k]) for t, k in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist(), strict=True)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c) for c in x.T)], ["row", *names])

    schema = rows.select("row").schema
    for n in names:
        schema = schema.add(n, "double")
    return rows.mapInArrow(run, schema)


def add_features(docs: DataFrame, learned: list[dict[str, float]], text: str = "text", part: str | None = None, with_text: bool = False) -> DataFrame:
    """docs with a double column per feature (prefixed f_; columns of those names are replaced), without its text unless with_text."""
    names = [f"f_{f}" for f in FEATURES]
    return _featured(docs.drop(*names), learned, text, part, with_text).select("row.*", *names)


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="_x").transform(df).drop(*[f"f_{f}" for f in FEATURES])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of about `most` labelled rows at most that aren't held out, one per text.

    The ids of the sample are broadcast (bounded by `most`); documents aren't shuffled. Rows with a null label or id
    take no part; an id with several labels takes the commoner one, 1 in a tie.
    """
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out("doc_id")).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("label"))
    own = written(own, "labels")
    share = min(1.0, most / max(own.count(), 1))
    picked = own.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy(F.xxhash64("text")).agg(F.min_by(F.struct("doc_id", "text", "label"), "doc_id").alias("r")).select("r.*")


def learned_terms(rows: DataFrame) -> list[dict[str, float]]:
    """rows (text, label, part) -> for each part the terms with their odds in the other parts' texts, and last those of all.

    Odds are the logarithm of a term's odds ratio less ERRORS standard errors. A term counts once in a text, in whatever task
    that lies; LEARNED_TERMS are kept at most, the strongest ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, float], Counter] = defaultdict(Counter)
        for batch in slices(batches, "text"):
            for t, y, k in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "part")), strict=True):
                counts[k, y].update({x for w in set(words_of(t)) for x in terms_of(w)})
                if sum(map(len, counts.values())) > COUNTED:
                    yield from told(counts)
                    counts.clear()
        yield from told(counts)

    def told(counts: dict[tuple[int, float], Counter]) -> Iterator[pa.RecordBatch]:
        for (part, label), count in counts.items():
            m = len(count)
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array([part] * m, pa.int32()), pa.array([label] * m, pa.float64()), pa.array(count.values(), pa.int64())], ["term", "part", "label", "n"])

    n = {(r["label"], r["part"]): r["n"] for r in rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = {y: [n.get((y, k), 0) for k in range(PARTS)] for y in (0.0, 1.0)}
    if not sum(of[0.0]) or not sum(of[1.0]):
        return [{} for _ in range(PARTS + 1)]
    each = rows.select("text", "label", F.col("part").cast("int")).mapInArrow(run, "term string, part int, label double, n long")
    cells = {f"{'cb'[int(y)]}{k}": F.sum(F.when((F.col("label") == y) & (F.col("part") == k), F.col("n")).otherwise(0)) for y in (0.0, 1.0) for k in range(PARTS)}
    bad, good = sum(F.col(f"b{k}") for k in range(PARTS)), sum(F.col(f"c{k}") for k in range(PARTS))
    lower = F.log((bad + 0.5) / (sum(of[1.0]) + 1)) - F.log((good + 0.5) / (sum(of[0.0]) + 1)) - ERRORS * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    found = each.groupBy("term").agg(*[c.alias(k) for k, c in cells.items()]).filter(bad >= LEAST_TOXIC).withColumn("lower", lower).filter(F.col("lower") >= LEAST_ODDS)
    top = found.orderBy(F.desc("lower"), "term").limit(LEARNED_TERMS).collect()
    out = []
    for left_out in [*range(PARTS), None]:
        parts = [k for k in range(PARTS) if k != left_out]
        b, g = (np.array([sum(r[f"{c}{k}"] for k in parts) for r in top], dtype=np.float64) for c in "bc")
        odds = np.log((b + 0.5) / (sum(of[1.0][k] for k in parts) + 1)) - np.log((g + 0.5) / (sum(of[0.0][k] for k in parts) + 1)) - ERRORS * np.sqrt(1 / (b + 0.5) + 1 / (g + 0.5))
        out.append({r["term"]: float(x) for r, x, m in zip(top, odds, b, strict=True) if m >= LEAST_TOXIC and x >= LEAST_ODDS})
    return out


class Toxicity:
    """A fitted model. Without rows of both classes every score is the share of toxic rows (0 without any)."""

    def __init__(self, learned: dict[str, float], trees: Model | None, calibrated: Model | None, prior: float):
        self.learned, self.trees, self.calibrated, self.prior = learned, trees, calibrated, prior

    def _scored(self, docs: DataFrame, text: str, with_text: bool) -> DataFrame:
        """row, score, predicted."""
        if self.trees is None or self.calibrated is None:
            keep = [c for c in docs.columns if c != text or with_text]
            out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.lit(float(self.prior)).alias("score"))
        else:
            raw = self.trees.transform(_assembled(_featured(docs, [self.learned], text, with_text=with_text))).withColumn("_p", vector_to_array("_probability")[1])
            # calibration makes steps; a trace of the trees' own probability keeps the order within one
            score = (1 - TRACE) * F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)) + TRACE * F.col("_p")
            out = self.calibrated.transform(raw.select("row", "_p")).select("row", score.alias("score"))
        return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    def score(self, docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
        """docs, without its text unless with_text, with score (0 to 1) and predicted; columns of those names are replaced. A null text counts as empty."""
        return self._scored(docs.drop("score", "predicted"), text, with_text).select("row.*", "score", "predicted")

    def passed(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows of docs that aren't predicted toxic, with all their columns."""
        return self._scored(docs, text, True).filter("predicted = 0").select("row.*")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Toxicity:
    """A model of docs (doc_id, text) and labels (doc_id, toxic), by rows that aren't held out.

    Null labels, ids without a text and texts without a label take no part; a null text counts as empty, repeated texts once.
    Without labelled rows of both classes, as with empty tables, the model gives every row the share of toxic ones.
    """
    rows = written(training_rows(docs, labels, most).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("terms")), F.lit(PARTS))), "training")
    terms = learned_terms(rows)
    own = written(_assembled(_featured(rows, terms, part="part")).select("_x", "row.label", (F.pmod(F.xxhash64("row.doc_id", F.lit("part")), F.lit(10)) < 3).alias("calibrate")), "features")
    part = {(r["calibrate"], r["label"]): r["n"] for r in own.groupBy("calibrate", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(part.values())
    if min(part.get((False, y), 0) for y in (0.0, 1.0)) < 2 or not total:
        return Toxicity({}, None, None, sum(n for (_, y), n in part.items() if y == 1.0) / max(total, 1))
    trees = GBTClassifier(featuresCol="_x", labelCol="label", predictionCol="_tree", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=10 if total >= 500 else 2, seed=7).setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(own.filter("NOT calibrate"))
    base = own.filter("calibrate") if sum(n for (c, _), n in part.items() if c) >= 100 else own
    p = trees.transform(base).select("label", vector_to_array("_probability")[1].alias("_p"))
    calibrated = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_score").fit(p)
    return Toxicity(terms[-1], trees, calibrated, 0.0)


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that a model fitted on them and labels predicts toxic; all columns stay, whatever their names."""
    return fit(docs, labels, most).passed(docs)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: doc_id, held_out, score, predicted."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return fit(docs, labels).score(docs).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
