"""Operator 11: toxicity by a counterfactual-regularised classifier.

A text's features are the words it holds and what these words begin with. Which features count is
decided on labelled texts: those whose texts are toxic more often, or less, than chance allows (a
G-test). A logistic regression over them is fitted with a penalty on counterfactuals: in sentences of the labelled texts
every identity term is swapped, one at a time, for each other term of its group and for a neutral
one, and the squared change of the sentence's score is penalised. So a term on its own does not move
a score, however often toxic texts mention its group, while what is said about the group does.

Fitting looks at the LABELLED texts of smallest hash; their features are counted in Spark, and the
driver gets the few that pass the test, by text. All texts are scored whole.

Defined cases: null and empty texts have no features and get the score of that; labels that are null
or of unlabelled documents are not used; of several labels of one document the highest counts;
repeated documents are scored each; a null id is never held out and never labelled; without labels
all scores are the prior; an empty table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import Memo, arrow_schema, as_batch, map_batches, staged

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Labelled texts that a classifier is fitted on at most.
LABELLED = 20_000
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: Features of a classifier at most: those that tell most.
FEATURES = 20_000
#: The least G value of a feature: 24 is passed by chance once in a million.
CHANCE = 24.0
#: Weights of the two penalties, and steps of the fit at most.
RIDGE, COUNTERFACTUAL, STEPS = 0.05, 1.0, 50

#: Identity terms by group, as they are written in English, German, French and
#: Spanish; the first of a group is its neutral term.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "mothers", "fathers"),
    ("person", "woman", "man", "girl", "boy", "mother", "father"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("human", "black", "white", "asian", "african", "latino", "arab", "european", "indigenous", "mexican", "chinese"),
    ("citizens", "immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("single", "gay", "lesbian", "straight", "bisexual", "transgender", "queer", "homosexual", "heterosexual"),
    ("healthy", "disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "behinderte"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "noirs", "arabes"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "negros"),
)


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def swaps(terms) -> dict[str, tuple[str, ...]]:
    """What each identity term is swapped for: all others of its group. The neutral one is not swapped."""
    return {term: tuple(t for t in group if t != term) for group in terms for term in group[1:]}


@dataclass
class Classifier:
    """Weights of features. A score is the logistic function of the bias and the weights held."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self):
        """A function of one text. Words are looked up once each."""
        weights = self.weights
        of_word = Memo(lambda w: tuple(f for f in features_of(w) if f in weights))

        def score(text: str | None) -> float:
            held = set()
            for word in set(WORD.findall((text or "").lower())):
                held.update(of_word[word])
            z = self.bias + sum(weights[f] for f in sorted(held))
            return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))

        return score


def _counted(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, other): in how many labelled texts of each kind a feature occurs."""
    ddl = "feature string, toxic bigint, other bigint"
    schema = arrow_schema(ddl)

    def task(batches):
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def emit():
            every = list(held[0].keys() | held[1].keys())
            out = as_batch({
                "feature": every, "toxic": [held[1][f] for f in every], "other": [held[0][f] for f in every],
            }, schema)
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words = set(WORD.findall((text.as_py() or "").lower()))
                held[toxic].update({f for w in words for f in features_of(w)})
                if len(held[0]) + len(held[1]) > 400_000:
                    yield emit()
        yield emit()

    counted = labelled.select("text", "toxic").mapInArrow(task, ddl)
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _telling(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """The features whose texts are toxic more often, or less, than chance allows, by a G-test."""
    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, share = F.col("toxic") + F.col("other"), toxic / max(toxic + other, 1)
    g = 2 * (part(F.col("toxic"), n * share) + part(F.col("other"), n * (1 - share)))
    return counts.select("feature", g.alias("g")).where(F.col("g") >= CHANCE).orderBy(F.desc("g"), "feature").limit(FEATURES)


def _held(labelled: DataFrame, known: set[str], terms) -> tuple[DataFrame, DataFrame]:
    """Of each labelled text the known features, and of each swap in its sentences those that it
    takes away and adds; alike ones are counted together."""
    other = swaps(terms)
    ddl = "toxic int, held array<string>, minus array<string>, n bigint"
    schema = arrow_schema(ddl)

    def make():
        of_word = Memo(lambda w: tuple(f for f in features_of(w) if f in known))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                text = (text.as_py() or "").lower()
                rows.append((toxic, tuple(sorted({f for w in set(WORD.findall(text)) for f in of_word[w]})), None))
                for sentence in SENTENCE.split(text):
                    words = WORD.findall(sentence)
                    for i, word in enumerate(words):
                        if word in other:
                            rest = {f for w in (*words[:i], *words[i + 1:]) for f in of_word[w]}
                            was = set(of_word[word]) - rest
                            for t in other[word]:
                                now = set(of_word[t]) - rest
                                if now != was:
                                    rows.append((None, tuple(sorted(now - was)), tuple(sorted(was - now))))
            counted = Counter(rows)
            return as_batch({
                "toxic": [r[0] for r in counted], "held": [list(r[1]) for r in counted],
                "minus": [None if r[2] is None else list(r[2]) for r in counted], "n": list(counted.values()),
            }, schema)

        return step

    rows = map_batches(labelled.select("text", "toxic"), make, ddl)
    alike = staged(labelled.sparkSession, rows.groupBy("toxic", "held", "minus").agg(F.sum("n").alias("n")), "toxicity")
    return alike.where("minus is null"), alike.where("minus is not null")


class _Sparse:
    """Rows of few features each, with a weight."""

    def __init__(self, rows: list[tuple[list[tuple[int, float]], float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.array([i for i, (r, _) in enumerate(rows) for _ in r], dtype=np.int64)
        self.column = np.array([j for r, _ in rows for j, _ in r], dtype=np.int64)
        self.value = np.array([v for r, _ in rows for _, v in r], dtype=np.float64)
        self.weight = np.array([w for _, w in rows], dtype=np.float64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.n)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * x[self.row], minlength=self.width)


def fitted(
    texts: list[tuple[list[int], int, float]], counterfactuals: list[tuple[list[int], list[int], float]], width: int,
    counterfactual: float = COUNTERFACTUAL,
) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the mean log loss, RIDGE times the squared weights, and the
    mean squared change of score over counterfactuals. (features, label, n); (added, taken, n).

    By Newton steps, each solved by conjugate gradients and halved until the loss falls.
    """
    x = _Sparse([([(j, 1.0) for j in held] + [(width, 1.0)], n) for held, _, n in texts], width + 1)
    d = _Sparse([([(j, 1.0) for j in a] + [(j, -1.0) for j in b], n) for a, b, n in counterfactuals], width + 1)
    y = np.array([label for _, label, _ in texts], dtype=np.float64)
    total, pairs = max(x.weight.sum(), 1.0), max(d.weight.sum(), 1.0)
    share = float((x.weight * y).sum() + 1) / (total + 2)
    w = np.zeros(width + 1)
    w[width] = np.log(share / (1 - share))
    ridge = np.full(width + 1, 2 * RIDGE / total)
    ridge[width] = 0 if 0 < share < 1 and len(set(y)) > 1 else 1e9  # with one label the bias stays

    def loss(v):
        z = x.times(v)
        fit = (x.weight * (np.logaddexp(0, z) - y * z)).sum() / total + ridge[:width] @ v[:width] ** 2 / 2
        return fit + counterfactual * (d.weight * d.times(v) ** 2).sum() / pairs

    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -500, 500)))
        slope = x.turned(x.weight * (p - y) / total) + 2 * counterfactual * d.turned(d.weight * d.times(w)) / pairs
        slope[:width] += ridge[:width] * w[:width]
        curve = x.weight * p * (1 - p) / total
        step = _solved(
            lambda v: x.turned(curve * x.times(v)) + ridge * v
            + 2 * counterfactual * d.turned(d.weight * d.times(v)) / pairs, -slope,
        )
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max(initial=0) < 1e-6:
            break
    return float(w[width]), w[:width]


def _solved(times, right: np.ndarray) -> np.ndarray:
    """x with times(x) = right, by conjugate gradients."""
    x, rest = np.zeros_like(right), right.copy()
    ahead, size = rest.copy(), float(rest @ rest)
    least = size * 1e-12
    for _ in range(200):
        if size <= least or size == 0:
            break
        turned = times(ahead)
        far = size / max(float(ahead @ turned), 1e-300)
        x, rest = x + far * ahead, rest - far * turned
        size, before = float(rest @ rest), size
        ahead = rest + size / before * ahead
    return x


def fit(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    """A classifier from (id, text) and (id, toxic), by the LABELLED rows of smallest hash that
    have a text. Of texts with one id the smallest counts."""
    spark = docs.sparkSession
    known = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = known.join(docs.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    texts = docs.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = staged(spark, texts.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    telling = _telling(_counted(sample), sizes.get(1, 0), sizes.get(0, 0))
    known = [r["feature"] for r in telling.collect()]
    number = {f: j for j, f in enumerate(known)}
    held, changed = _held(sample, set(known), terms)
    bias, weights = fitted(
        [([number[f] for f in r["held"]], r["toxic"], r["n"]) for r in held.collect()],
        [([number[f] for f in r["held"]], [number[f] for f in r["minus"]], r["n"]) for r in changed.collect()],
        len(known), counterfactual,
    )
    return Classifier(bias, {f: float(weights[j]) for f, j in number.items() if weights[j]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(id, held_out, score, predicted) of every text, by a classifier that is fitted on the
    labels of documents that are not held out."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    classifier = fit(plain, marked.where(~held_out(F.col("id"))))
    ddl = "id bigint, score double"
    schema = arrow_schema(ddl)

    def make():
        of = classifier.scorer()
        return lambda batch: as_batch(
            {"id": batch.column(0), "score": [of(text.as_py()) for text in batch.column(1)]}, schema
        )

    scored = map_batches(plain.select(F.col("id").cast("long").alias("id"), "text"), make, ddl)
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
