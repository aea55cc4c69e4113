"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of the id), by dual coordinate
descent on the hinge loss, and its margins become probabilities by a logistic curve fitted on rows held back from the
descent. Scoring is one pass over all documents, whole, with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import free_name

#: Labelled rows that the model is fitted on, at most; taken in the order of a hash of the id.
SAMPLE = 4000
#: N-grams seen in fewer sampled documents than this are left out.
LEAST = 3
THRESHOLD = 0.7

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_WORD = re.compile(r"\w+")
_CAPITALS = re.compile(r"[A-Z]{2}")
#: Bits of a token number inside the number of a pair.
_PAIR = 32
#: Token numbers with a meaning of their own: unknown word, the word before it again, the same word three times.
UNKNOWN, AGAIN, THRICE, CAPITALS, FIRST = 0, 1, 2, 3, 4


def held_out(doc_id: str | Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnt: Column, rows: int) -> list:
    """At most ``rows`` labelled (text, y), distinct texts first met in the order of a hash of the id.

    Only ids and labels are sorted; the texts are read for the sample alone.
    """
    marks = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).where(learnt)
    chosen = marks.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "y")
    return [(r.text or "", int(r.y)) for r in met.limit(2 * rows).collect()]


def _grams(ids: np.ndarray, marks: list[int]) -> np.ndarray:
    """Distinct n-grams of token numbers: single ones, pairs, and the marks for repeats and capitals."""
    left, right = ids[:-1], ids[1:]
    pairs = ((left << _PAIR) | right)[(left >= FIRST) & (right >= FIRST)]
    return np.unique(np.concatenate([np.array(marks, np.int64), ids[ids >= FIRST], pairs]))


@dataclass
class Model:
    vocabulary: dict[str, int]
    grams: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        small = text.lower()
        words = _TOKEN.findall(small)
        ids = np.fromiter(map(self.vocabulary.get, words, [UNKNOWN] * len(words)), np.int64, len(words))
        # Repeats count across punctuation, and for unknown words as well.
        plain = _WORD.findall(small)
        same = np.fromiter(map(str.__eq__, plain[1:], plain[:-1]), bool, max(len(plain) - 1, 0))
        marks = [AGAIN] * bool(same.any()) + [THRICE] * bool((same[1:] & same[:-1]).any()) + [CAPITALS] * bool(_CAPITALS.search(text))
        return _grams(ids, marks)

    def margin(self, text: str | None) -> float:
        found = self.features(text)
        if not len(self.grams):
            return self.bias
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        return self.bias + float(self.weights[at[self.grams[at] == found]].sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -40, 40))))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss machine: one dual variable at a time, in a shuffled order each round.

    ``rows`` hold feature numbers, ``values`` the value of each feature wherever it occurs, the last one the bias.
    """
    w, alpha = np.zeros(len(values)), np.zeros(len(rows))
    norms = np.array([float((values[r] ** 2).sum()) for r in rows])
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        most = 0.0
        for i in order:
            gradient = y[i] * float((w[rows[i]] * values[rows[i]]).sum()) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[rows[i]]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def logistic_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the curve through margins, with the targets drawn in by one row each (Platt, 1999)."""
    positive, negative = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def fit(sample: list[tuple[str, int]], smoothing: float = 1.0, cost: float = 0.05) -> Model:
    """A model of labelled texts. Without rows of both labels it scores every text with the share of label 1, one half without any row."""
    y = np.array([1 if label else -1 for _, label in sample])
    share = ((y > 0).sum() + 1) / (len(y) + 2) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model({}, np.empty(0, np.int64), np.empty(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    seen: dict[str, int] = {}
    for t, _ in sample:
        for w in set(_TOKEN.findall(t.lower())):
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i + FIRST for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST))}
    model = Model(vocabulary, np.empty(0, np.int64), np.empty(0), 0.0, 1.0, 0.0)
    found = [model.features(t) for t, _ in sample]
    grams, counts = np.unique(np.concatenate(found), return_counts=True)
    grams = grams[counts >= LEAST]
    rows = [np.searchsorted(grams, np.intersect1d(f, grams, assume_unique=True)) for f in found]
    # Every fifth row is held back for the curve.
    back = np.arange(len(rows)) % 5 == 4
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back = np.zeros(len(rows), bool)
    fitted = np.flatnonzero(~back)
    p, q = np.full(len(grams), smoothing), np.full(len(grams), smoothing)
    for i in fitted:
        (p if y[i] > 0 else q)[rows[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = np.append(ratio, 1.0)
    whole = [np.append(r, len(grams)) for r in rows]
    # Both labels weigh the same in all.
    weight = {s: len(fitted) / (2 * max(1, (y[fitted] == s).sum())) for s in (1, -1)}
    w = dual_descent([whole[i] for i in fitted], values, y[fitted], np.array([cost * weight[s] for s in y[fitted]]))
    model.grams, model.weights, model.bias = grams, (w * values)[:-1], float(w[-1])
    margins = np.array([model.bias + model.weights[r].sum() for r in rows])
    used = back if back.any() else np.ones(len(rows), bool)
    model.slope, model.shift = logistic_curve(margins[used], y[used])
    return model


def scored(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text added; the model is of bounded size and travels with the task."""
    kept = docs.drop(column)
    at, schema = kept.columns.index("text"), T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([held.value.score(t.as_py()) for t in batch.column(at)], pa.float64())], names=schema.names)

    return kept.mapInArrow(score, schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, rest: int = 2, rows: int = SAMPLE) -> Model:
    """Fit on labelled rows whose remainder is not ``rest``; null ids, null labels and labels without a document are passed over."""
    return fit(labelled_sample(docs, labels, label, ~held_out("doc_id", parts, rest), rows))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, rest: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    A null text is scored as an empty one: by the bias alone. Repeated rows get equal scores. Labels, language, source
    and id are no inputs of a score; other columns are ignored.
    """
    model = learn(docs, labels, "quality", parts, rest)
    out = scored(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", held_out("doc_id", parts, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    Where nothing could be learnt, for want of labelled documents of both kinds, no row is rejected. A null text is judged
    as an empty one, equal texts alike; texts are read whole. An empty table gives no rows.
    """
    model = learn(docs, labels)
    if not len(model.grams):
        return docs
    score = free_name(docs, "_score")
    return scored(docs, model, score).where(F.col(score) >= threshold).select(*docs.columns)
