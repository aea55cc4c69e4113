"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, so the training tokens get theirs from a rule: in a toxic document a token is toxic if
its word, or a beginning of it, is several times as frequent in toxic documents as in others. The field learns from
these tokens (words and their beginnings as features, and the label of the token before); forward-backward marginals
then say how likely each token is toxic in its place. A small logistic model, fitted on documents that the field has
not seen, turns the marginals of a document into its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.quality import held_out, labelled_sample

#: Labelled rows that the model is fitted on, at most, and the longest text among them.
SAMPLE = 4000
SAMPLE_CHARS = 200_000
PREFIXES = (4, 5, 6, 7)
#: A feature marks tokens if so many toxic sample documents have it, and so many times as often as the others.
LEAST, RATIO = 4, 5.0
THRESHOLD, TOXIC_TOKEN = 0.7, 0.5
#: Tokens of one forward-backward pass: documents are scored together up to about this many.
TOKENS = 200_000
#: Emissions of words that a task remembers.
REMEMBERED = 500_000

_WORD = re.compile(r"\w+")


def lowered(text: str | None) -> str:
    """Small letters, as many code points as before."""
    text = text or ""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def marginals(emission: np.ndarray, starts: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label 1) of every token, and the ratios of the forward and backward messages (label 1 over label 0).

    ``emission`` holds the scores of label 1 over label 0, the chains one after the other; ``a`` is (begin, 0 to 1,
    1 to 0, 1 to 1). Each message is a function of its neighbour's that draws ratios together, so all tokens are
    updated at once until nothing moves: exact after as many rounds as the longest chain has tokens, and in practice after few.
    """
    n, (begin, up, down, stay) = len(emission), np.exp(a)
    e = np.exp(np.clip(emission, -30, 30))
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    last = np.append(first[1:], True) if n else first
    forward, backward = e * up, np.ones(n)
    for _ in range(n):
        before = np.concatenate([[0.0], forward[:-1]])
        new = np.where(first, e * begin, e * (up + stay * before) / (1 + down * before))
        moved = np.abs(new - forward) > 1e-10 * new
        forward = new
        if not moved.any():
            break
    for _ in range(n):
        after = np.append((e * backward)[1:], 0.0)
        new = np.where(last, 1.0, (down + stay * after) / (1 + up * after))
        moved = np.abs(new - backward) > 1e-10 * new
        backward = new
        if not moved.any():
            break
    both = forward * backward
    return both / (1 + both), forward, backward


class Field:
    """Weights by feature, transitions (begin, 0 to 1, 1 to 0, 1 to 1), bias, and the document model."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, bias: float, document: np.ndarray):
        self.weights, self.transitions, self.bias, self.document = weights, transitions, bias, document
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.bias + sum(self.weights.get(f, 0.0) for f in features(w))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def tag(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each lowered text: marginals of its tokens, and a feature row for the document model."""
        words = [_WORD.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        emission = np.concatenate([self.emissions(w) for w in words]) if len(words) else np.empty(0)
        p = marginals(emission, ends - lengths, self.transitions)[0]
        return [(q, summary(q)) for q in np.split(p, ends[:-1])] if len(words) else []

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(row @ self.document, -40, 40))))


def summary(p: np.ndarray) -> np.ndarray:
    """Expected number of toxic tokens, its share of the text, and the surest token."""
    total = float(p.sum())
    return np.array([1.0, np.log1p(total), total / (len(p) + 10.0) * 10, float(p.max(initial=0.0))])


def distant_labels(words: list[list[str]], y: np.ndarray) -> set[str]:
    """Features that mark tokens of toxic documents as toxic."""
    counts: dict[str, list[int]] = {}
    for doc, label in zip(words, y):
        for f in {f for w in set(doc) for f in features(w)}:
            counts.setdefault(f, [0, 0])[label] += 1
    toxic, other = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    return {f for f, (n0, n1) in counts.items() if n1 >= LEAST and n1 / toxic >= RATIO * (n0 + 0.5) / (other + 1)}


def train_field(words: list[list[str]], y: np.ndarray, rounds: int = 80, penalty: float = 0.5) -> Field:
    """Penalized maximum likelihood over all tokens, by gradient steps with a rate for each weight (Adagrad)."""
    marks = distant_labels(words, y)
    names: dict[str, int] = {}
    seen: dict[str, int] = {}
    for doc in words:
        for f in {f for w in set(doc) for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    rows: dict[str, list[int]] = {}
    width = 1 + len(PREFIXES)
    for w in sorted({w for doc in words for w in doc}):
        ids = [names.setdefault(f, len(names) + 1) for f in features(w) if seen[f] >= 3]
        rows[w] = ids + [0] * (width - len(ids))
    order = {w: i for i, w in enumerate(rows)}
    table = np.array(list(rows.values()), np.int32).reshape(-1, width)
    toxic_word = np.array([any(f in marks for f in features(w)) for w in rows], bool)
    flat = np.fromiter((order[w] for doc in words for w in doc), np.int32, sum(map(len, words)))
    lengths = np.array([len(d) for d in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    starts = starts[lengths > 0]
    gold = toxic_word[flat] & np.repeat(y.astype(bool), lengths)
    first = np.zeros(len(flat), bool)
    first[starts] = True
    inner = np.flatnonzero(~first)
    observed = np.array([gold[first].sum(), (~gold[inner - 1] & gold[inner]).sum(), (gold[inner - 1] & ~gold[inner]).sum(), (gold[inner - 1] & gold[inner]).sum()], float)
    w, bias, a = np.zeros(len(names) + 1), -3.0, np.zeros(4)
    memory_w, memory_a, memory_b = np.full(len(w), 1e-6), np.full(4, 1e-6), 1e-6
    for _ in range(rounds if len(flat) else 0):
        emission = (w[table].sum(1) + bias)[flat]
        p, forward, backward = marginals(emission, starts, a)
        rest = gold - p
        by_word = np.bincount(flat, rest, len(table))
        g = np.zeros(len(w))
        np.add.at(g, table, by_word[:, None])
        g[0] = 0.0
        g -= penalty * w
        up, down, stay = np.exp(a[1:])
        after = np.exp(np.clip(emission[inner], -30, 30)) * backward[inner]
        before = forward[inner - 1]
        pairs = np.stack([up * after, down * before, stay * before * after])
        pairs /= 1 + pairs.sum(0)
        ga = observed - np.concatenate([[p[first].sum()], pairs.sum(1)]) - penalty * a
        gb = rest.sum()
        memory_w, memory_a, memory_b = memory_w + g * g, memory_a + ga * ga, memory_b + gb * gb
        w, a, bias = w + 0.6 * g / np.sqrt(memory_w), a + 0.3 * ga / np.sqrt(memory_a), bias + 0.3 * gb / np.sqrt(memory_b)
    return Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, a, float(bias), np.zeros(4))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        pull = penalty * np.append(0.0, np.ones(x.shape[1] - 1))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (p - y) + pull * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[str, int]]) -> Field:
    """Without rows of both labels every text is scored with the share of label 1, drawn towards one half by one row each."""
    y = np.array([label for _, label in sample], np.int64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Field({}, np.zeros(4), -3.0, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    texts = [lowered(t) for t, _ in sample]
    # One object for each word, however often it occurs.
    pool: dict[str, str] = {}
    words = [[pool.setdefault(w, w) for w in _WORD.findall(t)] for t in texts]
    # Two thirds of each label's rows go to the field, the rest to the document model.
    turn = np.zeros(len(y), np.int64)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        turn[at] = np.arange(len(at)) % 3
    fitted = np.flatnonzero(turn < 2)
    field = train_field([words[i] for i in fitted], y[fitted])
    rest = np.flatnonzero(turn == 2) if len(set(y[turn == 2].tolist())) == 2 else np.arange(len(y))
    x = np.stack([row for _, row in field.tag([texts[i] for i in rest])])
    field.document = logistic(x, y[rest])
    return field


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1, rows: int = SAMPLE) -> Field:
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    return fit(labelled_sample(short, labels, "toxic", ~held_out("doc_id", parts, rest), rows))


def tag_toxic(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score, spans) of whole texts: ``spans`` are half-open code-point ranges of toxic tokens, neighbours merged.

    A null text counts as empty: no tokens, scored by the document model's constant. Repeated rows get equal results.
    Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    frame = docs.select("doc_id", "text")

    def spans(text: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        if (p < TOXIC_TOKEN).all():
            return out
        before = -2
        for i, match in enumerate(_WORD.finditer(text)):
            if p[i] >= TOXIC_TOKEN:
                if before == i - 1:
                    out[-1]["end"] = match.end()
                else:
                    out.append({"start": match.start(), "end": match.end()})
                before = i
        return out

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found, texts, waiting = [], [], [], 0

            def flush():
                for text, (p, row) in zip(texts, held.value.tag(texts)):
                    scores.append(held.value.score(row))
                    found.append(spans(text, p))
                texts.clear()

            for t in batch.column(1):
                texts.append(lowered(t.as_py()))
                waiting += len(texts[-1]) // 6
                if waiting > TOKENS:
                    flush()
                    waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])

    return frame.mapInArrow(tag, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int>>")


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, rest: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_spans), one row per row of ``docs``; labels, language, source and id are no inputs."""
    tagged = tag_toxic(docs, learn(docs, labels, parts, rest))
    return tagged.select("doc_id", held_out("doc_id", parts, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
