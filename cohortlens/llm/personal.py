"""Personal data: exact patterns, and further mentions of them by a skip-chain conditional random field.

The base spans follow from patterns alone. What a pattern misses is often a second mention in another form: a telephone
number without its plus sign, an address cut off after the host. The nodes of the field are the tokens of a document that
hold a digit or an at sign; all other words can only be "none", so the chain falls apart there without loss. Neighbours
share the potential of a chain. Tokens that are equal or end in the same digits, however far apart, share another one that
draws their labels together: each is linked to the next of its kind, so a document has no more links than tokens. Base
spans are observed; loopy message passing carries them to the other mentions.

The weights are trained on a sample whose labels are the base spans. In training, a base mention gets a twin in plain form, so
that the field learns that such a token is "none" on its own and personal data beside a mention that is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Documents the field is trained on, at most, and the longest text among them.
SAMPLE, SAMPLE_CHARS = 1500, 50_000
#: Belief from which a token becomes a span.
SURE = 0.8
#: Digits at the end that make two numbers similar.
TAIL = 7
#: Weight that linked tokens have the same label, before anything is learnt.
AGREE = 3.0
ROUNDS, DAMP = 60, 0.25
# Tokens of one run of message passing: documents are taken together up to about this many.
TOKENS = 50_000

_ANY = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"@[A-Za-z0-9-]+")
# A match never begins inside a run of digits: what precedes it was matched to its end.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])*+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile("[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from the at signs, so that long words cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, by start, then kind."""
    if not _ANY.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(found)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the nodes, in order and apart from each other; those that are no base span have label ``NONE``."""
    taken: list[tuple[int, int, int]] = []
    for s, kind, e in base:
        if not taken or s >= taken[-1][1]:
            taken.append((s, e, kind))
    loose, at = [], text.find("@")
    while at >= 0:
        start = at
        while start > 0 and at - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at)
        if start < at and host:
            loose.append((start, host.end(), NONE))
        at = text.find("@", at + 1)
    loose += [(*m.span(), NONE) for m in _NUMBER.finditer(text)]
    # Base spans first, then addresses, then numbers: what overlaps an earlier one is left out.
    every = sorted([(s, 0, e, k) for s, e, k in taken] + [(s, 1 if "@" in text[s:e] else 2, e, k) for s, e, k in loose])
    out: list[tuple[int, int, int]] = []
    blocked = iter([*taken, (len(text) + 1, len(text) + 1, NONE)])
    block = next(blocked)
    for s, rank, e, label in every:
        while block[1] <= s:
            block = next(blocked)
        if rank and e > block[0] or out and s < out[-1][1]:
            continue
        out.append((s, e, label))
    return out


def marks(token: str) -> list[str]:
    """What the form of a token says at once."""
    digits = "".join(_DIGITS.findall(token))
    out = ["at"] * ("@" in token) + ["plus"] * token.startswith("+") + ["paren"] * ("(" in token)
    if 14 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    parts = token.split(".")
    if len(parts) == 4 and all(p.isdigit() and _byte(p) for p in parts):
        out.append("quad")
    if "@" in token and "." in token[token.index("@"):]:
        out.append("domain")
    return out


def features(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """(marks of the form, everything else) of the token at ``start``."""
    token = text[start:end]
    rest = [f"digits{min(len(_DIGITS.findall(token)), 20)}", f"dots{min(token.count('.'), 4)}"]
    if any(c.isalnum() or c == "_" for c in text[max(0, start - 1):start] + text[end:end + 1]):
        rest.append("joined")
    before, after = _WORD.findall(text[max(0, start - 24):start]), _WORD.search(text[end:end + 24])
    return marks(token), rest + ([f"<{before[-1].lower()}"] if before else []) + ([f">{after.group().lower()}"] if after else [])


def likeness(token: str) -> str:
    """Equal for tokens that are taken as similar: the last digits of a long number, an address up to its first host name."""
    if "@" in token:
        return token[:token.index("@")].lower() + "@" + token[token.index("@") + 1:].split(".")[0].lower()
    digits = "".join(_DIGITS.findall(token))
    return digits[-TAIL:] if len(digits) >= TAIL else token


def edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): neighbours with no word between them, and each token with the next similar one."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if not _WORD.search(text, nodes[i][1], nodes[i + 1][0])]
    skip, last = [], {}
    for i, (s, e, _) in enumerate(nodes):
        key = likeness(text[s:e])
        if key in last:
            skip.append((last[key], i))
        last[key] = i
    return chain, skip


def beliefs(emission: np.ndarray, pairs: np.ndarray, potential: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loopy message passing: P(label) of every node and P(label, label) of every edge.

    ``emission`` has a row of scores per node, ``pairs`` the two nodes of each edge, ``potential`` its table of scores.
    Without cycles the result is exact; with cycles it is the fixed point that damped rounds reach.
    """
    n, k = emission.shape
    m = len(pairs)
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    table = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, k))

    def total() -> np.ndarray:
        out = emission.copy()
        np.add.at(out, target, message)
        return out

    for _ in range(ROUNDS if m else 0):
        cavity = total()[source] - message[back]
        new = np.logaddexp.reduce(cavity[:, :, None] + table, axis=1)
        new -= new.max(1, keepdims=True)
        new = DAMP * message + (1 - DAMP) * new
        moved = np.abs(new - message).max()
        message = new
        if moved < 1e-9:
            break
    full = total()
    both = (full[source[:m]] - message[back[:m]])[:, :, None] + potential + (full[target[:m]] - message[:m])[:, None, :]

    def shares(x: np.ndarray, axes: tuple) -> np.ndarray:
        x = np.exp(x - x.max(axes, keepdims=True))
        return x / x.sum(axes, keepdims=True)

    return shares(full, (1,)), shares(both, (1, 2)) if m else np.zeros((0, k, k))


class Field:
    """Weights of features by label, and the scores of neighbouring and of linked labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.weights, self.chain, self.skip = names, weights, chain, skip

    def emission(self, found: list[list[str]]) -> np.ndarray:
        out = np.tile(self.weights[0], (len(found), 1))
        for i, names in enumerate(found):
            for f in names:
                if f in self.names:
                    out[i] += self.weights[self.names[f]]
        return out


def train(texts: list[str], rounds: int = 120, penalty: float = 0.02) -> Field | None:
    """Approximate maximum likelihood: gradients from the beliefs, a rate for each weight. Without any token, none."""
    found: list[list[str]] = []
    gold: list[int] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    for text in texts:
        nodes = tokens(text, base_spans(text))
        first = len(found)
        for s, e, label in nodes:
            form, rest = features(text, s, e)
            found.append(form + rest)
            gold.append(label)
        near, far = edges(text, nodes)
        chain += [(first + a, first + b) for a, b in near]
        skip += [(first + a, first + b) for a, b in far]
        for i, (s, e, label) in enumerate(nodes):
            # The twin keeps the digits and nothing else of the form; its neighbours are not known.
            if label != NONE and zlib.crc32(text[s:e].encode("utf-8", "surrogatepass")) % 2:
                skip.append((first + i, len(found)))
                found.append([f for f in features(text, s, e)[1] if f.startswith("digits")])
                gold.append(label)
    if not found:
        return None
    seen: dict[str, int] = {}
    for fs in found:
        for f in fs:
            seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate((f for f in sorted(seen) if seen[f] >= 3), 1)}
    k = len(KINDS) + 1
    node = np.array([i for i, fs in enumerate(found) for f in fs if f in names], np.int64)
    feature = np.array([names[f] for fs in found for f in fs if f in names], np.int64)
    node, feature = np.concatenate([node, np.arange(len(found))]), np.concatenate([feature, np.zeros(len(found), np.int64)])
    y = np.eye(k)[gold]
    pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
    linked = np.arange(len(pairs)) >= len(chain)
    real = y[pairs[:, 0]][:, :, None] * y[pairs[:, 1]][:, None, :]
    prior = AGREE * np.eye(k)
    w, t, s = np.zeros((len(names) + 1, k)), np.zeros((k, k)), prior.copy()
    sums = [np.full_like(x, 1e-6) for x in (w, t, s)]
    for _ in range(rounds):
        emission = np.zeros((len(found), k))
        np.add.at(emission, node, w[feature])
        p, q = beliefs(emission, pairs, np.where(linked[:, None, None], s, t))
        gw = np.zeros_like(w)
        np.add.at(gw, feature, (y - p)[node])
        rest = real - q
        gs = rest[linked].sum(0)
        steps = (gw - penalty * w, rest[~linked].sum(0) - penalty * t, (gs + gs.T) / 2 - penalty * (s - prior))
        for x, g, memory in zip((w, t, s), steps, sums):
            memory += g * g
            x += 0.4 * g / np.sqrt(memory)
    return Field(names, w, t, s)


def learn(docs: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field | None:
    """The field trained on at most ``rows`` texts of at most ``chars`` code points with a digit or an at sign, chosen by a hash.

    Only hashes are sorted; the texts are read for the sample alone.
    """
    able = docs.select("text", F.xxhash64("text").alias("h")).where(F.length("text") <= chars).where(F.col("text").rlike("[0-9@]"))
    chosen = able.select("h").distinct().orderBy("h").limit(rows)
    texts = able.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h")
    return train([r.text for r in texts.collect()])


def spans_of(texts: list[str], field: Field | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans, and all its spans: (start, kind, end) by start, then kind."""
    base = [base_spans(t) for t in texts]
    if field is None:
        return [(b, b) for b in base]
    k = len(KINDS) + 1
    nodes, found, pairs, linked, owner = [], [], [], [], []
    for d, text in enumerate(texts):
        # A document without a base span has nothing to carry over, but may have tokens that speak for themselves.
        mine = tokens(text, base[d]) if _ANY.search(text) else []
        first = len(nodes)
        chain, skip = edges(text, mine)
        pairs += [(first + a, first + b) for a, b in chain + skip]
        linked += [False] * len(chain) + [True] * len(skip)
        for s, e, label in mine:
            nodes.append((s, e, label))
            found.append(sum(features(text, s, e), []))
            owner.append(d)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if nodes:
        emission = field.emission(found)
        for i, (_, _, label) in enumerate(nodes):
            if label != NONE:
                emission[i] = np.where(np.arange(k) == label, 0.0, -1e4)
        p, _ = beliefs(emission, np.array(pairs, np.int64).reshape(-1, 2), np.where(np.array(linked, bool)[:, None, None], field.skip, field.chain))
        for i in np.flatnonzero((p[:, :NONE].max(1) >= SURE) & (np.array([x[2] for x in nodes]) == NONE)).tolist():
            added[owner[i]].append((nodes[i][0], int(p[i, :NONE].argmax()), nodes[i][1]))
    return [(b, sorted(b + a)) for b, a in zip(base, added)]


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans, base), one row per row of ``docs``: arrays of (kind, start, end), in code points, end exclusive.

    ``spans`` holds the base spans and those that the field adds. A null or empty text has none; texts are read whole;
    repeated rows get equal results. ``field`` is trained on ``docs`` unless given. Other columns are ignored. An empty
    table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(field or learn(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, waiting, size = [], [], 0
            for t in batch.column(1):
                text = t.as_py() or ""
                waiting.append(text)
                size += sum(1 for _ in _ANY.finditer(text))
                if size > TOKENS:
                    out += spans_of(waiting, held.value)
                    waiting, size = [], 0
            out += spans_of(waiting, held.value)
            shown = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in part] for part in both] for both in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[1] for x in shown], kind), pa.array([x[0] for x in shown], kind)], ["doc_id", "spans", "base"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {spans}, base {spans}")
