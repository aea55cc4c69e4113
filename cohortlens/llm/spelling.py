"""Spelling variants by pivotal grams.

Two words are near if one edit (a code point inserted, deleted or replaced) makes one the other. Every word has a prefix
of its rarest bigrams, and among them two disjoint ones, its pivots, chosen by dynamic programming. One edit touches at
most one of two disjoint bigrams. So of two near words, the one whose prefix ends earlier in the order of rarity keeps a
pivot that the other has among its prefix bigrams, shifted by at most one place; and as the edit lies on one side of that
bigram, all that lies on its other side is equal. Prefix bigrams are filed under that equal part, on either side, and
what meets a pivot there is verified.

A word leads to the frequent form of it, the near word that occurs at least ten times as often, and forms lead to a root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

LETTERS = r"A-Za-zÀ-ÿ"
#: Words have at least so many code points and occurrences; a form occurs so many times as often as its word.
LENGTH, LEAST, TIMES = 7, 2, 10
#: One run in so many, by a hash of document and run, is written with a code point missing.
MISSING = 31
GRAM, EDITS = 2, 1
#: A bucket with more entries than this is filed anew by halves of what is not yet equal.
CROWD = 10_000
# Words that a task counts before it hands its counts on.
HELD = 200_000

_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """A-Z as small letters; other letters stay."""
    return run.lower() if run.isascii() else run.translate(_SMALL)


def written(doc: str, run: str, missing: int = MISSING) -> str:
    """The lower-cased ``run`` as the document is taken to have it."""
    h = zlib.crc32(f"{doc}:{run}".encode("utf-8", "surrogatepass"))
    return run if h % missing else run[:h % len(run)] + run[h % len(run) + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, missing: int = MISSING) -> DataFrame:
    """(word, n): words of at least ``length`` code points that occur ``least`` times or more over all texts.

    A null text has no words, a null id is written as the empty text; each of several repeated rows counts.
    """
    run_of = re.compile(f"[{LETTERS}]{{{length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for doc, given in zip(batch.column(0).to_pylist(), batch.column(1)):
                for run, times in Counter(run_of.findall(given.as_py() or "")).items():
                    word = written(doc, lowered(run), missing)
                    if len(word) >= length:
                        seen[word] += times
                if len(seen) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Occurrences of each bigram in the words: at most 90 x 90 of them, as words have 26 + 64 letters."""
    places = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(places, lambda i: F.substr(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix(word: str, counts: dict[str, int]) -> list[int]:
    """Places of the rarest bigrams: the first ``GRAM * EDITS + 1`` in the order of rarity, and all that equal the last of them."""
    order = sorted((counts[word[p:p + GRAM]], word[p:p + GRAM], p) for p in range(len(word) - GRAM + 1))
    last = order[:GRAM * EDITS + 1][-1][:2]
    return sorted(p for n, gram, p in order if (n, gram) <= last)


def pivots(word: str, places: list[int], counts: dict[str, int]) -> list[int]:
    """``EDITS + 1`` disjoint bigrams among ``places`` (ascending) with the fewest occurrences in all.

    ``best[j]`` holds, for the places gone through, the lightest choice of j disjoint ones.
    """
    wanted = EDITS + 1
    done: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for i, p in enumerate(places):
        # The last place that is disjoint from p.
        back = i - 1
        while back >= 0 and places[back] > p - GRAM:
            back -= 1
        earlier = done[back] if back >= 0 else [(0, ())] + [None] * wanted
        best = list(done[-1]) if done else [(0, ())] + [None] * wanted
        for j in range(1, wanted + 1):
            if earlier[j - 1] is not None:
                taken = (earlier[j - 1][0] + counts[word[p:p + GRAM]], (*earlier[j - 1][1], p))
                if best[j] is None or taken < best[j]:
                    best[j] = taken
        done.append(best)
    return list(done[-1][wanted][1])


def _filed(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(bucket, word, n, rest, pivot): each prefix bigram twice, with the part before it or after it open to the edit."""
    held = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places = prefix(word, held.value)
                chosen = pivots(word, places, held.value)
                for p in places:
                    rows.append((f"<{word[:p + GRAM]}", word, n, word[p + GRAM:], p in chosen))
                    rows.append((f">{word[p:]}", word, n, word[:p], p in chosen))
            names = ["bucket", "word", "n", "rest", "pivot"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names)

    return words.select("word", "n").mapInArrow(run, "bucket string, word string, n long, rest string, pivot boolean")


def _by_halves(filed: DataFrame) -> DataFrame:
    """Entries of crowded buckets under longer keys: what is open differs in one place, so one half of it is equal."""
    m = F.length("rest")

    def keys(short: F.Column, long: F.Column) -> list:
        # Halves of the shorter of two open parts; a longer one has the same first or last code points.
        half = F.floor(short / 2).cast("int")
        label = lambda side: F.concat_ws("|", "bucket", short.cast("string"), long.cast("string"), F.lit(side))
        return [F.concat(label("a"), F.lit("|"), F.substr("rest", F.lit(1), half)), F.concat(label("z"), F.lit("|"), F.substr("rest", m - (short - half) + 1, short - half))]

    every = F.array(*keys(m, m), *keys(m, m + 1), *keys(m - 1, m))
    return filed.withColumn("bucket", F.explode(F.when(m > 0, every).otherwise(F.array(*keys(m, m), *keys(m, m + 1)))))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _met(members: list[tuple[str, int, str, bool]]) -> Iterator[tuple]:
    """Near pairs among the members (word, n, rest, pivot) of a bucket that have a pivot, in time linear in the members."""
    if len(members) < 2 or not any(m[3] for m in members):
        return
    whole = {m[2]: m for m in members}
    cut: dict[tuple[int, str], list] = {}
    for member in members:
        rest = member[2]
        for i in range(len(rest)):
            left = rest[:i] + rest[i + 1:]
            shorter = whole.get(left)
            found = cut.setdefault((i, left), [])
            # Of equal neighbours in a row, the same is left whichever of them goes.
            for other in found + ([shorter] if shorter and (i == 0 or rest[i] != rest[i - 1]) else []):
                if (member[3] or other[3]) and one_edit(member[0], other[0]):
                    yield member[0], member[1], other[0], other[1]
                    yield other[0], other[1], member[0], member[1]
            found.append(member)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of near words of ``words`` (word, n), once."""
    filed = staged(_filed(words, gram_counts(words)))
    crowded = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") > 1).withColumn("crowded", F.col("met") > CROWD).drop("met")
    shared = filed.join(crowded, "bucket")
    together = shared.where("not crowded").drop("crowded").unionByName(_by_halves(shared.where("crowded").drop("crowded")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["word", "n", "near", "near_n"])

        for batch in batches:
            rows: list[tuple] = []
            for bucket, *member in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket != key:
                    rows.extend(_met(members))
                    key, members = bucket, []
                members.append(tuple(member))
            yield out(rows)
        yield out(list(_met(members)))

    dealt = together.select("bucket", "word", "n", "rest", "pivot").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(verify, "word string, n long, near string, near_n long").distinct()


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n).

    The form is the near word of largest n, of several the first in code-point order, if it occurs ``times`` times as
    often. Counts grow along forms, so they end in a root; it is found by doubling the way each time.
    """
    words = staged(words)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    held = staged(near.select("word", "n_near", F.when(-F.col("best.minus") >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f")))
    forms = held.where("f is not null").select("word", F.col("f.form").alias("root"))
    while True:
        forms = staged(forms)
        onward = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if forms.join(onward, "root", "left_semi").isEmpty():
            break
        forms = forms.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    joined = words.join(held, "word", "left").join(forms, "word", "left")
    return joined.select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form_n").alias("form_n"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the texts of ``docs``.

    Null and empty texts have no words; a null id is written as the empty text; repeated rows count each. A word of any
    length is taken whole. Other columns are ignored. An empty table gives no rows.
    """
    return spelling_forms(word_counts(docs, doc_id, text))
