"""Phrase collocations, counted through a prefix-free parse.

A text is cut where the hash of two neighbouring words is a trigger. As the cut depends on the words alone, passages that
occur in many texts give the same chunks, and every chunk is kept once, with the number of times it occurs. A chunk owns
the phrases that begin before the next cut and runs on for as many words as a phrase can need, so every phrase of the
text begins in exactly one chunk, and what overlaps is counted once.

Phrases are then counted in the distinct chunks, each weighted by its number, from one word upwards. A phrase can only be
frequent if both phrases that are a word shorter are; those are looked up in a bit table of bounded size, which lets
through whatever is frequent and sometimes more. Counts are therefore exact, and those of rare phrases never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import bit_table, in_table, staged

SIZE, LEAST, TOP = 5, 100, 2000
#: One pair of words in so many is a trigger.
EVERY = 24
#: Bits of the table of frequent phrases of one length: 2 to the power of these, 8 MB at most.
MOST = 26
#: Salts over which the rows of one language are ranked before the first of each are ranked together.
SALTS = 64
# Chunks a task gathers before it hands them on, and words that are counted together.
HELD, WORDS = 100_000, 1_000_000
# Hashes of words that a task remembers.
REMEMBERED = 500_000

_BREAK = b"\n"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
_MIX, _STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def parse(text: bytes, hashes: dict[bytes, int], size: int = SIZE, every: int = EVERY) -> Iterator[tuple[int, bytes]]:
    """(words owned, chunk) for each chunk: words and piece breaks joined by spaces, with the words that run on."""
    tokens = [t for t in text.translate(_FOLD).replace(_BREAK, b" \n ").split(b" ") if t]
    if not tokens:
        return
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    cuts = np.flatnonzero(((h[:-1] * _MIX + h[1:]) * _STEP >> np.uint64(33)) % np.uint64(every) == 0) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*starts[1:], len(tokens)]):
        yield b - a, b" ".join(tokens[a:b + size - 1])


def chunk_dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE, every: int = EVERY) -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of each language and how often they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held = _Hashes(), {}, 0

        def out() -> pa.RecordBatch:
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "own", "n"])

        for batch in batches:
            for name, given in zip(batch.column(0).to_pylist(), batch.column(1)):
                for own, chunk in parse(given.as_py() or b"", hashes, size, every):
                    key = (name, own, chunk)
                    if key in seen:
                        seen[key] += 1
                    else:
                        seen[key] = 1
                        held += len(chunk)
                if len(seen) > HELD or held > 64 * HELD:
                    yield out()
                    held = 0
        yield out()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, chunk binary, own int, n long").groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def _counted(chunks: pa.Table, length: int, tables: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """(lang, phrase, f, h) of the phrases of ``length`` words that begin in the owned part of the chunks.

    ``tables`` holds the frequent phrases of each smaller length. For single words, a row without a phrase has all words.
    """
    lists = pc.split_pattern(chunks.column("chunk").combine_chunks(), b" ")
    ends = lists.offsets.to_numpy()
    start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
    coded = lists.flatten().dictionary_encode()
    ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    langs = chunks.column("lang").combine_chunks().dictionary_encode()
    lang_id, lang_names = langs.indices.to_numpy().astype(np.int64), langs.dictionary.to_pylist()
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))[ids]
    row = np.repeat(np.arange(len(start)), end - start)
    lang_hash = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in lang_names), np.uint64, len(lang_names))
    first = lang_hash[lang_id[row]]
    end, places = end[row], np.arange(len(ids))
    stop = names.index(_BREAK) if _BREAK in names else -1
    # Places where a phrase of the length so far begins whose parts are frequent, and the hashes of those phrases.
    at = np.flatnonzero(ids != stop)
    h = first[at] * _MIX + word[at]
    for size, table in enumerate(tables, 2):
        fits = in_table(h * _LAST, table)
        at, h = at[fits], h[fits]
        follows = np.zeros(len(ids) + 1, bool)
        follows[at] = True
        goes = follows[at + 1] & (at + size <= end[at])
        at = at[goes]
        h = h[goes] * _MIX + word[at + size - 1]
    own = places - start[row] < chunks.column("own").to_numpy()[row]
    at, h = at[own[at]], h[own[at]]
    weight = chunks.column("n").to_numpy()[row[at]]
    group = lang_id[row[at]]
    for k in range(length):
        group = pd.factorize(group * len(names) + ids[at + k])[0]
    many = int(group.max(initial=-1)) + 1
    f, seen = np.zeros(many, np.int64), np.zeros(many, np.int64)
    np.add.at(f, group, weight)
    seen[group[::-1]] = np.arange(len(at))[::-1]
    spot = at[seen]
    phrases = [b" ".join(map(names.__getitem__, x)) for x in ids[spot[:, None] + np.arange(length)].tolist()]
    tongue, h, totals = lang_id[row[spot]].tolist(), (h[seen] * _LAST).view(np.int64), []
    if length == 1:
        total = np.zeros(len(lang_names), np.int64)
        np.add.at(total, lang_id[row[at]], weight)
        totals = total.tolist()
    columns = [pa.array([lang_names[i] for i in tongue] + lang_names[:len(totals)], pa.string()), pa.array(phrases + [None] * len(totals), pa.binary()), pa.array(f.tolist() + totals, pa.int64()), pa.array(h.tolist() + [0] * len(totals), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f", "h"])


def _phrases(chunks: DataFrame, length: int, tables: list[tuple[int, np.ndarray]], least: int) -> DataFrame:
    """(lang, phrase, f, h) of the phrases of ``length`` words with f of ``least`` and more; see ``_counted``."""
    held = chunks.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, words = [], 0
        for batch in batches:
            # Slices, so that long chunks are not split all at once.
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                waiting.append(part)
                words += pc.sum(pc.count_substring(part.column(1), b" ")).as_py() or 0
                if words > WORDS:
                    yield _counted(pa.Table.from_batches(waiting), length, held.value)
                    waiting, words = [], 0
        if waiting:
            yield _counted(pa.Table.from_batches(waiting), length, held.value)

    found = chunks.select("lang", "chunk", "own", "n").mapInArrow(run, "lang string, phrase binary, f long, h long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("h").alias("h")).where((F.col("f") >= least) | F.col("phrase").isNull())


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE, least: int = LEAST, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of all phrases of up to ``size`` words that occur ``least`` times, and (lang, n) with all words."""
    chunks = staged(chunk_dictionary(docs, text, lang, size, every))
    singles = staged(_phrases(chunks, 1, [], least))
    totals = singles.where("phrase is null").select("lang", F.col("f").alias("n"))
    level = singles.where("phrase is not null")
    levels, tables = [level], []
    for length in range(2, size + 1):
        tables.append(bit_table(level, "h", MOST))
        level = staged(_phrases(chunks, length, tables, least))
        levels.append(level)
        if level.isEmpty():
            break
    found = None
    for m, level in enumerate(levels, 1):
        part = level.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(m).alias("m"), "f")
        found = part if found is None else found.unionByName(part)
    return staged(found), totals


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``: first inside salts, then among those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_salt", "_r")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE, least: int = LEAST, top: int = TOP, every: int = EVERY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language, one row each.

    A phrase of two to ``size`` words occurs a times, at least ``least``; its weakest cut into two phrases that occur l
    and r times gives it floor(1000 a n / (l r)), n being all words of the language. A phrase that never occurs outside
    one longer candidate is left out. Null and empty texts have no words, a null language is ``und``; repeated rows count
    each; texts of any length are parsed whole. Other columns are ignored. An empty table gives no rows.
    """
    found, totals = frequent_phrases(docs, text, lang, size, least, every)
    several = found.where("m > 1")
    # A longer candidate around a phrase occurs at most as often as the phrases between them: one word more is enough.
    words = F.split("phrase", " ")
    cut = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    inside = several.where("m > 2").select("lang", F.explode(F.array(cut(F.lit(1), F.col("m") - 1), cut(F.lit(2), F.col("m") - 1))).alias("phrase"), "f")
    kept = several.join(inside.distinct(), ["lang", "phrase", "f"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("_left"), cut(F.col("k") + 1, F.col("m") - F.col("k")).alias("_right"))
    counts = lambda side, name: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    joined = parts.join(counts("_left", "l"), ["lang", "_left"]).join(counts("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    weakest = joined.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    rows = weakest.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    return _first(rows, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
