"""SimHash fingerprints of whole documents, with DataFrame functions only.

Every term of a document (three words in a row; the whole text if it has fewer) is hashed to 128 bits and votes on each
of them with its weight, the number of its occurrences. Votes are counted in pairs: one long sum carries the votes of
two bits, so 64 sums in one hash aggregate count all of them. Fingerprints within a Hamming radius are found by permuted block
tables: the bits are cut into blocks, a table for each pair of blocks files the fingerprints under these two, and two
fingerprints that differ in at most (blocks - 2) bits share at least one entry.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import staged
from cohortlens.operators.scale import bucket_by_cuts

TERM = 3
BITS = 128
BLOCKS = 8
RADIUS = 6
#: Rows of one stretch of neighbours, and the most stretches; they decide balance only.
ROWS_PER_BAND, MOST_BANDS = 2000, 10_000

_BOTH = (1 << 32) | 1
_HALF = (1 << 32) - 1


def terms(words: Column, size: int = TERM) -> Column:
    """Array of structs (w0, w1, …) with the words of each term; fewer words are one term, no words an empty array."""
    count = F.greatest(F.size(words) - (size - 1), F.least(F.size(words), F.lit(1)))
    return F.arrays_zip(*[F.slice(words, F.lit(i + 1), count).alias(f"w{i}") for i in range(size)])


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", size: int = TERM) -> DataFrame:
    """(keys, fp_a, fp_b): the 128 bits of each text as two longs; a null or empty text has no votes and zero bits.

    ``keys`` name one row each. Where the rows are already distributed by some of the keys, nothing is shuffled.
    """
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    split = texts.select(*keys, words.alias("_words"))
    shown = split.select(*keys, F.inline_outer(terms(F.col("_words"), size)))
    # A row without a term stands for a text without words and has no vote.
    names = [f"w{i}" for i in range(size)]
    hashed = shown.select(*keys, F.when(F.col("w0").isNotNull(), F.xxhash64(*names)).alias("a")).select(*keys, "a", F.when(F.col("a").isNotNull(), F.xxhash64("a")).alias("b"))
    sums = [F.sum(F.shiftrightunsigned(side, j).bitwiseAND(F.lit(_BOTH))).alias(f"{side}{j}") for side in ("a", "b") for j in range(32)]
    counted = hashed.groupBy(*keys).agg(F.count("a").alias("n"), *sums)

    def bits(side: str) -> Column:
        total = None
        for j in range(32):
            for place, votes in ((j, F.col(f"{side}{j}").bitwiseAND(F.lit(_HALF))), (j + 32, F.shiftrightunsigned(f"{side}{j}", 32))):
                value = (1 << place) if place < 63 else -(1 << 63)
                bit = F.when(2 * votes > F.col("n"), F.lit(value)).otherwise(F.lit(0)).cast("long")
                total = bit if total is None else total.bitwiseOR(bit)
        return total

    return counted.select(*keys, bits("a").alias("fp_a"), bits("b").alias("fp_b"))


def likeness(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Cosine of the two vectors of term weights as the bits estimate it: an angle of pi times the share of bits that differ; at least 0."""
    different = F.bit_count(a1.bitwiseXOR(a2)) + F.bit_count(b1.bitwiseXOR(b2))
    return F.greatest(F.lit(0.0), F.cos(different * F.lit(math.pi / BITS)))


def shown(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _blocks(a: Column, b: Column) -> list[Column]:
    width = BITS // BLOCKS
    return [F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1)) for x in (a, b) for at in range(0, 64, width)]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_a, q_b, fp_a, fp_b, distance) for each pair of a distinct query and a distinct fingerprint at most ``radius`` bits apart.

    A pair is given by the first table that holds it, so it is met once. ``radius`` may be up to BLOCKS - 2.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"two equal blocks are certain up to {BLOCKS - 2} bits")
    tables = list(combinations(range(BLOCKS), 2))

    def filed(df: DataFrame, a: str, b: str) -> DataFrame:
        own = _blocks(F.col(a), F.col(b))
        entries = F.array(*[(F.lit(t) * F.lit(1 << 32) + F.shiftleft(own[i], 16) + own[j]) for t, (i, j) in enumerate(tables)])
        return df.select(a, b, F.explode(entries).alias(f"entry_{a}"))

    left = filed(queries.select(F.col("fp_a").alias("q_a"), F.col("fp_b").alias("q_b")).distinct(), "q_a", "q_b")
    right = filed(prints.select("fp_a", "fp_b").distinct(), "fp_a", "fp_b")
    distance = (F.bit_count(F.col("q_a").bitwiseXOR(F.col("fp_a"))) + F.bit_count(F.col("q_b").bitwiseXOR(F.col("fp_b")))).cast("int")
    equal = [x == y for x, y in zip(_blocks(F.col("q_a"), F.col("q_b")), _blocks(F.col("fp_a"), F.col("fp_b")))]
    first = F.lit(len(tables))
    for t, (i, j) in reversed(list(enumerate(tables))):
        first = F.when(equal[i] & equal[j], F.lit(t)).otherwise(first)
    table = F.shiftright("entry_q_a", 32)
    met = left.join(right, (F.col("entry_q_a") == F.col("entry_fp_a")) & (distance <= radius) & (table == first))
    return met.select("q_a", "q_b", "fp_a", "fp_b", distance.alias("distance"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(band, at, guest, doc_id, text, next_text): documents in descending order of id, each with the next one's text.

    Equal ids stand in descending order of the text; null ids stand last; after the last comes the first. The order is
    cut into bands by quantiles of the id. The first document of a band also ends the band before it, as a guest without a
    next text, so a band needs nothing from elsewhere.
    """
    frame = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = frame.count()
    bands = min(MOST_BANDS, max(1, count // ROWS_PER_BAND))
    cuts = frame.select(F.col("doc_id").cast("double").alias("v")).approxQuantile("v", [i / bands for i in range(1, bands)], 1 / (4 * bands)) if bands > 1 else []
    cut = bucket_by_cuts(frame, "doc_id", cuts, "band").withColumn("band", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("band")))
    # One row per band. The first document of a band follows the last one of the next higher band; that of the highest
    # follows the last of all.
    every = Window.orderBy("band")
    present = cut.select("band").distinct().select("band", F.coalesce(F.lead("band").over(every), F.min("band").over(every)).alias("home"))
    firsts = cut.groupBy("band").agg(F.max(F.struct("doc_id", "text")).alias("d"))
    guests = firsts.join(present, "band").select(F.col("home").alias("band"), F.lit(1).alias("guest"), "d.doc_id", "d.text")
    rows = cut.select("band", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    order = Window.partitionBy("band").orderBy(F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return rows.select("band", F.row_number().over(order).alias("at"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def document_prints(docs: DataFrame, query_of: int = 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within), one row per row of ``docs``.

    The edited text is the document with its last third (rounded down) replaced by the beginning of the next document. ``n_within`` is,
    for ids divisible by ``query_of``, the number of documents within RADIUS bits, itself included, found by the block
    tables; for other rows it is null. Null texts count as empty; an only document is its own neighbour. Other columns are ignored.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    both = neighbours(docs).withColumn("edited", F.when(F.col("guest") == 0, edited))
    own = F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("sha"))
    other = F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"), F.lit(None).cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("sha"))
    texts = both.select("band", "at", "guest", "doc_id", F.explode(F.when(F.col("guest") == 0, F.array(own, other)).otherwise(F.array(own))).alias("x")).select("band", "at", "guest", "doc_id", "x.*")
    prints = staged(fingerprints(texts, ["band", "at", "guest", "doc_id", "kind", "n_chars", "sha"], "t"))
    mine = prints.where("kind = 0").withColumns({f"next_{c}": F.lead(c).over(Window.partitionBy("band").orderBy("at")) for c in ("fp_a", "fp_b")}).where("guest = 0").drop("sha", "kind")
    changed = prints.where("kind = 1").select("band", "at", "sha", F.col("fp_a").alias("e_a"), F.col("fp_b").alias("e_b"))
    rows = mine.join(changed, ["band", "at"])
    totals = prints.where("kind = 0 and guest = 0").groupBy("fp_a", "fp_b").agg(F.count(F.lit(1)).alias("docs"))
    met = within_radius(prints.where((F.col("kind") == 0) & (F.col("guest") == 0) & (F.pmod("doc_id", F.lit(query_of)) == 0)), totals)
    near = met.join(totals, ["fp_a", "fp_b"]).groupBy(F.col("q_a").alias("fp_a"), F.col("q_b").alias("fp_b")).agg(F.sum("docs").alias("n_within"))
    found = rows.join(near, ["fp_a", "fp_b"], "left")
    a, b = F.col("fp_a"), F.col("fp_b")
    return found.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown(a, b).alias("fingerprint"), shown(F.col("e_a"), F.col("e_b")).alias("edited_fingerprint"),
        likeness(a, b, F.col("e_a"), F.col("e_b")).alias("near_edited"), likeness(a, b, F.col("next_fp_a"), F.col("next_fp_b")).alias("near_next"),
        F.when(F.pmod("doc_id", F.lit(query_of)) == 0, F.col("n_within")).alias("n_within"))
