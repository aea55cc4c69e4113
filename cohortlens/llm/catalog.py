"""The registered queries of this subpackage, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import chat, decontamination, fingerprints, html_extract, mixing, neardup, personal, phrases, quality, repeats, sharding, spelling, toxicity
from cohortlens.llm.common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


@query("op1_simhash_fingerprints")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.document_prints(read_table(spark, sf, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("op3_entropy_mixing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_decontamination", sql=r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM fold, sizes WHERE len(w) >= n)
), hits AS (SELECT s.doc_id, s.i, s.n, x.item FROM spots s JOIN windows x ON s.n = x.n AND s.win = x.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN places p ON f.doc_id = p.doc_id LEFT JOIN named m ON f.doc_id = m.doc_id
""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.find_benchmark(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.digest_of_items(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf, "documents"))


@query("op9_kd_tree_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.kd_shards(read_table(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_html_main_text")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf, "pages"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


PROBE = r"\### Assistant: </turn> ok"


@query("op8_chat_format", sql=r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>') OR contains(role, '\') OR contains(role, '#') OR contains(role, '<') OR contains(role, ':') OR contains(role, chr(10)) AS conflict FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(14 + length(role) + CASE WHEN conflict THEN length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) ELSE length(text) END) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM sized GROUP BY conv_id
""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    given = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digests(chat.format_conversations(given.unionByName(probe)))


@query("op10_repeated_substrings")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf, "documents"))


@query("op11_spelling_variants", sql=r"""
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS r FROM range(256) t(i)
), runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END))),
    lambda c, b: xor(r[xor(c & 255, b) + 1], c >> 8))) AS h
  FROM runs, remainders
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)
), best AS (
  SELECT p.word, w.n, count(*) AS n_near, first(p.near ORDER BY v.n DESC, p.near) AS near, max(v.n) AS near_n
  FROM pairs p JOIN words w ON w.word = p.word JOIN words v ON v.word = p.near GROUP BY p.word, w.n
), forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 10 * n),
ways AS (
  SELECT word, word AS root FROM words
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.root
), roots AS (SELECT word, root FROM ways WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w JOIN roots r ON r.word = w.word LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf, "documents"))


@query("op13_phrase_collocations", sql=r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m) WHERE len(w) >= m)
), counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, a AS f
  FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM candidates, range(2, 5) t(k) WHERE k < m)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.f >= 100 * w.a)
QUALIFY rank <= 2000
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf, "documents"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = personal.personal_data(read_table(spark, sf, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, personal.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
