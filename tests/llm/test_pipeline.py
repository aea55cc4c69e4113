"""The stages one after the other on rows with every oddity, and their contracts on the given tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.llm import decontamination, mixing, quality, similar


def tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, _fp int, _score string, size int, copies string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(60, 90)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def oddities():
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(200)]
    good = [" ".join(r.choices(vocabulary, k=r.randint(10, 60))) for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in r.choices(vocabulary, k=30)) for _ in range(30)]
    rows = list(enumerate(good + bad))
    rows += [(100, good[0]), (100, good[0]), (101, good[1] + " tail"), (102, None), (103, ""), (None, good[2]), (None, None), (104, "word1 " * 40_000), (105, good[3] + " Alpha, beta gamma delta epsilon zeta eta theta iota KAPPA " + good[4])]
    return [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"s{n % 3}", None, "r", 1, "s", 2, "c") for n, (i, t) in enumerate(rows)]


def kept_of_similar(rows):
    """The first row by id of each group of texts linked by a similarity of 0.8 of their sets of five-word shingles."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((rows[i] for i in range(len(rows)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in set(group)]


def test_every_stage(spark, tmp_path):
    docs = tables(spark, tmp_path, oddities())
    sf, columns = str(tmp_path), docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    current, kept = docs, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, sf).write.parquet(f"{sf}/{number}")
        after = spark.read.parquet(f"{sf}/{number}")
        kept.append((current, after))
        current = after
    good = {r.doc_id for r in kept[0][1].collect()}
    assert {r.doc_id for r in kept[0][0].collect()} - good >= set(range(60, 90)) and len(good & set(range(60))) >= 50
    before, after = kept[1]
    stays = kept_of_similar([(r.doc_id, r.text) for r in before.collect()])
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in after.collect()) == sorted((i is None, i, t or "") for i, t in stays)
    hit = {r.doc_id for r in decontamination.find_benchmark(kept[2][0], spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert hit == {105} and {r.doc_id for r in kept[2][0].collect()} - {r.doc_id for r in kept[2][1].collect()} == {105}
    mixed = kept[3][1]
    assert all(frame.columns == columns for frame in (kept[0][1], kept[1][1], kept[2][1], mixed))
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in kept[3][0].collect()}
    assert current.count() == mixed.count()
    sizes = [0] * 16
    for r in current.collect():
        sizes[r.shard] += r.size
    assert max(sizes) - min(sizes) <= 3 * max(r.size for r in current.collect())


def test_run_is_the_stages_and_leaves_nothing_behind(spark, tmp_path):
    import os

    docs = tables(spark, tmp_path, oddities())
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = corpus_pipeline.run(spark, str(tmp_path))
    wanted = docs
    for _, stage in corpus_pipeline.STAGES:
        wanted = stage(spark, wanted, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and got.count() > 0
    made = [x for x in os.listdir(folder) if x not in before and x.startswith("pipeline-")]
    left = [spark.read.parquet(f"{folder}/{made[0]}/{k}-{name}").count() for k, (name, _) in enumerate(corpus_pipeline.STAGES)]
    assert left == [0, 0, 0, 0, got.count()]


def test_no_documents(spark, tmp_path):
    tables(spark, tmp_path, oddities()[:0])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_without_labels_nothing_is_rejected(spark, tmp_path):
    docs = tables(spark, tmp_path, oddities())
    for labels in ([(i, 1, 0) for i in range(0, 60)], [(i, i % 2, 0) for i in range(1000, 1100)], []):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert quality.keep_good(docs, frame).count() == docs.count()


def test_exact_repeats(spark):
    rows = [(1, f"words of text number {i} with some more of it", None, "s", 1, "r", 1, "s", 2, "c") for i in (0, 1)] * 7 + [(2, None, None, None, None, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _fp int, _times string, size int, copies string")
    kept = similar.keep_one_similar(docs).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.distinct().collect()))
    mixed = mixing.repeat_to_targets(docs)
    wanted = mixing.mix_sources(docs).groupBy("doc_id").agg(F.sum("taken").alias("t")).where("t > 0").collect()
    assert mixed.columns == docs.columns and [(1, 10 * mixed.count())] == [tuple(r) for r in wanted]
