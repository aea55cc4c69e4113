"""The distributed building blocks against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import draws
from cohortlens.operators import normalize, scale


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.where(np.arange(900) % 3 == 0, "hot", rng.choice(list("abcd"), 900)), "v": np.round(rng.normal(size=900), 2)})
    return spark.createDataFrame(pdf), pdf


def test_exact_quantiles_equal_numpy(frame):
    df, pdf = frame
    probs = {"p01": 0.01, "q1": 0.25, "med": 0.5, "p99": 0.99}
    for r in scale.exact_quantiles(df, ["k"], "v", probs, count="n").collect():
        values = pdf.v[pdf.k == r.k]
        assert r.n == len(values)
        assert [r[p] for p in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))


def test_quantile_grid_equals_numpy(frame):
    df, pdf = frame
    got = scale.exact_quantile_grid(df, ["k"], "v", 128).toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values("i")
        assert list(part.i) == list(range(129))
        assert list(part.q) == pytest.approx(list(np.quantile(pdf.v[pdf.k == k], np.arange(129) / 128)))


def test_grid_of_a_single_value(spark):
    df = spark.createDataFrame([("a", 2.0)], "k string, v double")
    assert {r.q for r in scale.exact_quantile_grid(df, ["k"], "v", 8).collect()} == {2.0}


def test_running_sums_match_pandas(frame):
    df, pdf = frame
    got = scale.quantile_positions(df, ["k"], "v").toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values("v")
        assert list(part.n_before) == list(part.n.cumsum() - part.n)
        assert set(part.n_total) == {(pdf.k == k).sum()}


def test_ordinals_are_a_permutation(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    got = draws.permuted(df, "id", 9, ["g"]).toPandas()
    for g, part in got.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))
    again = draws.permuted(df.repartition(7), "id", 9, ["g"]).toPandas()
    assert got.sort_values("id")["rank"].tolist() == again.sort_values("id")["rank"].tolist()


def test_attach_copies_nothing(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("k"), F.lit(1).alias("same"))
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = scale.attach(df, stats, ["k"])
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, joined.groupBy("k", "n").count().collect())) == [(k, 750, 750) for k in range(4)]
    left = scale.attach(df, stats.where("k = 1"), ["k"], "left")
    assert left.count() == 3000 and left.where("n IS NOT NULL").count() == 750


def test_draws_reach_beyond_32_bits(spark):
    got = [r[0] for r in spark.range(2000).select(draws.hash_index(10**12, 5, "id")).collect()]
    assert 0 <= min(got) and max(got) > 9 * 10**11
    units = [r[0] for r in spark.range(2000).select(draws.hash_unit(5, "id")).collect()]
    assert 0 <= min(units) < 0.01 and 0.99 < max(units) < 1


def test_ranking_of_huge_ties(spark):
    from cohortlens.operators import ranking

    n = 4_000_000_000
    df = spark.createDataFrame([(0.5, 1, n), (0.5, 0, n)], "score double, label int, w long")
    row = ranking.ranking(df, [], weight="w").first()
    assert row.n_pos == n and abs(row.auc - 0.5) < 1e-12 and abs(row.ap - 0.5) < 1e-12


def test_bands_follow_the_value_order(spark):
    df = scale.banded(spark.range(10000).select((F.col("id") * 1.5).alias("v")), "v")
    per = df.groupBy(scale.BAND).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("lo").collect()
    assert len(per) > 1
    assert all(a.hi < b.lo for a, b in zip(per, per[1:]))
    assert max(r.n for r in per) < 10000 / len(per) * 1.5


def test_resumed_ingestion_refuses_other_rows_of_a_stored_subject(spark, tmp_path):
    from cohortlens.streaming import incremental

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = incremental.ELEMENT_SCHEMA

    def arrive(rows):
        df = spark.createDataFrame([(s, v) for s, v in rows], "subject long, score double")
        full = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        full.coalesce(1).write.mode("append").parquet(source)
        incremental.ingest_missing(spark, source, schema, target, "subject")

    arrive([(1, 0.1), (1, 0.2), (2, 0.3)])
    arrive([(1, 0.2), (1, 0.1), (3, 0.5)])
    assert spark.read.parquet(target).count() == 4
    with pytest.raises(Exception, match="stored with other rows"):
        arrive([(2, 0.4)])


def test_arriving_files_grow_in_number_not_in_rows(spark, tmp_path, monkeypatch):
    from cohortlens.catalog import incremental

    monkeypatch.setattr(incremental, "FILE_ROWS", 100)
    path, rows = str(tmp_path / "in"), spark.range(4000).select(F.col("id").alias("subject"))
    assert incremental.arrive(rows, "subject", 4, path) == 10
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 40 and sum(sizes) == 4000 and max(sizes) < 200
    assert incremental.arrive(rows.limit(30), "subject", 2, path) == 1


def test_landmarks_are_neither_joined_nor_shuffled(spark, frame):
    plan = normalize.landmarks(frame[0].withColumn("v", F.col("v") + 10), ["k"], "v", 64)._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Aggregate" not in above and "Join" not in above
    # One row per key and band is merged where the rows lie, whatever the size of the files says.
    assert "BroadcastHashJoin" not in plan


def test_landmarks_of_a_constant_group_fail(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 3.0)], "k string, v double")
    assert normalize.landmarks(df.where("k = 'a'"), ["k"], "v", 4).count() == 5
    with pytest.raises(Exception, match="constant group"):
        normalize.landmarks(df, ["k"], "v", 4).collect()


def test_quotas_and_sizes_are_joined_without_dealing_rows_by_bucket(spark):
    """Few buckets with many rows: a join planned by guesses of size would sort a whole bucket in one task."""
    from cohortlens.operators import splits

    rows = spark.range(4000).select(F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 3).cast("int").alias("bucket"))
    quota = splits.quotas(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("w")), "bucket", "w", 9000)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    try:
        out = splits.draw_by_quota(rows, "bucket", "id", quota, 7)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") >= 2
    assert out.count() == 9000


@pytest.mark.parametrize("name", ["u5_full_row_comparison", "j12_one_to_many"])
def test_rows_are_dealt_once_in_fixed_shares(spark, name):
    """Merged partitions put millions of distinct rows in the hash table of one task."""
    from cohortlens import catalog

    catalog.load_all()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
