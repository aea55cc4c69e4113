"""Volumes, spectra, matching and streams against NumPy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import normalize, spectral, summaries, volume
from cohortlens.operators.sets import AuditError
from cohortlens.sources import writers
from cohortlens.streaming import incremental


def long_form(spark, volumes, name="score"):
    parts = []
    for s, v in volumes.items():
        z, y, x = np.meshgrid(*[np.arange(n) for n in v.shape], indexing="ij")
        parts.append(pd.DataFrame({"subject": s, "z": z.ravel().astype("int32"), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), name: v.ravel()}))
    return spark.createDataFrame(pd.concat(parts))


def dense(df, shape, subject, name="score"):
    out = np.zeros(shape, dtype=object)
    for r in df.where(F.col("subject") == subject).collect():
        out[r.z, r.y, r.x] = r[name]
    return out


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(8)
    return {"a": rng.random((6, 9, 7)).astype(np.float32), "b": rng.random((3, 5, 8)).astype(np.float32)}


@pytest.mark.parametrize("tile", [3, 32])
def test_median_filter_equals_numpy(spark, volumes, tile):
    out = volume.median_filter(long_form(spark, volumes), ["subject"], size=5, tile=tile)
    for s, v in volumes.items():
        padded = np.pad(v, 2, mode="symmetric")
        want = np.median(np.lib.stride_tricks.sliding_window_view(padded, (5, 5, 5)), axis=(-3, -2, -1))
        assert np.allclose(dense(out, v.shape, s).astype(float), want)


def test_grey_dilation_equals_numpy(spark, volumes):
    out = volume.grey_dilation(long_form(spark, volumes), ["subject"], size=3, tile=4)
    for s, v in volumes.items():
        want = np.lib.stride_tricks.sliding_window_view(np.pad(v, 1, mode="symmetric"), (3, 3, 3)).max(axis=(-3, -2, -1))
        assert np.allclose(dense(out, v.shape, s).astype(float), want)


def brute_components(mask, connectivity):
    label = np.zeros(mask.shape, dtype=int)
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= connectivity]
    for start in map(tuple, np.argwhere(mask)):
        if label[start]:
            continue
        name, todo = np.ravel_multi_index(start, mask.shape) + 1, [start]
        while todo:
            p = todo.pop()
            if label[p]:
                continue
            label[p] = name
            for o in steps:
                q = tuple(np.add(p, o))
                if all(0 <= a < n for a, n in zip(q, mask.shape)) and mask[q] and not label[q]:
                    todo.append(q)
    return label


@pytest.mark.parametrize("connectivity", [1, 3])
def test_components_cross_tiles(spark, volumes, connectivity):
    masks = {s: v > 0.6 for s, v in volumes.items()}
    masks["a"][:, 4, 3] = True
    out = volume.connected_components(long_form(spark, masks, "mask"), ["subject"], connectivity=connectivity, tile=3)
    for s, m in masks.items():
        want = brute_components(m, connectivity)
        rows = out.where(F.col("subject") == s).collect()
        assert len(rows) == m.sum()
        for r in rows:
            assert r.component == want[r.z, r.y, r.x] - 1
            assert r.area == (want == want[r.z, r.y, r.x]).sum()


def test_binary_dilation_and_small_component_removal(spark):
    m = np.zeros((3, 7, 7), dtype=bool)
    m[1, 3, 3] = True
    m[0, 0, 0:3] = True
    df = long_form(spark, {"a": m}, "mask")
    grown = volume.binary_dilation(df, ["subject"], iterations=2, tile=4)
    got = dense(grown, m.shape, "a", "mask").astype(bool)
    assert got[1, 3, 1] and got[1, 1, 3] and got[1, 1, 1] and not got[1, 1, 5]
    kept = volume.remove_small(df, ["subject"], 2, tile=4)
    assert kept.where("mask").count() == 3
    with pytest.raises(ValueError):
        volume.binary_dilation(df, ["subject"], connectivity=4)


def test_steps_are_validated(spark, volumes):
    df = long_form(spark, volumes)
    with pytest.raises(ValueError):
        volume.run_steps(df, [{"name": "sharpen"}], volume.score_steps)
    same = volume.run_steps(df, [{"name": "median", "enabled": False}], volume.score_steps)
    assert same.count() == df.count()


def slices(spark, n=40, h=8, w=6):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, h, w)).astype(np.float32)
    return x, spark.createDataFrame([(i, i % 2, x[i].ravel().tolist()) for i in range(n)], "slice_id int, channel int, px array<float>")


@pytest.mark.parametrize("bins", [None, 5])
def test_radial_profile_equals_numpy(spark, bins):
    x, df = slices(spark)
    got = spectral.radial_profile(spectral.fft_magnitude(df, ["slice_id", "channel"], 8, 6), "channel", 8, 6, bins).collect()
    fy, fx = np.fft.fftfreq(8) * 8, np.fft.fftfreq(6) * 6
    radius = np.sqrt(fy[:, None] ** 2 + fx[None, :] ** 2)
    index = np.floor(radius).astype(int) if bins is None else np.clip(np.floor(radius / radius.max() * bins).astype(int), 0, bins - 1)
    power = np.abs(np.fft.fft2(x.astype(float))) ** 2
    assert len(got) == 2 * len(np.unique(index))
    for r in got:
        assert r.power == pytest.approx(power[r.channel::2][:, index == r.bin].mean())
        assert r.used == 20 and r.skipped == 0


def test_pairwise_cosine_equals_all_pairs(spark):
    x, df = slices(spark)
    for r in summaries.pairwise_cosine(df, ["channel"], "px").collect():
        u = x[r.channel::2].reshape(20, -1).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        cos = (u @ u.T)[np.triu_indices(20, 1)]
        assert r.pairs == 190 and r.mean == pytest.approx(cos.mean()) and r.std == pytest.approx(cos.std())


def test_standardize_modes(spark):
    x, df = slices(spark)
    for mode in ("clamp", "add"):
        got = spectral.standardize_slices(df, mode=mode, eps=0.1).where("slice_id = 3").collect()[0].standard
        v = x[3].astype(float).ravel()
        sd = max(v.std(), 0.1) if mode == "clamp" else v.std() + 0.1
        assert got == pytest.approx(list((v - v.mean()) / sd), rel=1e-6)


def test_affine_target_gives_affine_map(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.gamma(2.0, 1.0, 800) + 0.01, 3)
    df = spark.createDataFrame([("c", float(a)) for a in v], "k string, v double")
    own = normalize.landmarks(df, ["k"], "v", 64)
    target = own.select("i", (2 * F.col("q") + 0.3).alias("q"))
    for r in normalize.quantile_map(df, ["k"], "v", target, intervals=64).collect():
        assert r.mapped == pytest.approx(2 * r.v + 0.3)
    zero = normalize.distribution_distance(df, [], "v", own.drop("k"), 64).collect()[0]
    assert zero.cdf_max_error < 2 / 64 + 1e-9


def test_few_values_keep_their_order_and_bad_sources_fail(spark):
    df = spark.createDataFrame([("c", float(a)) for a in [1, 2, 3, 4] * 25], "k string, v double")
    target = spark.createDataFrame([(i, 10.0 + i * i) for i in range(65)], "i int, q double")
    mapped = [r.mapped for r in normalize.quantile_map(df, ["k"], "v", target, intervals=64).orderBy("v").collect()]
    assert len(mapped) == 4 and mapped == sorted(mapped) and len(set(mapped)) == 4
    for bad in (-1.0, float("nan"), 0.0):
        with pytest.raises(Exception):
            normalize.landmarks(df.unionByName(spark.createDataFrame([("c", bad)], "k string, v double")), ["k"], "v", 8).collect()


def test_normalizers(spark):
    rng = np.random.default_rng(9)
    v = np.where(rng.random(500) < 0.3, 0.0, rng.random(500) + 0.1)
    df = spark.createDataFrame([("c", float(a)) for a in v], "k string, v double")
    fg = v[v > 0]
    got = sorted(r.o for r in normalize.robust_iqr(df, ["k"], "v", F.col("v") > 0, "o").collect())
    q1, q2, q3 = np.quantile(fg, [0.25, 0.5, 0.75])
    assert got == pytest.approx(sorted(np.where(v > 0, (v - q2) / (q3 - q1), -1.0)))
    scaled = sorted(r.o for r in normalize.p99_scale(df, ["k"], "v", "o").collect())
    assert scaled == pytest.approx(sorted(v / np.quantile(fg, 0.99)))
    flat = spark.createDataFrame([("c", 1.0)] * 9, "k string, v double")
    with pytest.raises(Exception):
        normalize.robust_iqr(flat, ["k"], "v", F.col("v") > 0, "o").collect()


def test_resume_and_guard(spark):
    source, target = writers.scratch(spark, "src"), writers.scratch(spark, "dst")
    rows = spark.createDataFrame([(i % 4, i, "F", 0.5, True) for i in range(40)], incremental.ELEMENT_SCHEMA)
    rows.where("subject < 2").write.parquet(source)
    incremental.ingest_missing(spark, source, incremental.ELEMENT_SCHEMA, target, "subject", 100)
    rows.write.mode("append").parquet(source)
    incremental.ingest_missing(spark, source, incremental.ELEMENT_SCHEMA, target, "subject", 100)
    assert {(r.subject, r["count"]) for r in spark.read.parquet(target).groupBy("subject").count().collect()} == {(i, 10) for i in range(4)}
    store = writers.scratch(spark, "guard")
    incremental.guarded_append(rows, store, "x")
    incremental.guarded_append(rows, store, "x")
    with pytest.raises(AuditError):
        incremental.guarded_append(rows, store, "y")


def test_publish_refuses_failed_audits(spark):
    path = writers.scratch(spark, "pub")

    def no(_):
        raise AuditError("no")

    with pytest.raises(AuditError):
        writers.publish(spark.range(3), path, no)
    writers.publish(spark.range(3), path, lambda df: None)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        writers.publish(spark.range(3), path, lambda df: None)
