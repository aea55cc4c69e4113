"""Volume filters, components, crops and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog import sqltext as S
from cohortlens.operators import adaptive, spectral, volume
from cohortlens.operators.scale import staged
from cohortlens.plans import tables as t

VOX = S.PIXELS + """, vox AS (SELECT CAST(slice_id // 8 AS BIGINT) AS subject, CAST(slice_id % 8 AS INTEGER) AS z, y, x, v AS score, channel % 2 = 0 AND v > 0 AS label FROM pixels),
dim AS (SELECT subject, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM vox GROUP BY subject)"""


def voxels(spark, d):
    """Eight consecutive slices form a volume; the last one may be shallower."""
    return t.pixels(spark, d).select(
        F.floor(F.col("slice_id") / 8).cast("long").alias("subject"), (F.col("slice_id") % 8).cast("int").alias("z"), "y", "x",
        F.col("v").alias("score"), ((F.col("channel") % 2 == 0) & (F.col("v") > 0)).alias("label"),
    )


# Reflected source coordinate of a stencil position, per axis.
def mirror(e, n):
    return f"(CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END)"


NEIGH = f"""offs AS (SELECT a - 1 AS dz, b - 1 AS dy, c - 1 AS dx FROM range(3) p(a), range(3) q(b), range(3) r(c)),
tgt AS (SELECT v.subject, v.z, v.y, v.x, {mirror('v.z + dz', 'nz')} AS sz, {mirror('v.y + dy', 'ny')} AS sy, {mirror('v.x + dx', 'nx')} AS sx FROM vox v JOIN dim USING (subject), offs),
nb AS (SELECT t.subject, t.z, t.y, t.x, s.score FROM tgt t JOIN vox s ON s.subject = t.subject AND s.z = t.sz AND s.y = t.sy AND s.x = t.sx)"""
DBL = "CAST({} AS DOUBLE)"


def as_double(df, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 9) for n in names})


@query("i1_median_filter_3d", f"WITH {VOX}, {NEIGH} SELECT subject, z, y, x, round(CAST(median(score) AS DOUBLE), 9) AS score FROM nb GROUP BY subject, z, y, x")
def median_filter_3d(spark, d):
    return as_double(volume.median_filter(voxels(spark, d), ["subject"], size=3), "score")


@query("i1_median_filter_3d_small_tiles", f"WITH {VOX}, {NEIGH} SELECT subject, z, y, x, round(CAST(median(score) AS DOUBLE), 9) AS score FROM nb GROUP BY subject, z, y, x")
def median_filter_small_tiles(spark, d):
    return as_double(volume.median_filter(voxels(spark, d), ["subject"], size=3, tile=4), "score")


@query("i1_median_filter_2d", f"""WITH {VOX}, offs AS (SELECT b - 1 AS dy, c - 1 AS dx FROM range(3) q(b), range(3) r(c)),
nb AS (SELECT t.subject, t.z, t.y, t.x, coalesce(s.score, 0) AS score FROM (SELECT * FROM vox, offs) t LEFT JOIN vox s ON s.subject = t.subject AND s.z = t.z AND s.y = t.y + dy AND s.x = t.x + dx)
SELECT subject, z, y, x, round(CAST(median(score) AS DOUBLE), 9) AS score FROM nb GROUP BY subject, z, y, x""")
def median_filter_2d(spark, d):
    return as_double(volume.median_filter(voxels(spark, d), ["subject"], size=3, mode="2d"), "score")


@query("i2_grey_dilation", f"WITH {VOX}, {NEIGH} SELECT subject, z, y, x, round(CAST(max(score) AS DOUBLE), 9) AS score FROM nb GROUP BY subject, z, y, x")
def grey_dilation(spark, d):
    return as_double(volume.grey_dilation(voxels(spark, d), ["subject"], size=3, tile=4), "score")


def in_range(values, n):
    return F.filter(values, lambda p: (p >= 0) & (p < n))


@query("j16_neighbour_join", f"WITH {VOX}, {NEIGH} SELECT subject, z, y, x, count(*) AS n, round(max(CAST(score AS DOUBLE)), 9) AS top FROM nb GROUP BY subject, z, y, x")
def neighbour_join(spark, d):
    # The stencil in its relational form: every voxel is sent to the positions whose reflected neighbourhood holds it.
    df = voxels(spark, d)
    size = df.groupBy("subject").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in volume.AXES])
    from cohortlens.operators.scale import attach

    out = attach(df, size, ["subject"])
    for a in volume.AXES:
        c, n = F.col(a), F.col(f"n{a}")
        reach = F.array(*[e - o for o in (-1, 0, 1) for e in (c, -c - 1, 2 * n - 1 - c)])
        out = out.withColumn(f"t{a}", F.explode(in_range(reach, n)))
    return out.groupBy("subject", *[F.col(f"t{a}").alias(a) for a in volume.AXES]).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("score").cast("double")), 9).alias("top"))


MASK = "mask AS (SELECT subject, z, y, x, score > 0.13::FLOAT AS mask FROM vox)"


def mask(spark, d):
    return voxels(spark, d).select("subject", "z", "y", "x", (F.col("score") > F.lit(0.13).cast("float")).alias("mask"))


@query("i3_binary_dilation", f"""WITH {VOX}, {MASK}, o1 AS (SELECT a - 1 AS dz, b - 1 AS dy, c - 1 AS dx FROM range(3) p(a), range(3) q(b), range(3) r(c) WHERE abs(a - 1) + abs(b - 1) + abs(c - 1) <= 2),
o AS (SELECT DISTINCT p.dz + q.dz AS dz, p.dy + q.dy AS dy, p.dx + q.dx AS dx FROM o1 p, o1 q),
h AS (SELECT DISTINCT subject, z + dz AS z, y + dy AS y, x + dx AS x FROM mask, o WHERE mask)
SELECT m.subject, m.z, m.y, m.x, h.subject IS NOT NULL AS mask FROM mask m LEFT JOIN h ON m.subject = h.subject AND m.z = h.z AND m.y = h.y AND m.x = h.x""")
def binary_dilation(spark, d):
    # The second step starts from in-bounds voxels only, which for a convex grid reaches the same voxels.
    return volume.binary_dilation(mask(spark, d), ["subject"], connectivity=2, iterations=2, tile=4)


COMP = f"""{MASK}, m AS (SELECT subject, z, y, x, (z * 8 + y) * 8 + x AS id FROM mask WHERE mask),
ed AS (SELECT a.subject, a.id AS a, b.id AS b FROM m a JOIN m b ON a.subject = b.subject AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1)"""
COMP_REC = f"""WITH RECURSIVE {VOX}, {COMP}, reach(subject, id, root) AS (SELECT subject, id, id FROM m UNION SELECT e.subject, e.b, r.root FROM reach r JOIN ed e ON e.subject = r.subject AND e.a = r.id WHERE r.root < e.b),
comp AS (SELECT subject, id, min(root) AS component FROM reach GROUP BY subject, id), area AS (SELECT subject, component, count(*) AS area FROM comp GROUP BY ALL)"""


@query("i4_connected_components", f"""{COMP_REC} SELECT m.subject, z, y, x, CAST(component AS BIGINT) AS component, area FROM m JOIN comp USING (subject, id) JOIN area USING (subject, component)""")
def components(spark, d):
    return volume.connected_components(mask(spark, d), ["subject"], tile=4)


@query("i5_remove_small_components", f"""{COMP_REC} SELECT k.subject, k.z, k.y, k.x, coalesce(area >= 4, false) AS mask FROM mask k LEFT JOIN m ON m.subject = k.subject AND m.z = k.z AND m.y = k.y AND m.x = k.x
LEFT JOIN comp c ON c.subject = m.subject AND c.id = m.id LEFT JOIN area a ON a.subject = c.subject AND a.component = c.component""")
def remove_small(spark, d):
    return volume.remove_small(mask(spark, d), ["subject"], 4, tile=4)


STEPS_SQL = f"""WITH RECURSIVE {VOX}, {NEIGH}, med AS (SELECT subject, z, y, x, median(score) AS score FROM nb GROUP BY subject, z, y, x),
nrm AS (SELECT subject, z, y, x, CAST(CAST(CAST(score AS DOUBLE) - CAST(lo AS DOUBLE) AS FLOAT)::DOUBLE / CAST(CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE) AS FLOAT)::DOUBLE AS FLOAT) AS score FROM med, (SELECT min(score) AS lo, max(score) AS hi FROM med)),
m0 AS (SELECT subject, z, y, x, CAST(score AS DOUBLE) > 0.75::DOUBLE AS mask FROM nrm), h AS (SELECT DISTINCT subject, z + dz AS z, y + dy AS y, x + dx AS x FROM m0, offs WHERE mask AND abs(dz) + abs(dy) + abs(dx) <= 1),
mask AS (SELECT m0.subject, m0.z, m0.y, m0.x, h.subject IS NOT NULL AS mask FROM m0 LEFT JOIN h ON m0.subject = h.subject AND m0.z = h.z AND m0.y = h.y AND m0.x = h.x),
{COMP.replace(MASK + ', ', '')}, reach(subject, id, root) AS (SELECT subject, id, id FROM m UNION SELECT e.subject, e.b, r.root FROM reach r JOIN ed e ON e.subject = r.subject AND e.a = r.id WHERE r.root < e.b),
comp AS (SELECT subject, id, min(root) AS component FROM reach GROUP BY subject, id), area AS (SELECT subject, component, count(*) AS area FROM comp GROUP BY ALL)
SELECT k.subject, k.z, k.y, k.x, coalesce(area >= 8, false) AS mask FROM mask k LEFT JOIN m ON m.subject = k.subject AND m.z = k.z AND m.y = k.y AND m.x = k.x
LEFT JOIN comp c ON c.subject = m.subject AND c.id = m.id LEFT JOIN area a ON a.subject = c.subject AND a.component = c.component"""


@query("i8_postprocess_steps", STEPS_SQL)
def postprocess_steps(spark, d):
    scored = volume.run_steps(
        voxels(spark, d).select("subject", "z", "y", "x", "score"),
        [{"name": "median", "kernel_size": 3}, {"name": "grey_dilation", "enabled": False}, {"name": "minmax", "scope": "dataset"}],
        volume.score_steps,
    )
    on = staged(scored).select("subject", "z", "y", "x", (F.col("score").cast("double") > 0.75).alias("mask"))
    return volume.run_steps(on, [{"name": "binary_dilation"}, {"name": "connected_components", "min_size": 8}], volume.mask_steps)


MINMAX = """{n} AS (SELECT subject, z, y, x, CAST(CAST(CAST(score AS DOUBLE) - CAST(min(score) OVER w AS DOUBLE) AS FLOAT)::DOUBLE / greatest(CAST(CAST(max(score) OVER w AS DOUBLE) - CAST(min(score) OVER w AS DOUBLE) AS FLOAT), 1e-8::FLOAT)::DOUBLE AS FLOAT) AS score FROM {s} WINDOW w AS (PARTITION BY subject))"""


@query("i9_two_branches", f"""WITH {VOX}, {NEIGH}, med AS (SELECT subject, z, y, x, median(score) AS score FROM nb GROUP BY subject, z, y, x), {MINMAX.format(n='raw', s='vox')}, {MINMAX.format(n='mf', s='med')}
SELECT 'raw' AS branch, subject, z, y, x, round(CAST(score AS DOUBLE), 7) AS score FROM raw UNION ALL SELECT 'mf', subject, z, y, x, round(CAST(score AS DOUBLE), 7) FROM mf""")
def two_branches(spark, d):
    out = volume.two_branches(voxels(spark, d).select("subject", "z", "y", "x", "score"), "original", 3)
    return out.withColumn("score", F.round(F.col("score").cast("double"), 7))


@query("i9_two_branches_rewrite", f"""WITH {VOX}, {MINMAX.format(n='raw', s='vox')}, {NEIGH.replace('JOIN vox s', 'JOIN raw s')}
SELECT 'raw' AS branch, subject, z, y, x, round(CAST(score AS DOUBLE), 7) AS score FROM raw UNION ALL SELECT 'mf', subject, z, y, x, round(CAST(median(score) AS DOUBLE), 7) FROM nb GROUP BY subject, z, y, x""")
def two_branches_rewrite(spark, d):
    out = volume.two_branches(voxels(spark, d).select("subject", "z", "y", "x", "score"), "rewrite",
                              raw_steps=[{"name": "normalize"}], mf_steps=[{"name": "median_filter", "kernel_size": 3}])
    return out.withColumn("score", F.round(F.col("score").cast("double"), 7))


@query("i11_bounding_box", f"""WITH {VOX} SELECT subject, min(z) AS z_min, min(y) AS y_min, min(x) AS x_min, max(z) + 1 AS z_stop, max(y) + 1 AS y_stop, max(x) + 1 AS x_stop, count(*) AS voxels,
 max(z) + 1 - min(z) AS z_extent, max(y) + 1 - min(y) AS y_extent, max(x) + 1 - min(x) AS x_extent FROM vox WHERE score > 0.25::FLOAT GROUP BY subject""")
def bounding_box(spark, d):
    return volume.bounding_box(voxels(spark, d), ["subject"], F.col("score") > F.lit(0.25).cast("float"))


BOX = """w AS (SELECT min(y) - 1 AS y0, max(y) + 1 + 1 AS y1, min(x) - 2 AS x0, max(x) + 1 + 2 AS x1 FROM vox WHERE score > 0.42::FLOAT),
l AS (SELECT *, ceil(greatest((y1 - y0) * 1.0, (x1 - x0) * 0.5) / 1.0) AS ly, ceil(greatest((y1 - y0) * 1.0, (x1 - x0) * 0.5) / 0.5) AS lx FROM w),
win AS (SELECT CAST(floor((y0 + y1) / 2 - ly / 2) AS INTEGER) AS y_start, CAST(floor((y0 + y1) / 2 - ly / 2) + ly AS INTEGER) AS y_stop, CAST(floor((x0 + x1) / 2 - lx / 2) AS INTEGER) AS x_start, CAST(floor((x0 + x1) / 2 - lx / 2) + lx AS INTEGER) AS x_stop FROM l)"""


@query("i12_square_window", f"""WITH {VOX}, {BOX} SELECT subject, count(*) AS voxels, round(avg(CAST(y BETWEEN y_start AND y_stop - 1 AND x BETWEEN x_start AND x_stop - 1 AS INTEGER)), 9) AS retained,
 any_value(y_start) AS y_start, any_value(y_stop) AS y_stop, any_value(x_start) AS x_start, any_value(x_stop) AS x_stop FROM vox, win WHERE score > 0.1::FLOAT GROUP BY subject""")
def square_window(spark, d):
    df = voxels(spark, d)
    window = staged(volume.square_window(df, F.col("score") > F.lit(0.42).cast("float"), 1.0, (1.0, 0.5)))
    kept = volume.retained_fraction(df, ["subject"], F.col("score") > F.lit(0.1).cast("float"), window)
    from cohortlens.operators.scale import attach_scalar

    return attach_scalar(kept.withColumn("retained", F.round("retained", 9)), window)


@query("i13_crop_and_pad", f"""WITH {VOX}, g AS (SELECT DISTINCT subject, z, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM vox, range(7) p(a), range(9) q(b))
SELECT g.subject, g.z, g.y, g.x, round(CAST(coalesce(v.score, 0) AS DOUBLE), 9) AS score FROM g LEFT JOIN vox v ON v.subject = g.subject AND v.z = g.z AND v.y = g.y - 2 AND v.x = g.x + 3""")
def crop_and_pad(spark, d):
    return as_double(volume.crop(voxels(spark, d), ["subject"], "score", (-2, 5), (3, 12)), "score")


@query("i13_reinsert", f"""WITH {VOX}, g AS (SELECT DISTINCT subject, z, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS x FROM vox, range(10) p(a), range(10) q(b))
SELECT g.subject, g.z, g.y, g.x, round(CAST(coalesce(v.score, 0) AS DOUBLE), 9) AS score FROM g LEFT JOIN vox v ON v.subject = g.subject AND v.z = g.z AND v.y = g.y AND v.x = g.x AND v.y BETWEEN 1 AND 5 AND v.x BETWEEN 2 AND 6""")
def reinsert(spark, d):
    cropped = volume.crop(voxels(spark, d), ["subject"], "score", (1, 6), (2, 7))
    return as_double(volume.insert(cropped, ["subject"], "score", 1, 2, 10, 10), "score")


@query("f8_coverage_slice", f"""WITH {VOX}, p AS (SELECT subject, z, count(*) FILTER (WHERE score > 0.1::FLOAT) AS n FROM vox GROUP BY ALL)
SELECT subject, z, n FROM p QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, z) = 1""")
def coverage_slice(spark, d):
    return volume.coverage_order(voxels(spark, d), ["subject"], F.col("score") > F.lit(0.1).cast("float"))


# --- spectra ----------------------------------------------------------------------------------------------------

DFT = S.PIXELS + """, fr AS (SELECT CAST(a AS INTEGER) AS ky, CAST(b AS INTEGER) AS kx FROM range(8) p(a), range(8) q(b)),
dft AS (SELECT slice_id, channel, ky, kx, sqrt(pow(sum({v} * cos(2 * pi() * (ky * y + kx * x) / 8)), 2) + pow(sum({v} * sin(2 * pi() * (ky * y + kx * x) / 8)), 2)) AS m FROM {src}, fr GROUP BY ALL),
mg AS (SELECT *, ky * 8 + kx AS pos, CAST(floor(sqrt(pow(CASE WHEN ky >= 4 THEN ky - 8 ELSE ky END, 2) + pow(CASE WHEN kx >= 4 THEN kx - 8 ELSE kx END, 2))) AS INTEGER) AS bin FROM dft)"""
PLAIN = DFT.format(v="v::DOUBLE", src="pixels")


def magnitudes(spark, d):
    return spectral.fft_magnitude(t.slices(spark, d), ["slice_id", "channel"], 8, 8)


@query("k1_fft_magnitude", f"WITH {PLAIN} SELECT slice_id, CAST(pos AS INTEGER) AS pos, round(m, 8) AS m, round(m * m, 8) AS power FROM mg")
def fft_magnitude(spark, d):
    cells = spectral.positions(magnitudes(spark, d), ["slice_id"])
    return cells.select("slice_id", "pos", F.round("m", 8).alias("m"), F.round(F.col("m") * F.col("m"), 8).alias("power"))


@query("k2_radial_bins", f"WITH {PLAIN} SELECT channel, bin, count(*) AS cells, count(DISTINCT pos) AS positions FROM mg GROUP BY channel, bin")
def radial_bins(spark, d):
    cells = spectral.positions(magnitudes(spark, d), ["channel"]).withColumn("bin", spectral.bin_of_position(8, 8))
    return cells.groupBy("channel", "bin").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("pos").alias("positions"))


@query("k3_radial_psd", f"WITH {PLAIN} SELECT slice_id, bin, round(avg(m * m), 8) AS power, round(avg(m), 8) AS amplitude FROM mg GROUP BY slice_id, bin")
def radial_psd(spark, d):
    out = spectral.radial_psd(magnitudes(spark, d), ["slice_id"], 8, 8)
    return out.select("slice_id", "bin", F.round("power", 8).alias("power"), F.round("amplitude", 8).alias("amplitude"))


@query("k3_radial_profile", f"""WITH {PLAIN} SELECT channel, bin, round(avg(m * m), 8) AS power, round(avg(m), 8) AS amplitude, count(DISTINCT pos) AS cells, count(DISTINCT slice_id) AS used, 0::BIGINT AS skipped FROM mg GROUP BY channel, bin""")
def radial_profile(spark, d):
    out = spectral.radial_profile(magnitudes(spark, d), "channel", 8, 8)
    return out.withColumns({"power": F.round("power", 8), "amplitude": F.round("amplitude", 8)})


HANN = S.PIXELS + """, bx AS (SELECT slice_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, avg(v::DOUBLE) AS fm FROM pixels WHERE abs(v::DOUBLE) > 0.2 GROUP BY slice_id),
wp AS (SELECT p.slice_id, channel, p.y, p.x, CASE WHEN p.y BETWEEN y0 AND y1 AND p.x BETWEEN x0 AND x1 THEN (v::DOUBLE - fm) * (0.5 - 0.5 * cos(2 * pi() * p.y / 7)) * (0.5 - 0.5 * cos(2 * pi() * p.x / 7)) ELSE 0 END AS v
 FROM pixels p JOIN bx USING (slice_id))"""


@query("k4_windowed_spectrum", f"""WITH {HANN}, {DFT.format(v='v', src='wp').replace(S.PIXELS + ', ', '')}, al AS (SELECT channel, count(*) AS n FROM slices GROUP BY channel)
SELECT channel, bin, round(avg(m * m), 8) AS power, round(avg(m), 8) AS amplitude, count(DISTINCT pos) AS cells, count(DISTINCT slice_id) AS used, any_value(n) - count(DISTINCT slice_id) AS skipped FROM mg JOIN al USING (channel) GROUP BY channel, bin""")
def windowed_spectrum(spark, d):
    mags = spectral.windowed_magnitude(t.slices(spark, d), ["slice_id", "channel"], 8, 8, eps=0.2)
    out = spectral.radial_profile(mags, "channel", 8, 8)
    return out.withColumns({"power": F.round("power", 8), "amplitude": F.round("amplitude", 8)})


FEATURES_SQL = S.PIXELS + """, q AS (SELECT slice_id, y, x, v::DOUBLE AS v, abs(v::DOUBLE) > 0.05 AS fg FROM pixels),
st AS (SELECT a.slice_id, b.v - a.v AS g FROM q a JOIN q b ON a.slice_id = b.slice_id AND ((a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1))),
gr AS (SELECT slice_id, avg(abs(g)) AS gm, stddev_pop(g) AS gs FROM st GROUP BY slice_id),
lp AS (SELECT a.slice_id, a.y, a.x, sum(b.v) - 4 * any_value(a.v) AS l FROM q a JOIN q b ON a.slice_id = b.slice_id AND ((a.y = b.y AND (b.x = (a.x + 1) % 8 OR b.x = (a.x + 7) % 8)) OR (a.x = b.x AND (b.y = (a.y + 1) % 8 OR b.y = (a.y + 7) % 8))) GROUP BY ALL),
sh AS (SELECT slice_id, avg(abs(l)) AS sharp FROM lp GROUP BY slice_id),
fs AS (SELECT slice_id, avg(v) AS f0, stddev_pop(v) AS f1, min(v) AS f2, max(v) AS f3, avg(CAST(fg AS INTEGER)) AS f4, coalesce(avg(v) FILTER (WHERE fg), 0) AS f5, coalesce(stddev_pop(v) FILTER (WHERE fg), 0) AS f6,
 quantile_cont(v, 0.01) AS q0, quantile_cont(v, 0.1) AS q1, quantile_cont(v, 0.25) AS q2, quantile_cont(v, 0.5) AS q3, quantile_cont(v, 0.75) AS q4, quantile_cont(v, 0.9) AS q5, quantile_cont(v, 0.99) AS q6 FROM q GROUP BY slice_id)"""
FEATURE_COLS = {"mean": "f0", "std": "f1", "min": "f2", "max": "f3", "foreground_area": "f4", "foreground_mean": "f5", "foreground_std": "f6", "gradient_mean": "gm", "gradient_std": "gs", "sharpness": "sharp",
                "q01": "q0", "q10": "q1", "q25": "q2", "q50": "q3", "q75": "q4", "q90": "q5", "q99": "q6"}


@query("k5_feature_vector", f"""WITH {FEATURES_SQL}, {PLAIN.replace(S.PIXELS + ', ', '')},
rg AS (SELECT slice_id, CAST(floor(sqrt(pow(-1 + 2 * ((ky + 4) % 8) / 7.0::DOUBLE, 2) + pow(-1 + 2 * ((kx + 4) % 8) / 7.0::DOUBLE, 2)) / sqrt(2.0::DOUBLE) * 8) AS INTEGER) AS ring, avg(ln(1 + m)) AS r FROM dft GROUP BY ALL),
rp AS (SELECT slice_id, {', '.join(f'coalesce(max(r) FILTER (WHERE ring = {i}), 0) AS r{i}' for i in range(8))} FROM rg GROUP BY slice_id)
SELECT slice_id, {', '.join(f'round({e}, 7) AS {n}' for n, e in FEATURE_COLS.items())}, {', '.join(f'round(r{i}, 7) AS radial_{i}' for i in range(8))} FROM fs JOIN gr USING (slice_id) JOIN sh USING (slice_id) JOIN rp USING (slice_id)""")
def feature_vector(spark, d):
    out = spectral.feature_vector(t.slices(spark, d), ["slice_id"], 8, 8, background=0.0, tolerance=0.05)
    return out.select("slice_id", *[F.round(F.get("features", F.lit(i)), 7).alias(n) for i, n in enumerate(spectral.FEATURE_NAMES)])


@query("k6_valid_frequencies", f"""WITH {PLAIN}, a AS (SELECT channel, CAST(pos AS INTEGER) AS pos, avg(m) AS a FROM mg GROUP BY ALL) SELECT channel, pos, round(a, 8) AS amplitude, a > max(a) OVER (PARTITION BY channel) * 0.9 AS valid FROM a""")
def valid_frequencies(spark, d):
    out = spectral.valid_frequencies(spectral.mean_map(magnitudes(spark, d), "channel"), "channel", 0.9)
    return out.select("channel", "pos", F.round("amplitude", 8).alias("amplitude"), "valid")


@query("k7_standardize", f"""WITH {S.PIXELS}, s AS (SELECT slice_id, avg(v::DOUBLE) AS m, stddev_pop(v::DOUBLE) AS s FROM pixels GROUP BY slice_id)
SELECT slice_id, y, x, round((v::DOUBLE - m) / greatest(s, 1e-8), 8) AS clamp, round((v::DOUBLE - m) / (s + 0.1), 8) AS added FROM pixels JOIN s USING (slice_id)""")
def standardize(spark, d):
    clamp = spectral.standardize_slices(t.slices(spark, d)).withColumnRenamed("standard", "c")
    both = spectral.standardize_slices(clamp, mode="add", eps=0.1)
    cells = both.select("slice_id", F.posexplode(F.arrays_zip("c", "standard")).alias("pos", "_z"))
    return cells.select("slice_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"),
                        F.round("_z.c", 8).alias("clamp"), F.round("_z.standard", 8).alias("added"))


@query("x2_step_registry", f"WITH {VOX}, {MINMAX.format(n='raw', s='vox')} SELECT subject, count(*) AS n, round(avg(CAST(score AS DOUBLE)), 8) AS mean FROM raw GROUP BY subject")
def step_registry(spark, d):
    out = volume.run_steps(voxels(spark, d), [{"name": "minmax"}, {"name": "median", "enabled": False}], volume.score_steps)
    return out.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("score").cast("double")), 8).alias("mean"))


@query("x3_threshold_registry", f"""WITH {VOX} SELECT subject, round(CAST(min(score) AS DOUBLE), 7) AS lo, round(CAST(max(score) AS DOUBLE), 7) AS hi, true AS inside FROM vox GROUP BY subject""")
def threshold_registry(spark, d):
    # Every registered method yields a threshold inside the score range of its subject.
    df = voxels(spark, d)
    out = df.groupBy("subject").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    inside = F.lit(True)
    for name in adaptive.threshold_methods.names():
        thr = adaptive.adaptive_thresholds(df, name).withColumnRenamed("thr", name)
        out = out.join(thr, "subject")
        inside = inside & F.col(name).between(F.col("lo"), F.col("hi"))
    return out.select("subject", F.round(F.col("lo").cast("double"), 7).alias("lo"), F.round(F.col("hi").cast("double"), 7).alias("hi"), inside.alias("inside"))


@query("x5_batch_kernel", "SELECT vec_id AS slice_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 8) AS energy FROM embeddings")
def batch_kernel(spark, d):
    # The batch-kernel surface: any function [n, h, w] → [n, m] runs map-side over Arrow batches.
    out = spectral.map_slices(t.slices(spark, d), "px", 8, 8, "energy", lambda x: (x * x).sum(axis=(1, 2))[:, None], ["slice_id"])
    return out.select("slice_id", F.round(F.get("energy", F.lit(0)), 8).alias("energy"))
