"""Spectra and feature vectors of array slices (K1–K7): batched FFTs inside tasks, everything else in Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_slices(df: DataFrame, px: str, height: int, width: int, out: str, function: Callable[[np.ndarray], np.ndarray], keep: Sequence[str]) -> DataFrame:
    """Apply a batch function [n, h, w] → [n, m] to the slice arrays; ``out`` is ARRAY<DOUBLE>. Map-only, no shuffle."""
    keep = list(keep)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if flat.size != n * height * width or not np.isfinite(flat).all():
                raise ValueError("slices must be finite and have the declared shape")
            values = np.asarray(function(flat.reshape(n, height, width)), dtype=np.float64).reshape(n, -1)
            offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, out])

    return df.select(*keep, px).mapInArrow(run, schema)


def fft_magnitude(df: DataFrame, keep: Sequence[str], height: int, width: int, px: str = "px") -> DataFrame:
    """|FFT| per slice, unshifted, as ``mag``."""
    return map_slices(df, px, height, width, "mag", lambda x: np.abs(np.fft.fft2(x)), keep)


def windowed_magnitude(df: DataFrame, keep: Sequence[str], height: int, width: int, eps: float = 1e-6, margin: int = 0, px: str = "px") -> DataFrame:
    """|FFT| after cropping to the foreground box, centring by the foreground mean and a Hann window. Slices without
    foreground give a row of NaN, which ``radial_profile`` counts as skipped."""
    window = np.hanning(height)[:, None] * np.hanning(width)[None, :]

    def run(x: np.ndarray) -> np.ndarray:
        on = np.abs(x) > eps
        rows, cols = on.any(axis=2), on.any(axis=1)

        def span(flags: np.ndarray, size: int) -> np.ndarray:
            first = np.maximum(flags.argmax(axis=1) - margin, 0)[:, None]
            last = np.minimum(size - 1 - flags[:, ::-1].argmax(axis=1) + margin, size - 1)[:, None]
            at = np.arange(size)[None, :]
            return (at >= first) & (at <= last)

        box = span(rows, height)[:, :, None] & span(cols, width)[:, None, :]
        count = on.sum(axis=(1, 2))
        mean = np.where(on, x, 0.0).sum(axis=(1, 2)) / np.maximum(count, 1)
        centred = np.where(box, x - mean[:, None, None], 0.0) * window
        mag = np.abs(np.fft.fft2(centred))
        mag[count == 0] = np.nan
        return mag

    return map_slices(df, px, height, width, "mag", run, keep)


def bin_of_position(height: int, width: int, bins: int | None = None) -> Column:
    """Column: radial bin of the array position ``pos``, by arithmetic on the signed frequencies."""
    ky, kx = F.floor(F.col("pos") / width), F.col("pos") % width
    fy = F.when(ky < (height + 1) // 2, ky).otherwise(ky - height)
    fx = F.when(kx < (width + 1) // 2, kx).otherwise(kx - width)
    radius = F.sqrt((fy * fy + fx * fx).cast("double"))
    if bins is None:
        return F.floor(radius).cast("int")
    top = math.hypot(height // 2, width // 2) or 1.0
    return F.least(F.lit(bins - 1), F.floor(radius / top * bins)).cast("int")


def positions(magnitudes: DataFrame, keep: Sequence[str]) -> DataFrame:
    return magnitudes.select(*keep, F.posexplode("mag").alias("pos", "m"))


def radial_psd(magnitudes: DataFrame, keep: Sequence[str], height: int, width: int, bins: int | None = None) -> DataFrame:
    """Mean power per slice and radial bin."""
    cells = positions(magnitudes, keep).withColumn("bin", bin_of_position(height, width, bins))
    return cells.groupBy(*keep, "bin").agg(F.avg(F.col("m") * F.col("m")).alias("power"), F.avg("m").alias("amplitude"))


def radial_profile(magnitudes: DataFrame, channel: str, height: int, width: int, bins: int | None = None) -> DataFrame:
    """Mean radial power and amplitude over slices, with used and skipped counts, per channel and bin.

    Every slice has the same cells per bin, so the mean over slices of bin means is the mean over all cells: one
    aggregate with a map-side combine.
    """
    cells = positions(magnitudes, [channel]).withColumn("bin", bin_of_position(height, width, bins))
    used = ~F.isnan("m")
    return cells.groupBy(channel, "bin").agg(
        F.avg(F.when(used, F.col("m") * F.col("m"))).alias("power"),
        F.avg(F.when(used, F.col("m"))).alias("amplitude"),
        F.countDistinct("pos").alias("cells"),
        F.count_if(used).alias("_used"),
        F.count_if(~used).alias("_skipped"),
    ).select(channel, "bin", "power", "amplitude", "cells",
             (F.col("_used") / F.col("cells")).cast("long").alias("used"), (F.col("_skipped") / F.col("cells")).cast("long").alias("skipped"))


def mean_map(magnitudes: DataFrame, channel: str) -> DataFrame:
    """Mean amplitude and power per channel and frequency."""
    return positions(magnitudes, [channel]).groupBy(channel, "pos").agg(
        F.avg("m").alias("amplitude"), F.avg(F.col("m") * F.col("m")).alias("power")
    )


def valid_frequencies(means: DataFrame, channel: str, relative: float = 1e-6) -> DataFrame:
    """Frequencies whose mean magnitude exceeds the channel's maximum times ``relative`` (h·w rows per channel)."""
    top = F.max("amplitude").over(Window.partitionBy(channel))
    return means.withColumn("valid", F.col("amplitude") > top * relative)


# The quantile levels of the feature vector.
FEATURE_QUANTILES = (0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99)
FEATURE_NAMES = (
    "mean", "std", "min", "max", "foreground_area", "foreground_mean", "foreground_std", "gradient_mean", "gradient_std",
    "sharpness", "q01", "q10", "q25", "q50", "q75", "q90", "q99", *[f"radial_{i}" for i in range(8)],
)


def _ring(height: int, width: int, rings: int) -> Column:
    """Ring of the array position ``pos`` around zero frequency; the corner of the centred plane lies outside all."""
    row = (F.floor(F.col("pos") / width) + height // 2) % height
    column = (F.col("pos") % width + width // 2) % width
    y, x = row * 2.0 / max(height - 1, 1) - 1.0, column * 2.0 / max(width - 1, 1) - 1.0
    return F.floor(F.sqrt(y * y + x * x) / math.sqrt(2.0) * rings).cast("int")


def feature_vector(df: DataFrame, keep: Sequence[str], height: int, width: int, background: float = -1.0, tolerance: float = 1e-6, px: str = "px") -> DataFrame:
    """25 features per slice: intensity, foreground, edge energy, quantiles and coarse radial log-spectrum.

    Pixels are rows with their neighbours beside them, so all but the spectrum is one aggregate per slice; ``keep`` names a slice.
    """
    rows = df.select(*keep, px, F.posexplode(px).alias("pos", "_v"))
    y, x = F.floor(F.col("pos") / width), F.col("pos") % width

    def at(row: Column, column: Column) -> Column:
        return F.get(px, (row * width + column).cast("int")).cast("double")

    v = F.col("_v").cast("double")
    next_x = F.when(x + 1 < width, at(y, x + 1) - v)
    next_y = F.when(y + 1 < height, at(y + 1, x) - v)
    # The plane is closed to a torus for the Laplacian.
    bend = at(y, (x + 1) % width) + at(y, (x + width - 1) % width) + at((y + 1) % height, x) + at((y + height - 1) % height, x) - v * 4.0
    cells = rows.select(*keep, v.alias("v"), next_x.alias("gx"), next_y.alias("gy"), F.abs(bend).alias("bend"), (F.abs(v - background) > tolerance).alias("on"))
    steps = F.count("gx") + F.count("gy")
    first = (F.sum("gx") + F.sum("gy")) / steps
    on = F.when(F.col("on"), F.col("v"))
    plain = cells.groupBy(*keep).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg(F.col("on").cast("double")).alias("foreground_area"), F.coalesce(F.avg(on), F.lit(0.0)).alias("foreground_mean"), F.coalesce(F.stddev_pop(on), F.lit(0.0)).alias("foreground_std"),
        ((F.sum(F.abs("gx")) + F.sum(F.abs("gy"))) / steps).alias("gradient_mean"),
        # Deviation of both kinds of steps together from their own deviations and means.
        F.sqrt(((F.var_pop("gx") + F.pow(F.avg("gx") - first, F.lit(2.0))) * F.count("gx") + (F.var_pop("gy") + F.pow(F.avg("gy") - first, F.lit(2.0))) * F.count("gy")) / steps).alias("gradient_std"),
        F.avg("bend").alias("sharpness"), F.percentile("v", F.array(*[F.lit(q) for q in FEATURE_QUANTILES])).alias("_q"),
    )
    rings = [name for name in FEATURE_NAMES if name.startswith("radial_")]
    spectrum = positions(fft_magnitude(df, keep, height, width, px), keep).withColumn("_ring", _ring(height, width, len(rings)))
    radial = spectrum.groupBy(*keep).agg(*[F.coalesce(F.avg(F.when(F.col("_ring") == i, F.log1p("m"))), F.lit(0.0)).alias(name) for i, name in enumerate(rings)])
    ready = plain.join(radial, list(keep))
    values = [F.get("_q", F.lit(FEATURE_NAMES.index(name) - FEATURE_NAMES.index("q01"))) if name.startswith("q") else F.col(name) for name in FEATURE_NAMES]
    return ready.select(*keep, F.array(*values).alias("features"))


def standardize_slices(df: DataFrame, px: str = "px", mode: str = "clamp", eps: float = 1e-8) -> DataFrame:
    """(v − mean) / deviation inside each slice; the denominator is max(std, eps) or std + eps. JVM-side array math."""
    if mode not in ("clamp", "add"):
        raise ValueError(f"unknown denominator mode: {mode!r}")
    doubled = F.transform(px, lambda v: v.cast("double"))
    n = F.size(px)
    zero = F.lit(0.0)
    centred = df.withColumn("_d", doubled).withColumn("_m", F.aggregate("_d", zero, lambda a, v: a + v) / n)
    spread = F.sqrt(F.aggregate("_d", zero, lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / n)
    width = F.greatest(F.col("_s"), F.lit(eps)) if mode == "clamp" else F.col("_s") + eps
    ready = centred.withColumn("_s", spread)
    return ready.withColumn("standard", F.transform("_d", lambda v: (v - F.col("_m")) / width)).drop("_d", "_m", "_s")
