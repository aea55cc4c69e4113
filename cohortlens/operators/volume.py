"""Volume operators on long-form voxels (keys, z, y, x, value): filters, dilation, components, boxes, crops.

Filters work on halo tiles: a voxel is copied to the few tiles whose output it can influence, each tile is a small dense
block in one Arrow group, and only the tile's own voxels are emitted. A tile has a fixed size, so a group is bounded
whatever the size of the volume.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import scalars
from cohortlens.functions.registry import Registry
from cohortlens.operators import adaptive
from cohortlens.operators.scale import attach, staged

AXES = ("z", "y", "x")
TILE = 32


def _mirror(position: np.ndarray, size: int) -> np.ndarray:
    """Half-sample reflection: … c b a | a b c … z | z y x …"""
    folded = np.mod(position, 2 * size)
    return np.where(folded < size, folded, 2 * size - 1 - folded)


def tiled(
    df: DataFrame, keys: Sequence[str], value: str, radius: Sequence[int], kernel: Callable[[np.ndarray], np.ndarray],
    mode: str = "reflect", tile: int = TILE,
) -> DataFrame:
    """Apply a dense stencil. ``kernel`` maps a block padded by ``radius`` on each side to the block without padding.

    ``mode`` is "reflect" (half-sample) or "zero". Coordinates start at 0 and the extent of each key is its own.
    """
    keys = list(keys)
    size = {a: F.max(a) + 1 for a in AXES}
    extents = df.groupBy(*keys).agg(*[size[a].cast("int").alias(f"_n{a}") for a in AXES])
    placed = attach(df.select(*keys, *AXES, F.col(value).cast("float").alias("_v")), extents, keys)
    for axis, r in zip(AXES, radius):
        first = F.floor(F.greatest(F.col(axis) - r, F.lit(0)) / tile)
        last = F.floor(F.least(F.col(axis) + r, F.col(f"_n{axis}") - 1) / tile)
        placed = placed.withColumn(f"_t{axis}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    radii = tuple(int(r) for r in radius)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(
        [*key_fields, *[T.StructField(a, T.IntegerType()) for a in AXES], T.StructField(value, T.FloatType())]
    )
    out_names = [f.name for f in out_schema.fields]

    def run(table: pa.Table) -> pa.Table:
        data = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("z", "y", "x", "_v")}
        dims = [int(table.column(f"_n{a}")[0].as_py()) for a in AXES]
        start = [int(table.column(f"_t{a}")[0].as_py()) * tile for a in AXES]
        stop = [min(s + tile, n) for s, n in zip(start, dims)]
        low = [max(0, s - r) for s, r in zip(start, radii)]
        high = [min(n, e + r) for e, n, r in zip(stop, dims, radii)]
        block = np.zeros([h - l for l, h in zip(low, high)], dtype=np.float32)
        block[data["z"] - low[0], data["y"] - low[1], data["x"] - low[2]] = data["_v"]
        for axis in range(3):
            wanted = np.arange(start[axis] - radii[axis], stop[axis] + radii[axis])
            source = _mirror(wanted, dims[axis]) - low[axis]
            block = np.take(block, np.clip(source, 0, block.shape[axis] - 1), axis=axis)
            if mode == "zero":
                outside = (wanted < 0) | (wanted >= dims[axis])
                index = [slice(None)] * 3
                index[axis] = outside
                block[tuple(index)] = 0.0
        result = np.asarray(kernel(block), dtype=np.float32)
        zz, yy, xx = np.meshgrid(*[np.arange(s, e, dtype=np.int32) for s, e in zip(start, stop)], indexing="ij")
        n = result.size
        columns = [pa.array([table.column(k)[0].as_py()] * n, type=table.schema.field(k).type) for k in keys]
        columns += [pa.array(a.ravel()) for a in (zz, yy, xx)] + [pa.array(result.ravel())]
        return pa.Table.from_arrays(columns, names=out_names)

    return placed.groupBy(*keys, *[f"_t{a}" for a in AXES]).applyInArrow(run, out_schema)


def median_filter(df: DataFrame, keys: Sequence[str], value: str = "score", size: int = 5, mode: str = "3d", tile: int = TILE) -> DataFrame:
    """Median over size³ with reflected edges, or over size² per slice with zero padding in 2-D mode."""
    if size % 2 != 1:
        raise ValueError("the filter size must be odd")
    flat = mode.lower() == "2d"
    window = (1, size, size) if flat else (size, size, size)
    radius = tuple(w // 2 for w in window)

    def kernel(block: np.ndarray) -> np.ndarray:
        return np.median(np.lib.stride_tricks.sliding_window_view(block, window), axis=(-3, -2, -1))

    return tiled(df, keys, value, radius, kernel, "zero" if flat else "reflect", tile)


def grey_dilation(df: DataFrame, keys: Sequence[str], value: str = "score", size: int = 3, tile: int = TILE) -> DataFrame:
    """Maximum over size³ with reflected edges; separable, so one axis at a time inside the tile."""
    r = size // 2

    def kernel(block: np.ndarray) -> np.ndarray:
        for axis in range(3):
            block = np.lib.stride_tricks.sliding_window_view(block, size, axis=axis).max(axis=-1)
        return block

    return tiled(df, keys, value, (r, r, r), kernel, "reflect", tile)


def _neighbours(connectivity: int) -> list[tuple[int, int, int]]:
    """Offsets with at most ``connectivity`` non-zero components."""
    if connectivity not in (1, 2, 3):
        raise ValueError("connectivity must be 1, 2 or 3")
    span = (-1, 0, 1)
    return [
        (a, b, c) for a in span for b in span for c in span if 0 < abs(a) + abs(b) + abs(c) <= connectivity
    ]


def binary_dilation(mask: DataFrame, keys: Sequence[str], value: str = "mask", connectivity: int = 1, iterations: int = 1, tile: int = TILE) -> DataFrame:
    """Dilation of a boolean voxel column, ``iterations`` times, with a background border."""
    offsets = _neighbours(connectivity)
    r = int(iterations)

    def kernel(block: np.ndarray) -> np.ndarray:
        on = block > 0
        for _ in range(r):
            grown = on.copy()
            padded = np.pad(on, 1)
            for dz, dy, dx in offsets:
                grown |= padded[1 + dz: 1 + dz + on.shape[0], 1 + dy: 1 + dy + on.shape[1], 1 + dx: 1 + dx + on.shape[2]]
            on = grown
        return on[r: on.shape[0] - r, r: on.shape[1] - r, r: on.shape[2] - r]

    numeric = mask.withColumn(value, F.col(value).cast("float"))
    return tiled(numeric, keys, value, (r, r, r), kernel, "zero", tile).withColumn(value, F.col(value) > 0)


def _local_labels(voxels: DataFrame, keys: Sequence[str], connectivity: int, tile: int) -> DataFrame:
    """Label the components inside each tile by their smallest voxel number."""
    offsets = _neighbours(connectivity)
    tiles = [F.floor(F.col(a) / tile).cast("int").alias(f"_t{a}") for a in AXES]
    schema = T.StructType(
        [*[voxels.schema[k] for k in keys], *[T.StructField(a, T.IntegerType()) for a in AXES], T.StructField("_local", T.LongType())]
    )
    names = [f.name for f in schema.fields]

    def run(table: pa.Table) -> pa.Table:
        points = np.stack([table.column(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in AXES], axis=1)
        ids = table.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
        corner = points.min(axis=0)
        shape = points.max(axis=0) - corner + 3
        far = np.iinfo(np.int64).max
        label = np.full(shape, far)
        at = tuple((points - corner + 1).T)
        label[at] = ids
        on = label != far
        while True:
            best = label.copy()
            for dz, dy, dx in offsets:
                best = np.minimum(best, np.roll(label, (dz, dy, dx), axis=(0, 1, 2)))
            best = np.where(on, best, far)
            if np.array_equal(best, label):
                break
            label = best
        columns = [table.column(k).combine_chunks() for k in keys]
        columns += [pa.array(points[:, i].astype(np.int32)) for i in range(3)] + [pa.array(label[at])]
        return pa.Table.from_arrays(columns, names=names)

    return voxels.select("*", *tiles).groupBy(*keys, *[f"_t{a}" for a in AXES]).applyInArrow(run, schema)


def _merge_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest label reachable from each label over undirected edges (keys, a, b), as (keys, a, root).

    Alternates neighbour minimum and pointer jumping on the contracted graph; every round is written to the shared
    folder, and the loop stops when a round changes nothing.
    """
    both = staged(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = staged(both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(roots.withColumnRenamed("a", "b").withColumnRenamed("root", "_rb"), [*keys, "b"])
        best = seen.groupBy(*keys, "a").agg(F.min("_rb").alias("_m"))
        stepped = roots.join(best, [*keys, "a"]).select(*keys, "a", F.least("root", "_m").alias("root"), F.col("root").alias("_old"))
        jump = stepped.select(*keys, F.col("a").alias("root"), F.col("root").alias("_j"))
        jumped = staged(
            stepped.join(jump, [*keys, "root"], "left").select(*keys, "a", F.least("root", F.coalesce("_j", "root")).alias("root"), "_old")
        )
        roots = jumped.select(*keys, "a", "root")
        if jumped.where("root <> _old").isEmpty():
            return roots


def connected_components(mask: DataFrame, keys: Sequence[str], value: str = "mask", connectivity: int = 1, tile: int = TILE) -> DataFrame:
    """(keys, z, y, x, component, area) of the true voxels; a component is named by its smallest voxel number.

    Components are found inside tiles first; only pairs of labels that touch across a tile border enter the distributed
    merge, so the iterated graph is far smaller than the volume.
    """
    keys = list(keys)
    extents = mask.groupBy(*keys).agg((F.max("y") + 1).cast("long").alias("_ny"), (F.max("x") + 1).cast("long").alias("_nx"))
    on = attach(mask.where(F.col(value)).select(*keys, *AXES), extents, keys)
    number = (F.col("z") * F.col("_ny") + F.col("y")) * F.col("_nx") + F.col("x")
    local = staged(_local_labels(on.select(*keys, *AXES, number.cast("long").alias("_id")), keys, connectivity, tile))
    # Voxels on a tile face look one step ahead; each undirected contact is seen once from either side.
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for v, a in zip(o, AXES)]) for o in _neighbours(connectivity)])
    face = None
    for a in AXES:
        edge = (F.col(a) % tile == tile - 1) | (F.col(a) % tile == 0)
        face = edge if face is None else face | edge
    ahead = local.where(face).select(*keys, *AXES, F.col("_local").alias("a"), F.explode(steps).alias("_d"))
    crosses = None
    for a in AXES:
        other = F.floor((F.col(a) + F.col(f"_d.d{a}")) / tile) != F.floor(F.col(a) / tile)
        crosses = other if crosses is None else crosses | other
    moved = ahead.where(crosses).select(*keys, "a", *[(F.col(a) + F.col(f"_d.d{a}")).alias(a) for a in AXES])
    touching = moved.join(local.withColumnRenamed("_local", "b"), [*keys, *AXES]).select(*keys, "a", "b")
    roots = _merge_labels(touching.where("a <> b"), keys)
    named = local.join(roots.withColumnRenamed("a", "_local"), [*keys, "_local"], "left").select(
        *keys, *AXES, F.coalesce("root", "_local").alias("component")
    )
    areas = named.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("area"))
    return attach(named, areas, [*keys, "component"])


def remove_small(mask: DataFrame, keys: Sequence[str], min_size: int, value: str = "mask", connectivity: int = 1, tile: int = TILE) -> DataFrame:
    """Clear the voxels of components smaller than ``min_size``."""
    big = connected_components(mask, keys, value, connectivity, tile).where(F.col("area") >= min_size)
    kept = big.select(*keys, *AXES, F.lit(True).alias("_k"))
    return mask.join(kept, [*keys, *AXES], "left").withColumn(value, F.coalesce("_k", F.lit(False))).drop("_k")


# --- step registries and branch policies ------------------------------------------------------------------------

score_steps: Registry[Callable[..., DataFrame]] = Registry("score step")
mask_steps: Registry[Callable[..., DataFrame]] = Registry("mask step")


@score_steps.register("normalize", "minmax", "normalize_minmax")
def _normalize_step(df: DataFrame, keys: Sequence[str], scope: str = "subject", eps: float = 1e-8) -> DataFrame:
    return adaptive.normalize_minmax(df, scope, keys, eps)


@score_steps.register("median_filter", "median")
def _median_step(df: DataFrame, keys: Sequence[str], kernel_size: int = 5, mode: str = "3d") -> DataFrame:
    return _keep_columns(df, median_filter(df, keys, "score", kernel_size, mode), keys, "score")


@score_steps.register("gray_dilation", "grey_dilation")
def _grey_step(df: DataFrame, keys: Sequence[str], kernel_size: int = 3) -> DataFrame:
    return _keep_columns(df, grey_dilation(df, keys, "score", kernel_size), keys, "score")


@mask_steps.register("binary_dilation", "dilation")
def _dilation_step(df: DataFrame, keys: Sequence[str], connectivity: int = 1, iterations: int = 1) -> DataFrame:
    return _keep_columns(df, binary_dilation(df, keys, "mask", connectivity, iterations), keys, "mask")


@mask_steps.register("connected_components", "remove_small_components")
def _component_step(df: DataFrame, keys: Sequence[str], min_size: int = 1, connectivity: int = 1) -> DataFrame:
    return remove_small(df, keys, min_size, "mask", connectivity)


def _keep_columns(df: DataFrame, filtered: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Put a filtered column back beside the other columns of the voxel."""
    others = [c for c in df.columns if c not in (*keys, *AXES, value)]
    if not others:
        return filtered
    return df.drop(value).join(filtered, [*keys, *AXES])


def run_steps(df: DataFrame, steps: Sequence[dict], registry: Registry, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Fold a validated, ordered list of ``{"name": …, "enabled": …, **parameters}`` over the voxels."""
    prepared = []
    for step in steps:
        options = dict(step)
        function = registry[options.pop("name")]
        if options.pop("enabled", True):
            prepared.append((function, options))
    for function, options in prepared:
        df = function(df, keys, **options)
    return df


def two_branches(df: DataFrame, policy: str = "original", size: int = 3, keys: Sequence[str] = ("subject",),
                 raw_steps: Sequence[dict] = (), mf_steps: Sequence[dict] = ()) -> DataFrame:
    """Voxels with ``branch`` raw and mf. "original" filters the unnormalized map and normalizes both branches on their
    own; "rewrite" runs the raw steps and feeds their output to the mf steps."""
    clean = df.withColumn("score", scalars.sanitize("score"))
    if policy == "original":
        raw = adaptive.normalize_minmax(clean, "subject", keys)
        mf = adaptive.normalize_minmax(_median_step(clean, keys, size), "subject", keys)
    elif policy == "rewrite":
        raw = run_steps(clean, raw_steps, score_steps, keys)
        mf = run_steps(raw.withColumn("score", scalars.sanitize("score")), mf_steps, score_steps, keys)
    else:
        raise ValueError(f"unknown policy: {policy!r}")
    return raw.withColumn("branch", F.lit("raw")).unionByName(mf.withColumn("branch", F.lit("mf")))


# --- boxes and crops --------------------------------------------------------------------------------------------


def bounding_box(df: DataFrame, keys: Sequence[str], inside) -> DataFrame:
    """Half-open foreground box and extents per key."""
    box = df.where(inside).groupBy(*keys).agg(
        *[F.min(a).alias(f"{a}_min") for a in AXES], *[(F.max(a) + 1).alias(f"{a}_stop") for a in AXES],
        F.count(F.lit(1)).alias("voxels"),
    )
    return box.withColumns({f"{a}_extent": F.col(f"{a}_stop") - F.col(f"{a}_min") for a in AXES})


def square_window(mask: DataFrame, inside, margin: float, spacing: tuple[float, float]) -> DataFrame:
    """One-row square window in (y, x) around the reference mask plus a physical margin; it may pass the border."""
    sy, sx = spacing
    my, mx = F.ceil(F.lit(margin / sy)), F.ceil(F.lit(margin / sx))
    box = mask.where(inside).agg(
        (F.min("y") - my).alias("y0"), (F.max("y") + 1 + my).alias("y1"),
        (F.min("x") - mx).alias("x0"), (F.max("x") + 1 + mx).alias("x1"),
    )
    side = F.greatest((F.col("y1") - F.col("y0")) * sy, (F.col("x1") - F.col("x0")) * sx)
    sized = box.withColumns({"_ly": F.ceil(side / sy), "_lx": F.ceil(side / sx)})

    def start(lo: str, hi: str, length: str):
        return F.floor((F.col(lo) + F.col(hi)) / 2 - F.col(length) / 2).cast("int")

    starts = sized.withColumns({"_ys": start("y0", "y1", "_ly"), "_xs": start("x0", "x1", "_lx")})
    return starts.select(
        F.col("_ys").alias("y_start"), (F.col("_ys") + F.col("_ly")).cast("int").alias("y_stop"),
        F.col("_xs").alias("x_start"), (F.col("_xs") + F.col("_lx")).cast("int").alias("x_stop"),
    )


def retained_fraction(df: DataFrame, keys: Sequence[str], inside, window: DataFrame) -> DataFrame:
    """Share of each key's mask that the window keeps."""
    from cohortlens.operators.scale import attach_scalar

    ready = attach_scalar(df.where(inside), window)
    kept = F.col("y").between(F.col("y_start"), F.col("y_stop") - 1) & F.col("x").between(F.col("x_start"), F.col("x_stop") - 1)
    return ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("voxels"), F.avg(kept.cast("int")).alias("retained"))


def crop(df: DataFrame, keys: Sequence[str], value: str, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Crop every slice to a window that may reach outside; positions without a source become 0.

    Real voxels are shifted; only the missing positions of each slice are generated, from the slice's own row.
    """
    (y0, y1), (x0, x1) = y, x
    inside = df.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    moved = inside.select(*keys, "z", (F.col("y") - y0).cast("int").alias("y"), (F.col("x") - x0).cast("int").alias("x"), value)
    slices = df.groupBy(*keys, "z").agg(F.max("y").alias("_hy"), F.max("x").alias("_hx"))
    grid = slices.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(y1 - y0 - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(x1 - x0 - 1)))
    )
    sy, sx = F.col("y") + y0, F.col("x") + x0
    missing = grid.where(~(sy.between(0, F.col("_hy")) & sx.between(0, F.col("_hx"))))
    return moved.unionByName(missing.select(*keys, "z", "y", "x", F.lit(0.0).cast(df.schema[value].dataType).alias(value)))


def insert(cropped: DataFrame, keys: Sequence[str], value: str, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """Put a crop back at its place in a larger grid, zero elsewhere; parts outside the grid are dropped."""
    back = cropped.select(*keys, "z", (F.col("y") + y0).cast("int").alias("y"), (F.col("x") + x0).cast("int").alias("x"), value)
    placed = back.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    slices = cropped.select(*keys, "z").distinct()
    grid = slices.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    zero = F.lit(0.0).cast(cropped.schema[value].dataType)
    return grid.join(placed, [*keys, "z", "y", "x"], "left").withColumn(value, F.coalesce(value, zero))


def coverage_order(df: DataFrame, keys: Sequence[str], inside) -> DataFrame:
    """The slice with the most foreground per key; ties take the lower z. One row per slice enters the window."""
    per = df.groupBy(*keys, "z").agg(F.count_if(inside).alias("n"))
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), "z")
    return per.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
