"""The statistical control model and its retrained permutation null.

All replicates of the null are fitted together: a Newton step is one pass over the training rows, which adds up gradient and
Hessian of every replicate, and one small linear system each. The number of steps is fixed, so that SQL can take the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import draws
from cohortlens.operators import normalize, ranking
from cohortlens.operators.scale import attach, attach_scalar, parallelism, staged

#: Newton steps from zero. The penalty keeps every step finite; far fewer reach the optimum.
STEPS = 12
# Rows of one pass of matrix products.
BLOCK = 4096
# Replicate number of the model with the true labels.
OBSERVED = -1


def weighted_rows(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Train-only scaling and weight 1 / slices of the participant, per split."""
    scaled = normalize.train_standardizer(rows, features)
    counts = rows.groupBy("split", "participant").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return attach(scaled, counts, ["split", "participant"])


def fit_logistic(train: DataFrame, features: Sequence[str], replicates: Sequence[int | None] = (None,), seed: int = 0, c: float = 1.0, steps: int = STEPS) -> np.ndarray:
    """Coefficients and intercept per replicate of L2 logistic regression: the minimum of Σ w·loss + ‖β‖² / (2c).

    ``train`` has the features, ``label`` and ``weight``. A replicate with a number flips the labels of whole pairs
    (``pair_id``) by a coin hashed from seed, replicate and pair; None leaves them. A step gathers one gradient and Hessian
    per replicate, whatever the number of rows.
    """
    numbers, d = list(replicates), len(features) + 1
    coined = any(r is not None for r in numbers)
    values = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    pair = F.col("pair_id").cast("string") if coined else F.lit("")
    rows = train.select(*values, F.col("weight").cast("double").alias("w"), F.col("label").cast("int").alias("y"), pair.alias("pair"))
    if coined:
        # The coins of a pair are hashed where its rows meet, all pairs of a batch at once; small tables use every core too.
        rows = rows.repartition(parallelism(train.sparkSession), "pair").sortWithinPartitions("pair")
    heads = [f"{seed}:{r}:train|".encode() for r in numbers if r is not None]
    flipped = [i for i, r in enumerate(numbers) if r is not None]

    def coins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column(d + 1).dictionary_encode()
            bits = np.zeros((len(pairs.dictionary), len(numbers)), np.uint8)
            if coined:
                bits[:, flipped] = (draws.hash_grid(heads, [str(p).encode() for p in pairs.dictionary.to_pylist()]) & 1).T
            known = np.array([row.tobytes() for row in np.packbits(bits, axis=1)], object)
            flips = pa.array(known[pairs.indices.to_numpy()] if len(known) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:d + 1], flips], names=[*(f"x{i}" for i in range(d - 1)), "w", "y", "flips"])

    schema = ", ".join([*(f"x{i} double" for i in range(d - 1)), "w double", "y int", "flips binary"])
    held = staged(rows.mapInArrow(coins, schema))
    beta, pull = np.zeros((len(numbers), d)), np.append(np.full(d - 1, 1.0 / c), 0.0)
    for _ in range(steps):
        point = beta.copy()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, hessian = np.zeros((len(numbers), d)), np.zeros((len(numbers), d, d))
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x = np.column_stack([*(part.column(i).to_numpy() for i in range(d - 1)), np.ones(part.num_rows)])
                    w, y = part.column(d - 1).to_numpy(), part.column(d).to_numpy()
                    flips = np.unpackbits(np.frombuffer(b"".join(part.column(d + 1).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)[:, :len(numbers)]
                    p = 1 / (1 + np.exp(-(x @ point.T)))
                    gradient += (w[:, None] * (p - (y[:, None] ^ flips))).T @ x
                    hessian += np.einsum("nr,ni,nj->rij", w[:, None] * p * (1 - p), x, x, optimize=True)
            flat = np.concatenate([gradient, hessian.reshape(len(numbers), -1)], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

        found = held.mapInArrow(sums, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(len(numbers) * (d + d * d))
        flat[found["at"].to_numpy()] = found["v"].to_numpy()
        flat = flat.reshape(len(numbers), d + d * d)
        gradient, hessian = flat[:, :d] + pull * beta, flat[:, d:].reshape(-1, d, d) + np.diag(pull)
        beta = beta - np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
    return beta


def scored(rows: DataFrame, beta: np.ndarray, features: Sequence[str], keep: Sequence[str], replicates: Sequence[int] | None = None) -> DataFrame:
    """``keep`` and the probability of every row; with ``replicates``, a row per replicate and its number."""
    models = [F.struct(F.lit(int(r)).alias("replicate"), F.array(*[F.lit(float(b)) for b in row]).alias("b")) for r, row in zip(replicates or [0], beta)]
    every = rows.withColumn("_m", F.explode(F.array(*models)))
    z = F.get("_m.b", F.lit(len(features)))
    for i, f in enumerate(features):
        z = z + F.get("_m.b", F.lit(i)) * F.col(f)
    number = [] if replicates is None else [F.col("_m.replicate").alias("replicate")]
    return every.select(*number, *keep, (1 / (1 + F.exp(-z))).alias("probability"))


def held_out_scores(rows: DataFrame, features: Sequence[str], c: float = 1.0) -> DataFrame:
    """Fit on the training rows and score every row."""
    ready = staged(weighted_rows(rows, features))
    keep = [x for x in ("split", "pair_id", "participant", "record_id", "label") if x in rows.columns]
    return scored(ready, fit_logistic(ready.where("split = 'train'"), features, c=c), features, keep)


def permutation_null(rows: DataFrame, features: Sequence[str], replicates: Sequence[int], seed: int, c: float = 1.0) -> DataFrame:
    """(replicate, auc) of models refitted on pair-permuted training labels, scored on the true test labels.

    The replicates are fitted together; an empty test split gives no row.
    """
    return _test_auc(rows, features, list(replicates), seed, c)


def permutation_test(rows: DataFrame, features: Sequence[str], replicates: Sequence[int], seed: int, c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``permutation_null`` and (auc) of the model with the true labels, which is fitted, scored and ranked with the others."""
    every = staged(_test_auc(rows, features, [None, *replicates], seed, c))
    return every.where(F.col("replicate") != OBSERVED), every.where(F.col("replicate") == OBSERVED).select("auc")


def _test_auc(rows: DataFrame, features: Sequence[str], replicates: Sequence[int | None], seed: int, c: float) -> DataFrame:
    ready = staged(weighted_rows(rows, features))
    beta = fit_logistic(ready.where("split = 'train'"), features, replicates, seed, c)
    numbers = [OBSERVED if r is None else r for r in replicates]
    test = scored(ready.where("split = 'test'"), beta, features, ["pair_id", "participant", "label"], numbers)
    return ranking.ranking(ranking.aggregate_subjects(test, ["replicate"]), ["replicate"]).select("replicate", "auc")


def permutation_p_value(null: DataFrame, observed: DataFrame, planned: int) -> DataFrame:
    """p = (1 + #{|null − ½| ≥ |observed − ½|}) / (1 + n); NULL unless every planned replicate is present."""
    both = attach_scalar(null, observed.select(F.col("auc").alias("observed_auc")))
    extreme = F.count_if(F.abs(F.col("auc") - 0.5) >= F.abs(F.col("observed_auc") - 0.5) - 1e-15)
    out = both.groupBy("observed_auc").agg(
        F.countDistinct("replicate").alias("replicates"), F.avg("auc").alias("null_mean"), extreme.alias("_k"), F.count("auc").alias("_n")
    )
    complete = (F.col("replicates") == planned) & (F.col("_n") == planned)
    return out.select(
        "observed_auc", "replicates", "null_mean", F.when(complete, "complete").otherwise("incomplete").alias("status"),
        F.when(complete, (1 + F.col("_k")) / (1 + F.col("_n"))).alias("p_value"),
    )
