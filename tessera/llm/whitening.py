"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct quantised vectors form a matrix X, stored as blocks of rows in the shared folder; C is X with its means
taken away. Each step is one pass over the blocks: it takes p = C w, its inner products with all left vectors so far and
C'p. Left vectors, which are as long as the corpus, are never stored: each is C times a short vector, which the driver
keeps with the right vectors. Both sides are made orthogonal to all earlier vectors of theirs. The singular values of the
small bidiagonal matrix are the deviations, and its right singular vectors turn the right basis into the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import erase, table, written

SCALE, COMPONENTS, SEED = 256, 4, 20240613
BLOCK_ROWS = 8192
LARGEST = 2**63 - 1
BLOCK = "n_rows long, kind string, width long, matrix binary, sums array<decimal(38,0)>"
EPS = float(np.finfo(float).eps)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry, as long; null for a vector that is null or holds a null or non-finite entry. Entries beyond a long stop at its ends."""
    ok = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; components as columns, deviations squared (variances), the trace and the largest error."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fit_blocks(rows: DataFrame, width: int) -> DataFrame:
    """The distinct vectors of rows' column x, filled with zeros up to width, as BLOCK rows in the shared folder."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += list(batch["x"])
            while len(held) >= BLOCK_ROWS:
                yield _block(held[:BLOCK_ROWS], width)
                held = held[BLOCK_ROWS:]
        if held:
            yield _block(held, width)

    filled = rows.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    return written(filled.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x").mapInPandas(packed, BLOCK), "whitening-blocks")


def _block(vectors: list[np.ndarray], width: int) -> pd.DataFrame:
    matrix = np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    exact = matrix if most * len(matrix) <= LARGEST else matrix.astype(object)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    return pd.DataFrame({
        "n_rows": [len(matrix)], "kind": [kind], "width": [width], "matrix": [matrix.astype(kind).tobytes()],
        "sums": [[Decimal(int(v)) for v in exact.sum(axis=0)]],
    })


def _pass(blocks: DataFrame, mean: np.ndarray, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of work(centred rows), ``size`` numbers: a task adds up its blocks, the driver the tasks, by exact sums."""
    shipped = blocks.sparkSession.sparkContext.broadcast(mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [
            work(np.frombuffer(b.matrix, dtype=b.kind).reshape(b.n_rows, b.width) - shipped.value)
            for batch in batches for b in batch.itertuples()
        ]
        if parts:
            yield pd.DataFrame({"part": [np.sum(parts, axis=0).tobytes()]})

    found = [np.frombuffer(r["part"]) for r in blocks.select("n_rows", "kind", "width", "matrix").mapInPandas(run, "part binary").collect()]
    shipped.destroy()
    return np.array([math.fsum(p[k] for p in found) for k in range(size)])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v without its parts along the basis, taken away twice."""
    for _ in range(2 if basis else 0):
        q = np.stack(basis, axis=1)
        v = v - q @ (q.T @ v)
    return v


def bidiagonalise(blocks: DataFrame, mean: np.ndarray, energy: float, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(right basis, bidiagonal matrix, steps) with A V = U B, A the centred rows, energy its squared Frobenius norm.

    Ends when all directions are used up, or once the ``wanted`` largest values have converged and what the steps have
    not seen of the energy is less than the last of them, so that no equal value is missing.
    """
    dims, draw = len(mean), np.random.default_rng(SEED)
    rights: list[np.ndarray] = []
    lefts: list[np.ndarray] = []  # short vectors w: the left vector is A w
    backs: list[np.ndarray] = []  # A' A w
    alphas, betas = [], []
    scale, beta, fresh, passes = math.sqrt(max(energy, 0.0)), 0.0, True, 0
    v = draw.standard_normal(dims)
    v /= np.linalg.norm(v)

    def product(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """|A w|^2, its inner products with all left vectors, A' A w."""
        others = np.stack(lefts, axis=1) if lefts else np.zeros((dims, 0))
        k = others.shape[1]

        def work(rows: np.ndarray) -> np.ndarray:
            p = rows @ w
            return np.concatenate(([p @ p], (rows @ others).T @ p, rows.T @ p))

        got = _pass(blocks, mean, work, 1 + k + dims)
        return float(got[0]), got[1 : 1 + k], got[1 + k :]

    while len(rights) < dims:
        w = v - beta * lefts[-1] if rights and not fresh and lefts else v
        while True:
            passes += 1
            norm2, along, back = product(w)
            if lefts:
                w, back = w - np.stack(lefts, axis=1) @ along, back - np.stack(backs, axis=1) @ along
            alpha = math.sqrt(max(norm2 - float(along @ along), 0.0))
            if alpha <= 64 * EPS * scale or 2 * float(along @ along) <= norm2:
                break  # nothing is left, or what was taken away is small: the numbers are exact enough
        rights.append(v)
        if alpha <= 64 * EPS * scale:
            if fresh:  # a new direction leads nowhere, and so does all that is left
                rights.pop()
                break
            alphas.append(0.0)
            lefts.append(np.zeros(dims))
            backs.append(np.zeros(dims))
            rest, beta = np.zeros(dims), 0.0
        else:
            alphas.append(alpha)
            lefts.append(w / alpha)
            backs.append(back / alpha)
            rest = _orthogonal(backs[-1] - alpha * v, rights)
            beta = float(np.linalg.norm(rest))
        fresh = beta <= 64 * EPS * scale
        if fresh:
            beta = 0.0
            rest = _orthogonal(draw.standard_normal(dims), rights)
            if len(rights) < dims:
                rest /= np.linalg.norm(rest)
            v = rest
        else:
            v = _orthogonal(rest / beta, rights)
            v /= np.linalg.norm(v)
        betas.append(beta)
        small = np.diag(alphas) + np.diag(betas[:-1], 1)
        left, values, _ = np.linalg.svd(small)
        if len(values) >= wanted and beta > 0:
            unseen = energy - float((small**2).sum())
            if beta * np.abs(left[-1, :wanted]).max() <= 4 * EPS * values[0] and unseen < values[wanted - 1] ** 2 * (1 - 1e-6) - 1e-9 * energy:
                break
    k = len(rights)
    return np.stack(rights, axis=1) if k else np.zeros((dims, 0)), np.diag(alphas[:k]) + np.diag(betas[: k - 1], 1) if k else np.zeros((0, 0)), passes


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows' vectors x array<long>, each distinct vector once; None where there is none.

    Null vectors take no part. Missing entries are zeros. Components without variance are left out, so there may be fewer than asked.
    """
    rows = rows.filter("x IS NOT NULL")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    blocks = fit_blocks(rows, width)
    n = int(blocks.agg(F.sum("n_rows")).first()[0])
    totals = {r["pos"]: int(r["s"]) for r in blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}  # a row for each dimension
    sums = [totals[k] for k in range(width)]
    mean = np.array([s / n for s in sums])
    energy = float(_pass(blocks, mean, lambda c: np.array([(c * c).sum()]), 1)[0])
    basis, small, steps = bidiagonalise(blocks, mean, energy, components)
    _, values, turned = np.linalg.svd(small) if small.size else (None, np.zeros(0), np.zeros((0, 0)))
    keep = int((values > 1e-12 * max(values[:1], default=0.0)).sum()) if len(values) else 0
    keep = min(keep, components)
    directions = basis @ turned[:keep].T
    directions = directions / np.linalg.norm(directions, axis=0) if keep else directions
    variances = values[:keep] ** 2 / n
    scaled = directions / np.sqrt(variances) if keep else directions
    error = 0.0
    if keep:
        middle = _pass(blocks, mean, lambda c: (c @ scaled).sum(axis=0), keep) / n
        got = _pass(blocks, mean, lambda c: ((c @ scaled - middle).T @ (c @ scaled - middle)).ravel(), keep * keep) / n
        error = float(np.abs(got.reshape(keep, keep) - np.eye(keep)).max())
    erase(blocks)
    return Whitening(n, sums, directions, variances, energy / n, error, steps)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """For each (vec_id, x) row and component: OUT, by the model.

    deviation is the sum over dimensions of (n*x - S)^2, exact, and stops at the largest long. Null vectors give no
    rows; null ids, repeated rows and equal vectors keep their own. Entries that the model doesn't have are left out,
    missing ones are zeros. Without a model, as for an empty table, there are no rows.
    """
    schema = f"vec_id long, {OUT}"
    rows = rows.filter("x IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        width, mean, scaled = len(m.sums), m.mean, m.components / np.sqrt(m.variances)
        k = len(m.variances)
        for batch in batches:
            own, x = batch["vec_id"].astype("Int64"), np.zeros((len(batch), width), dtype=np.int64)
            for at, vector in enumerate(batch["x"]):
                x[at, : len(vector)] = vector[:width]
            far = m.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, m.sums), default=0)
            kind = np.int64 if width * far * far < LARGEST else object
            apart = m.n * x.astype(kind) - np.array(m.sums, dtype=kind)
            deviation = np.minimum((apart * apart).sum(axis=1), LARGEST).astype(np.int64) if width else np.zeros(len(batch), dtype=np.int64)
            yield pd.DataFrame({
                "vec_id": own.repeat(k).array, "component": np.tile(np.arange(1, k + 1), len(batch)), "n": m.n, "deviation": np.repeat(deviation, k),
                "whitened": ((x - mean) @ scaled).ravel(), "explained": np.tile(m.variances / m.trace if k else np.zeros(0), len(batch)), "identity_error": m.identity_error,
            })

    return rows.mapInPandas(apply, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the first four whitened components of every vector of embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("x"))
    return whiten(rows, fit(rows))
