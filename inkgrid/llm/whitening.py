"""Whitening of embedding vectors along their leading components.

General: transcribed documents of this library carry no vectors, so the operator takes any table with an array column.

Spark drops unusable vectors, brings each different vector to the fit list once, and sums counts, means and centred
products over it. The covariance has as many rows as a vector has entries, whatever the number of vectors, and its
leading eigenvectors come from FEAST on the driver:

* *Inertia*: the signs of the pivots of ``T - s`` (T tridiagonal, similar to the covariance) count the eigenvalues above
  ``s``; bisection by these counts finds an interval around the wanted ones, with its end in a gap.
* *Contour*: a Gauss-Legendre rule on a circle through the interval's ends solves the complex shifted covariance for a block
  of vectors; the sum is (nearly) the projection onto the eigenvectors inside.
* *Rayleigh-Ritz* in the projected block gives eigenpairs; projection and extraction repeat until the residuals are at
  rounding level and as many pairs lie in the interval as the inertia says, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import free_name, kept

#: Entries are floor(SCALE * entry).
SCALE = 256
#: Larger ones would not be whole numbers in double precision.
LARGEST = 2.0**53
EPS = np.finfo(float).eps


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to symmetric ``v``, by Householder reflections."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, s: float) -> int:
    """Eigenvalues above ``s``: positive pivots of the shifted tridiagonal matrix."""
    least = EPS * EPS * max(1.0, float(np.abs(diagonal).max()))
    positive, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - s - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        positive += pivot > 0
    return positive


def kth_largest(diagonal: np.ndarray, off: np.ndarray, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue, by bisection, to a few units of rounding of the largest."""
    for _ in range(120):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if count_above(diagonal, off, middle) >= k:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def project(v: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """``block`` filtered by the contour through ``low`` and ``high``: eigenvectors inside keep a weight of about 1."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi * (points + 1) / 2
    total = np.zeros_like(block)
    one = np.eye(len(v))
    # the lower half of the circle gives the conjugates
    for angle, weight in zip(angles, weights):
        turn = radius * np.exp(1j * angle)
        total += (weight / 2) * (turn * np.linalg.solve((centre + turn) * one - v, block.astype(complex))).real
    return total


def feast(v: np.ndarray, low: float, high: float, inside: int, nodes: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """All ``inside`` eigenpairs of symmetric ``v`` with eigenvalues in (``low``, ``high``), falling."""
    dim = len(v)
    scale = float(np.abs(v).sum(axis=1).max())
    width = min(dim, 2 * inside + 4)
    source = np.random.default_rng(0)
    block = source.standard_normal((dim, width))
    for turn in range(60):
        base, _ = np.linalg.qr(project(v, block, low, high, nodes))
        values, turned = np.linalg.eigh(base.T @ v @ base)
        block = base @ turned
        found = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(found) == inside:
            pairs = block[:, found]
            if np.linalg.norm(v @ pairs - pairs * values[found], axis=0).max() <= 64 * EPS * scale:
                return values[found], pairs
        # missed or spurious pairs: go on with a wider block of new directions
        if turn % 20 == 19:
            width = min(dim, 2 * width)
            block = np.hstack([block, source.standard_normal((dim, width - block.shape[1]))])
    if len(found) != inside:
        raise ArithmeticError(f"{len(found)} eigenvalues found in an interval that holds {inside}")
    return values[found], block[:, found]


def leading_pairs(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues above rounding level (falling) and unit eigenvectors, largest entry positive."""
    dim = len(v)
    scale = float(np.abs(v).sum(axis=1).max())
    if not scale:
        return np.zeros(0), np.zeros((dim, 0))
    diagonal, off = tridiagonal(v)
    floor, top = dim * 8 * EPS * scale, scale * 1.01
    count = min(count, count_above(diagonal, off, floor))
    if not count:
        return np.zeros(0), np.zeros((dim, 0))
    # the lower end lies in the widest of the next gaps, so that equal eigenvalues are never parted
    reach = min(dim, count + 8)
    ordered = [kth_largest(diagonal, off, k, -scale, top) for k in range(1, min(dim, reach + 1) + 1)]
    ordered += [-scale * 0.01] * (reach == dim)
    gaps = [ordered[k - 1] - ordered[k] for k in range(count, reach + 1)]
    last = count + int(np.argmax(gaps))
    low = (ordered[last - 1] + ordered[last]) / 2
    values, vectors = feast(v, low, ordered[0] + (ordered[0] - low) * 0.1 + EPS * scale, count_above(diagonal, off, low))
    values, vectors = values[:count], vectors[:, :count]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(count)]
    return values, vectors * np.sign(largest)


@dataclass
class Whitening:
    """``n`` different vectors with ``sums`` of their whole-number entries; ``values`` and ``vectors`` of components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, and all entries finite and small enough to count."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def whole_entries(vector: Column) -> Column:
    """Entries as whole numbers, the same for 0.0 and -0.0."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def _stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_list()).astype(np.int64)


def _summed(fit: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the matrices that ``made`` gives for batches of vectors: within each task, then row by row over the tasks,
    in their order."""

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            part = made(_stacked(batch))
            total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pd.DataFrame({"place": np.arange(len(total)), "task": task, "cells": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        cells = np.stack(rows.sort_values("task")["cells"].to_list()).sum(axis=0)
        return pd.DataFrame({"place": rows["place"].iloc[:1], "cells": [cells]})

    parts = fit.mapInPandas(totals, "place int, task int, cells array<double>")
    summed = parts.groupBy("place").applyInPandas(added, "place int, cells array<double>").toPandas()
    return np.stack(summed.sort_values("place")["cells"].to_list())


def fit_whitening(embeddings: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """Components of the different usable vectors of column ``vector``; None if there is none.

    Repeated vectors count once: the list is shuffled by the vectors themselves after each task has dropped its own
    copies. Vectors of another length than the commonest (of equals the longest) are left out. Sums are of whole numbers
    and exact; they take decimals of 38 digits.
    """
    x = embeddings.select(F.col(vector).alias("v")).filter(usable(F.col("v"))).select(whole_entries(F.col("v")).alias("x"))
    lengths = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim = lengths["dim"]
    fit = kept(x.filter(F.size("x") == dim).distinct())

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * dim
        for batch in batches:
            rows = _stacked(batch)
            n += len(rows)
            # halves of 32 bits, so that no sum of a batch overflows
            low, high = (rows & 0xFFFFFFFF).sum(axis=0), (rows >> 32).sum(axis=0)
            total = [t + int(a) + (int(b) << 32) for t, a, b in zip(total, low, high)]
        if n:
            yield pd.DataFrame({"place": range(dim + 1), "value": [str(s) for s in (*total, n)]})

    parts = fit.mapInPandas(added, "place int, value string")
    summed = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("place").collect()
    *sums, n = (int(row["value"]) for row in summed)
    mean = np.array([s / n for s in sums])
    v = _summed(fit, lambda rows: (rows - mean).T @ (rows - mean)) / n
    v = (v + v.T) / 2
    values, vectors = leading_pairs(v, components)
    model = Whitening(n, sums, values, vectors, values / (np.trace(v) or 1.0), 0.0)
    if len(values):
        centre = _summed(fit, lambda rows: model.whitened(rows).sum(axis=0)[None, :]) / n
        unit = _summed(fit, lambda rows: (model.whitened(rows) - centre).T @ (model.whitened(rows) - centre)) / n
        model.identity_error = float(np.abs(unit - np.eye(len(values))).max())
    return model


def whiten(embeddings: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """``embeddings`` with one row for each usable vector and component, and ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Old columns of these names give way, others stay. Rows whose vector is NULL, empty, of another length than the fit
    list's, or holds an entry that is NULL, not finite or too large to count have no row; nor has any row a component
    whose eigenvalue is zero by rounding (vectors all equal, or too few of them). ``deviation`` is the exact sum over
    entries of (n * x - sum) squared, NULL where a long cannot hold it. Repeated rows stay and agree; empty tables stay
    empty.
    """
    made = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [part.split()[0] for part in made.split(", ")]
    base = embeddings.drop(*[c for c in embeddings.columns if c.lower() in names and c != vector])
    if model is None:
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<component: int, deviation: long, whitened: double>>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            rows = np.stack(batch.to_list()).astype(np.int64) if len(batch) else np.zeros((0, len(model.sums)), np.int64)
            points = model.whitened(rows)
            deviations = exact_deviations(rows, model.n, model.sums)
            yield pd.Series([
                [{"component": k + 1, "deviation": d, "whitened": w} for k, w in enumerate(row)]
                for row, d in zip(points, deviations)
            ])

    cells = free_name(base, "cells")
    whole = base.filter(usable(F.col(vector)) & (F.size(vector) == len(model.sums)))
    spread = whole.withColumn(cells, F.explode(placed(whole_entries(F.col(vector)))))
    parts = spread[cells]
    constants = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return spread.withColumns({
        "component": parts["component"], "n": F.lit(model.n).cast("long"), "deviation": parts["deviation"],
        "whitened": parts["whitened"], "explained": F.get(constants, parts["component"] - 1),
        "identity_error": F.lit(model.identity_error),
    }).drop(cells)


def exact_deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over entries of (n * x - sum) squared, exactly; None beyond a long."""
    estimate = ((rows.astype(float) * n - np.array(sums, dtype=float)) ** 2).sum(axis=1)
    if not len(rows) or (estimate.max() < 2.0**62 and np.abs(rows).max() * float(n) < 2.0**62):
        moved = rows * np.int64(n) - np.array(sums, dtype=np.int64)
        return (moved * moved).sum(axis=1).tolist()
    exact = (sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in rows)
    return [d if d < 2**63 else None for d in exact]
