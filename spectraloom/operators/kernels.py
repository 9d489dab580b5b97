"""Support vector machines with a Gaussian kernel, by random Fourier features (Rahimi & Recht, 2007).

The features turn the kernel machine into a linear one with D weights, whatever the number of rows. Its objective,
|w|^2 / 2 + C * sum of losses, is minimised by L-BFGS on the driver over weights alone; each evaluation
is one pass in which every task sums the loss and gradient of its rows. Losses have a short quadratic corner (Chapelle, 2007).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.signal import map_matrix
from spectraloom.operators.stats import moments

#: Fourier features, and the width of a loss's quadratic corner.
FEATURES, CORNER = 512, 0.1


@dataclass(frozen=True)
class Fourier:
    """z(x) with z(x) . z(y) near exp(-gamma |x - y|^2); the last entry is 1, for the intercept."""

    frequency: np.ndarray
    phase: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.frequency + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])


def fourier(p: int, gamma: float, features: int = FEATURES, seed: int = 0) -> Fourier:
    rng = np.random.default_rng(seed)
    return Fourier(rng.normal(0, np.sqrt(2 * gamma), (p, features)), rng.uniform(0, 2 * np.pi, features))


def scale_gamma(df: DataFrame, values: str) -> float:
    """1 / (variables * variance of all entries); 1 / variables if that is 0."""
    n, mean, cov = moments(df, values)
    spread = np.diag(cov).mean() * (n - 1) / n + mean.var()
    return 1 / (len(mean) * spread) if spread > 0 else 1 / len(mean)


@dataclass(frozen=True)
class Machine:
    """Scores of one output a class, or of one number, by weights on Fourier features."""

    features: Fourier
    weights: np.ndarray
    mean: float = 0.0

    def scores(self, df: DataFrame, values: str, into: str = "yhat") -> DataFrame:
        return map_matrix(df.withColumn(into, arrays.doubles(F.col(values))), into, lambda x: self.features.of(x) @ self.weights + self.mean)


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 60, tolerance: float = 1e-3, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ends when the gradient has fallen to `tolerance` of its first length."""
    w, (f, g) = start, value(start)
    first, pairs = np.linalg.norm(g), []
    for _ in range(rounds):
        if np.linalg.norm(g) <= tolerance * first:
            break
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            kept.append(a)
        q *= (pairs[-1][0] * pairs[-1][1]).sum() / (pairs[-1][1] ** 2).sum() if pairs else 1 / max(1.0, first)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        step, slope = 1.0, (g * q).sum()
        while True:
            new, (fn, gn) = w - step * q, value(w - step * q)
            if fn <= f - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if ((new - w) * (gn - g)).sum() > 1e-12:
            pairs = [*pairs, (new - w, gn - g)][-memory:]
        w, f, g = new, fn, gn
    return w


def _corner(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(0, u) with a quadratic corner, and its slope."""
    return np.where(u <= 0, 0.0, np.where(u < CORNER, u * u / (2 * CORNER), u - CORNER / 2)), np.clip(u / CORNER, 0.0, 1.0)


def hinge(scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and slope of each class against the others; y holds class numbers."""
    sign = np.where(y[:, None] == np.arange(scores.shape[1]), 1.0, -1.0)
    loss, slope = _corner(1 - sign * scores)
    return float(loss.sum()), -sign * slope


def insensitive(epsilon: float) -> Callable:
    """Loss of errors beyond epsilon."""

    def loss(scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        error = scores - y[:, None]
        value, slope = _corner(np.abs(error) - epsilon)
        return float(value.sum()), np.sign(error) * slope

    return loss


def _fit(rows: DataFrame, features: Fourier, outputs: int, loss: Callable, c: float, rounds: int) -> np.ndarray:
    """Weights for rows (v, t)."""
    spark = rows.sparkSession
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    shape = (len(features.phase) + 1, outputs)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((features, w))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z_of, weights = shared.value
            total, grad = 0.0, np.zeros(shape)
            for b in batches:
                if len(b):
                    z = z_of.of(np.stack([np.asarray(v, np.float64) for v in b["v"]]))
                    lost, slope = loss(z @ weights, b["t"].to_numpy())
                    total, grad = total + lost, grad + z.T @ slope
            yield pd.DataFrame({"s": [np.append(grad.ravel(), total).tolist()]})

        s = held.mapInPandas(part, "s array<double>").agg(Summarizer.sum(array_to_vector("s"))).first()[0].toArray()
        shared.unpersist()
        penalty = w.copy()
        penalty[-1] = 0  # the intercept is free
        return float((penalty**2).sum() / 2 + c * s[-1]), penalty + c * s[:-1].reshape(shape)

    try:
        return minimise(value, np.zeros(shape), rounds)
    finally:
        held.unpersist()


def svc(df: DataFrame, values: str, label: str, c: float = 1.0, gamma: float | None = None, features: int = FEATURES, rounds: int = 60, seed: int = 0) -> tuple[list, Machine]:
    """Classes (each against the others) and their machine, for models.classify(); rows without a class or values are left out."""
    rows = df.where(F.col(label).isNotNull() & F.col(values).isNotNull())
    names = sorted(r[0] for r in rows.select(label).distinct().collect())
    p = len(rows.first()[values])
    z = fourier(p, gamma or scale_gamma(rows, values), features, seed)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)) - 1
    return names, Machine(z, _fit(rows.select(arrays.doubles(F.col(values)).alias("v"), number.alias("t")), z, len(names), hinge, c, rounds))


def svr(df: DataFrame, values: str, target: str, c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, features: int = FEATURES, rounds: int = 60, seed: int = 0) -> Machine:
    """A machine for a number; rows without one or without values are left out."""
    rows = df.where(F.col(target).isNotNull() & F.col(values).isNotNull())
    first = rows.agg(F.avg(target)).first()[0]
    z = fourier(len(rows.first()[values]), gamma or scale_gamma(rows, values), features, seed)
    return Machine(z, _fit(rows.select(arrays.doubles(F.col(values)).alias("v"), (F.col(target) - F.lit(first)).cast("double").alias("t")), z, 1, insensitive(epsilon), c, rounds), first)
