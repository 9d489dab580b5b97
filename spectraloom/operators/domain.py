"""Applicability domain, class models with a combined distance, and a control baseline: PCA distances with limits by moments.

A distance d of mean m and variance v is taken for a scaled chi-square variable of 2 m^2 / v degrees (Pomerantsev & Rodionova, 2014).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import special
from spectraloom.operators.stats import PCA, moments, moments_by


@dataclass
class Distance:
    """Mean and degrees of freedom (1 to 100) of a squared distance."""

    mean: float
    dof: int

    @staticmethod
    def of(mean: float, variance: float) -> Distance:
        dof = 2 * mean * mean / variance if variance and variance > 0 else 1.0
        return Distance(max(mean, 1e-300), int(min(100, max(1, round(dof)))))

    def limit(self, alpha: float) -> float:
        return self.mean * special.chi2_ppf(1 - alpha, self.dof) / self.dof


@dataclass
class Domain:
    """PCA of the training rows with their distances in the model (h) and from it (q)."""

    model: PCA
    h: Distance
    q: Distance

    def limit(self, alpha: float = 0.05) -> float:
        """Of the combined distance Nh h / h0 + Nq q / q0."""
        return special.chi2_ppf(1 - alpha, self.h.dof + self.q.dof)

    def border(self, alpha: float = 0.05) -> float:
        """The limit that the largest of n training rows keeps with probability 1 - alpha."""
        return self.limit(1 - (1 - alpha) ** (1 / max(1, self.model.n)))

    def judged(self, df: DataFrame, values: str, alpha: float = 0.05) -> DataFrame:
        """Adds h, q, distance and verdict: inside, borderline (beyond the limit, within the border) or outside."""
        far = self.h.dof * F.col("h") / self.h.mean + self.q.dof * F.col("q") / self.q.mean
        out = self.model.scored(df, values).withColumnRenamed("t2", "h").withColumn("distance", far).drop("scores", "leverage")
        return out.withColumn("verdict", F.when(F.col("distance") <= self.limit(alpha), "inside").when(F.col("distance") <= self.border(alpha), "borderline").otherwise("outside"))


def components_for(m: PCA, variance: float) -> int:
    return int(np.searchsorted(np.cumsum(m.all_eigenvalues) / max(m.all_eigenvalues.sum(), 1e-300), variance - 1e-12)) + 1


def fit(df: DataFrame, values: str, variance: float = 0.95, stats: tuple | None = None, least: int = 2, most: int = 15) -> Domain:
    """Components that reach `variance`, within `least` and `most` and n - 2; one pass for moments, one for the distances' mean and variance."""
    n, mean, cov = stats or moments(df, values)
    whole = PCA.from_moments(n, mean, cov, len(mean))
    model = PCA.from_moments(n, mean, cov, max(1, least, min(components_for(whole, variance), most, n - 2, len(mean))))
    r = model.scored(df, values).agg(F.avg("t2").alias("h"), F.var_samp("t2").alias("vh"), F.avg("q").alias("q"), F.var_samp("q").alias("vq")).first()
    return Domain(model, Distance.of(r["h"], r["vh"]), Distance.of(r["q"], r["vq"]))


def acceptance_curve(domain: Domain, df: DataFrame, values: str, alphas: list[float]) -> DataFrame:
    """(alpha, share) of rows inside at each level."""
    judged = domain.judged(df, values)
    row = judged.agg(*[F.avg((F.col("distance") <= domain.limit(a)).cast("double")).alias(f"a{i}") for i, a in enumerate(alphas)]).first()
    return df.sparkSession.createDataFrame([(a, row[i]) for i, a in enumerate(alphas)], "alpha double, share double")


def class_models(df: DataFrame, values: str, label: str, variance: float = 0.9, least: int = 4) -> dict[object, Domain]:
    """A Domain for each class with at least `least` rows. Classes are few; moments of all come from one pass."""
    return {c: fit(df.where(F.col(label) == c), values, variance, stats, 1, max(1, stats[0] // 3)) for c, stats in moments_by(df, values, label).items() if stats[0] >= least}


def accepted(df: DataFrame, values: str, key: str, models: dict[object, Domain], alpha: float = 0.05, *keep: str) -> DataFrame:
    """(key, kept columns, class, distance, inside) of every row in every class model."""
    out = None
    for name, m in models.items():
        part = m.judged(df.select(key, *keep, values), values, alpha).select(key, *keep, F.lit(name).alias("class"), "distance", (F.col("verdict") == "inside").alias("inside"))
        out = part if out is None else out.unionAll(part)
    return out


def empirical_q_limit(model: PCA, df: DataFrame, values: str, alpha: float = 0.05) -> float:
    """Jackson and Mudholkar's limit where it is finite, else the (1 - alpha) quantile of the rows' q."""
    from spectraloom.operators.relational import quantiles

    found = model.q_limit(alpha)
    if np.isfinite(found):
        return found
    return quantiles(model.scored(df, values), "q", {"limit": 1 - alpha}).first()["limit"]


# ---- control baseline ---------------------------------------------------------------------


@dataclass
class Baseline:
    """PCA of a bounded set of baseline runs, with limits from their leave-one-out distances."""

    model: PCA
    t2: Distance
    q: Distance

    def judged(self, df: DataFrame, values: str, warn: float = 0.05, act: float = 0.01) -> DataFrame:
        """Adds t2, q and status of runs: ok, warning or ACTION, where either distance is beyond its limit."""
        over = lambda a: (F.col("t2") > self.t2.limit(a)) | (F.col("q") > self.q.limit(a))
        return self.model.scored(df, values).drop("scores", "leverage").withColumn("status", F.when(over(act), "ACTION").when(over(warn), "warning").otherwise("ok"))

    def residuals(self, df: DataFrame, values: str, into: str = "residual") -> DataFrame:
        """Adds what the model leaves over of each run's spectrum."""
        from spectraloom.operators.signal import map_matrix

        m, p = self.model.mean, self.model.loadings
        return map_matrix(df.withColumn(into, F.transform(values, lambda x: x.cast("double"))), into, lambda x: (x - m) - ((x - m) @ p) @ p.T)


def baseline(df: DataFrame, values: str, k: int = 3, most: int = 5_000) -> Baseline:
    """From baseline runs, `most` at most (an error beyond it: a baseline is a stated, small set)."""
    rows = df.select(values).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a baseline has {most} runs at most")
    x = np.array([r[0] for r in rows], np.float64)
    n, k = len(x), min(k, max(1, len(x) - 2))
    t2, q = np.zeros(n), np.zeros(n)
    for i in range(n):
        m = PCA.from_moments(n - 1, *_moments(np.delete(x, i, axis=0)), k)
        s = (x[i] - m.mean) @ m.loadings
        t2[i], q[i] = (s * s / np.maximum(m.eigenvalues, 1e-300)).sum(), ((x[i] - m.mean - m.loadings @ s) ** 2).sum()
    return Baseline(PCA.from_moments(n, *_moments(x), k), Distance.of(t2.mean(), t2.var()), Distance.of(q.mean(), q.var()))


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(0), np.cov(x.T)
