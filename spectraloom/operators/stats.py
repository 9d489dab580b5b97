"""Multivariate statistics. Moments are distributed aggregates; the driver sees p x p matrices at most."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import special


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """n, missing, mean, sd, min, median, max and CV % of x by variable."""
    sd, m = F.stddev_samp("x"), F.avg("x")
    return rows.groupBy(*keys).agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), m.alias("mean"), sd.alias("sd"), F.min("x").alias("min"), F.median("x").alias("median"), F.max("x").alias("max"), (100 * sd / F.nullif(F.abs(m), F.lit(0.0))).alias("cv"))


def average_rank(value: Column, *keys: str) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2


def moments(df: DataFrame, values: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (divided by n - 1) of an array column, summed up per task in NumPy."""

    def part(batches):
        import pandas as pd

        n, s, q = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack([np.asarray(v, np.float64) for v in b[values]])
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [np.asarray(s).tolist()], "q": [np.asarray(q).ravel().tolist()]})

    parts = df.select(values).where(F.col(values).isNotNull()).mapInPandas(part, "n long, s array<double>, q array<double>")
    add = lambda c: Summarizer.sum(array_to_vector(F.col(c))).alias(c)
    got = parts.agg(F.sum("n").alias("n"), add("s"), add("q")).first()
    n, s = got["n"], got["s"].toArray()
    mean = s / n
    return n, mean, (got["q"].toArray().reshape(len(s), len(s)) - n * np.outer(mean, mean)) / max(1, n - 1)


def moments_by(df: DataFrame, values: str, label: str) -> dict:
    """moments() of each class, in order of the labels, by one pass; rows without a label go."""

    def part(batches):
        import pandas as pd

        sums: dict = {}
        for b in batches:
            for g, rows in b.groupby("g"):
                x = np.stack([np.asarray(v, np.float64) for v in rows["v"]])
                n, s, q = sums.get(g, (0, 0.0, 0.0))
                sums[g] = (n + len(x), s + x.sum(0), q + x.T @ x)
        if sums:
            yield pd.DataFrame({"g": list(sums), "n": [t[0] for t in sums.values()], "s": [t[1].tolist() for t in sums.values()], "q": [t[2].ravel().tolist() for t in sums.values()]})

    kind = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(label).alias("g"), F.col(values).alias("v")).where(F.col("g").isNotNull() & F.col("v").isNotNull())
    add = lambda c: Summarizer.sum(array_to_vector(F.col(c))).alias(c)
    out = {}
    for r in rows.mapInPandas(part, f"g {kind}, n long, s array<double>, q array<double>").groupBy("g").agg(F.sum("n").alias("n"), add("s"), add("q")).orderBy("g").collect():
        mean = r["s"].toArray() / r["n"]
        out[r["g"]] = (r["n"], mean, (r["q"].toArray().reshape(len(mean), -1) - r["n"] * np.outer(mean, mean)) / max(1, r["n"] - 1))
    return out


def summed(df: DataFrame, values: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of a vector that `part` makes of a batch's rows x variables matrix."""

    def run(batches):
        import pandas as pd

        total = 0.0
        for b in batches:
            if len(b):
                total = total + part(np.stack([np.asarray(v, np.float64) for v in b[values]]))
        if np.ndim(total):
            yield pd.DataFrame({"s": [total.tolist()]})

    parts = df.select(values).where(F.col(values).isNotNull()).mapInPandas(run, "s array<double>")
    return parts.agg(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()


@dataclass
class PCA:
    """Loadings (p x k, largest entry of each positive), eigenvalues of the k and of all components."""

    n: int
    mean: np.ndarray
    loadings: np.ndarray
    eigenvalues: np.ndarray
    all_eigenvalues: np.ndarray

    @staticmethod
    def from_moments(n: int, mean: np.ndarray, cov: np.ndarray, k: int) -> PCA:
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        top = vectors[:, :k]
        top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
        return PCA(n, mean, top, values[:k], values)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.all_eigenvalues.sum()

    def t2_limit(self, alpha: float = 0.05) -> float:
        k = len(self.eigenvalues)
        return k * (self.n - 1) / (self.n - k) * special.f_ppf(1 - alpha, k, self.n - k)

    def q_limit(self, alpha: float = 0.05) -> float:
        """Jackson & Mudholkar (1979); infinite where nothing is left over."""
        rest = self.all_eigenvalues[len(self.eigenvalues) :]
        t1, t2, t3 = ((rest**i).sum() for i in (1, 2, 3))
        if t1 < 1e-8:
            return math.inf
        h = 1 - 2 * t1 * t3 / (3 * t2 * t2)
        z = special.normal_ppf(1 - alpha)
        return float(t1 * (z * math.sqrt(2 * t2 * h * h) / t1 + 1 + t2 * h * (h - 1) / (t1 * t1)) ** (1 / h))

    def scored(self, df: DataFrame, values: str) -> DataFrame:
        """Adds scores (array), t2 (Hotelling), q (squared residual) and leverage."""
        mean, loadings, eigen, n = self.mean, self.loadings, self.eigenvalues, self.n

        def run(batches):
            for b in batches:
                if len(b):
                    x = np.stack([np.asarray(v, np.float64) for v in b[values]]) - mean
                    t = x @ loadings
                    t2 = (t * t / np.where(eigen > 0, eigen, np.inf)).sum(1)
                    b = b.assign(scores=list(t), t2=t2, q=((x - t @ loadings.T) ** 2).sum(1), leverage=1 / n + t2 / (n - 1))
                    yield b

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.where(F.col(values).isNotNull()).mapInPandas(run, f"{fields}, scores array<double>, t2 double, q double, leverage double")


def pca(df: DataFrame, values: str, k: int) -> PCA:
    return PCA.from_moments(*moments(df, values), k)


def correlation_radius(n: int, mean: np.ndarray, cov: np.ndarray, first: int = 0, second: int = 1) -> np.ndarray:
    """By variable the length of its correlations with the scores of two components; 0 for a constant variable."""
    model, sd = PCA.from_moments(n, mean, cov, max(first, second) + 1), np.sqrt(np.diag(cov))
    r = model.loadings[:, [first, second]] * np.sqrt(model.eigenvalues[[first, second]]) / np.where(sd > 0, sd, 1)[:, None]
    return np.where(sd > 0, np.hypot(r[:, 0], r[:, 1]), 0.0)


def simca(df: DataFrame, values: str, label: str, variance: float = 0.9) -> dict[str, PCA]:
    """A PCA for each class with at least four rows, with the components that reach `variance`, a third of n at most."""
    out = {}
    for name, (n, mean, cov) in moments_by(df, values, label).items():
        if n < 4:
            continue
        whole = PCA.from_moments(n, mean, cov, len(mean))
        k = int(np.searchsorted(np.cumsum(whole.all_eigenvalues) / max(whole.all_eigenvalues.sum(), 1e-300), variance)) + 1
        out[name] = PCA.from_moments(n, mean, cov, max(1, min(k, n // 3)))
    return out


def simca_assign(df: DataFrame, values: str, key: str, models: dict[str, PCA], alpha: float = 0.05, limits: dict | None = None) -> DataFrame:
    """(key, class, t2, q, inside) of every sample in every class model; class models are a handful of matrices. limits: of q by class, in place of the theoretical ones."""
    out = None
    for name, m in models.items():
        part = m.scored(df.select(key, values), values).select(key, F.lit(name).alias("class"), "t2", "q", ((F.col("t2") <= m.t2_limit(alpha)) & (F.col("q") <= (limits[name] if limits else m.q_limit(alpha)))).alias("inside"))
        out = part if out is None else out.unionAll(part)
    return out


def simca_label(assigned: DataFrame, key: str) -> DataFrame:
    """(key, classes, label): none, the class, or ambiguous."""
    got = assigned.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("inside"), F.col("class").cast("string")))).alias("classes"))
    return got.withColumn("label", F.when(F.size("classes") == 0, "none").when(F.size("classes") == 1, F.element_at("classes", 1)).otherwise("ambiguous"))


def kennard_stone(points: np.ndarray, n: int) -> list[int]:
    """Max-min selection (Kennard & Stone, 1969) on a bounded set of points."""
    d = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(2), 0))
    chosen = list(np.unravel_index(d.argmax(), d.shape))
    while len(chosen) < min(n, len(points)):
        least = d[:, chosen].min(1)
        least[chosen] = -1
        chosen.append(int(least.argmax()))
    return [int(i) for i in chosen[:n]]


def asca_one_factor(rows: DataFrame, factor: str) -> DataFrame:
    """Sums of squares of a factor's effect, the residuals and the centred data (Smilde, 2005), over all variables."""
    grand = rows.groupBy("var_idx").agg(F.avg("x").alias("g"))
    level = rows.groupBy(factor, "var_idx").agg(F.avg("x").alias("m"))
    joined = rows.join(level, [factor, "var_idx"]).join(F.broadcast(grand), "var_idx")
    return joined.agg(F.sum((F.col("m") - F.col("g")) ** 2).alias("ss_effect"), F.sum((F.col("x") - F.col("m")) ** 2).alias("ss_residual"), F.sum((F.col("x") - F.col("g")) ** 2).alias("ss_total"))


def wilks_separation(by: dict) -> float:
    """1 - Wilks' lambda of classes from moments_by."""
    n = sum(m[0] for m in by.values())
    mean = sum(m[0] * m[1] for m in by.values()) / n
    within = sum((m[0] - 1) * m[2] for m in by.values())
    total = within + sum(m[0] * np.outer(m[1] - mean, m[1] - mean) for m in by.values())
    ridge = 1e-12 * np.eye(len(mean))
    return float(1 - np.exp(np.linalg.slogdet(within + ridge)[1] - np.linalg.slogdet(total + ridge)[1]))


def asca(df: DataFrame, values: str, a: str, b: str) -> dict[str, float]:
    """Sums of squares of two factors, their interaction, the residuals and the centred data (Smilde, 2005), over all variables.

    Sum-to-zero coding, sequential: a, then b, then a x b. All follows from the cells' numbers, means and spreads, by one pass.
    """
    cell = F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string"))
    by = moments_by(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_cell", cell), values, "_cell")
    names = [k.rsplit("|", 1) for k in by]
    n = np.array([m[0] for m in by.values()], float)
    means = np.array([m[1] for m in by.values()])
    residual = float(sum((m[0] - 1) * np.trace(m[2]) for m in by.values()))
    found, centred = asca_effects(n, means, names)
    return {k: v for k, (v, _) in found.items()} | {"ss_residual": residual, "ss_total": float((n[:, None] * centred**2).sum()) + residual}


def asca_effects(n: np.ndarray, means: np.ndarray, names: list[tuple[str, str]]) -> tuple[dict[str, tuple[float, np.ndarray]], np.ndarray]:
    """Sum of squares and fitted cell means of each effect, one after another, and the centred cell means; names: the levels of both factors by cell."""
    centred = means - n @ means / n.sum()
    columns = []
    for at in (0, 1):
        levels = sorted({x[at] for x in names})
        columns.append(np.array([[float(x[at] == k) - float(x[at] == levels[-1]) for k in levels[:-1]] for x in names]))
    columns.append(np.einsum("ij,ik->ijk", columns[0], columns[1]).reshape(len(names), -1))
    w, design, last, before, out = np.sqrt(n)[:, None], np.ones((len(names), 1)), 0.0, np.zeros_like(centred), {}
    for name, x in zip(("ss_a", "ss_b", "ss_ab"), columns, strict=True):
        design = np.hstack([design, x])
        fitted = design @ np.linalg.lstsq(w * design, w * centred, rcond=None)[0]
        now = float((n[:, None] * fitted**2).sum())
        out[name] = (max(0.0, now - last), fitted - before)
        last, before = now, fitted
    return out, centred
