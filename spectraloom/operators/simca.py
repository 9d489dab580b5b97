"""Limits of SIMCA's residual from rows that a class model has not seen (Wold, 1976)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.relational import quantiles
from spectraloom.operators.stats import PCA, moments_by


def held_out_residuals(df: DataFrame, key: str, values: str, label: str, models: dict[object, PCA], folds: int = 10) -> DataFrame:
    """(class, fold, key, q): squared residual of every row of a modelled class, by a model of as many components fitted to the class's other folds.

    Folds are dealt by a hash of the key. One pass sums moments by class and fold, so no fold reads the rows again; a class whose other rows are
    no more than its components in some fold is judged by its own model.
    """
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    name = F.col(label).cast("string")
    rows = df.where(F.col(label).isNotNull() & F.col(values).isNotNull()).select(F.col(key).alias("key"), name.alias("class"), fold.alias("fold"), arrays.doubles(F.col(values)).alias("v"))
    sums: dict[str, dict[int, tuple]] = {}
    for g, (n, mean, cov) in moments_by(rows.withColumn("g", F.concat_ws("|", "class", F.col("fold").cast("string"))), "v", "g").items():
        c, f = g.rsplit("|", 1)
        sums.setdefault(c, {})[int(f)] = (n, n * mean, (n - 1) * np.nan_to_num(cov) + n * np.outer(mean, mean))
    held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for c, model in ((str(c), m) for c, m in models.items()):
        k, parts = len(model.eigenvalues), sums.get(c, {})
        total = [sum(p[i] for p in parts.values()) for i in range(3)]
        enough = all(total[0] - n > k for n, _, _ in parts.values())
        for f, own in parts.items():
            if enough:
                n, s, q = (t - o for t, o in zip(total, own, strict=True))
                other = PCA.from_moments(n, s / n, (q - np.outer(s, s) / n) / max(1, n - 1), k)
                held[c, f] = (other.mean, other.loadings)
            else:
                held[c, f] = (model.mean, model.loadings)
    shared = df.sparkSession.sparkContext.broadcast(held)  # classes x folds matrices of components

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, part in b.groupby(["class", "fold"]):
                if at in shared.value:
                    mean, loadings = shared.value[at]
                    x = np.stack([np.asarray(v, np.float64) for v in part["v"]]) - mean
                    yield part[["class", "fold", "key"]].assign(q=((x - x @ loadings @ loadings.T) ** 2).sum(1))

    return rows.mapInPandas(run, f"class string, fold int, key {df.schema[key].dataType.simpleString()}, q double")


def limits(df: DataFrame, key: str, values: str, label: str, models: dict[object, PCA], alpha: float = 0.05, folds: int = 10) -> dict[object, float]:
    """By class the residual's limit: the (1 - alpha) quantile of the held-out residuals, or the theoretical limit where that is wider and no
    less than their 5 % quantile."""
    found = {r["class"]: (r.low, r.high) for r in quantiles(held_out_residuals(df, key, values, label, models, folds), "q", {"low": 0.05, "high": 1 - alpha}, "class").collect()}
    out = {}
    for c, model in models.items():
        theory, (low, high) = model.q_limit(alpha), found[str(c)]
        out[c] = max(theory, high) if np.isfinite(theory) and theory >= low else high
    return out
