"""Two-block fusion, learning curves and instrument matrices from second moments by group.

One pass over the rows sums 1, v and v v' for each group (folds, instruments: few). Training sets are sums of
groups, and the error of a linear model on a group follows from that group's sums, so no setting reads rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.models import pls_kernel


@dataclass
class Sums:
    """Rows, sum and sum of outer products of vectors whose last entry is the target."""

    n: int
    s: np.ndarray
    q: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.q + other.q)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.s - other.s, self.q - other.q)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        mean = self.s / max(1, self.n)
        return mean, (self.q - self.n * np.outer(mean, mean)) / max(1, self.n - 1)

    def errors(self, mean: np.ndarray, coef: np.ndarray) -> tuple[float, float]:
        """Sums of squared errors and of errors of y = mean_y + (x - mean_x) coef on these rows."""
        w, at = np.append(-coef, 1.0), mean[:-1] @ coef - mean[-1]
        first = float(w @ self.s + self.n * at)
        return max(0.0, float(w @ self.q @ w + 2 * at * (w @ self.s) + self.n * at * at)), first


def _vector(values: list[str], target: str) -> Column:
    return F.concat(*[arrays.doubles(F.col(v)) for v in values], F.array(F.col(target).cast("double")))


def sums_by(df: DataFrame, values: list[str], target: str, group: Column) -> dict[str, Sums]:
    """Sums of the joined value arrays and the target by group; rows with a null in group or target are left out."""

    def part(batches):
        import pandas as pd

        sums: dict[str, Sums] = {}
        for b in batches:
            for g, rows in b.groupby("g"):
                x = np.stack([np.asarray(v, np.float64) for v in rows["v"]])
                own = Sums(len(x), x.sum(0), x.T @ x)
                sums[g] = sums[g] + own if g in sums else own
        if sums:
            yield pd.DataFrame({"g": list(sums), "n": [t.n for t in sums.values()], "s": [t.s.tolist() for t in sums.values()], "q": [t.q.ravel().tolist() for t in sums.values()]})

    rows = df.select(group.cast("string").alias("g"), _vector(values, target).alias("v"), target).where(F.col("g").isNotNull() & F.col(target).isNotNull())
    parts = rows.select("g", "v").mapInPandas(part, "g string, n long, s array<double>, q array<double>")
    add = lambda c: Summarizer.sum(array_to_vector(F.col(c))).alias(c)
    got = parts.groupBy("g").agg(F.sum("n").alias("n"), add("s"), add("q")).orderBy("g").collect()
    return {r["g"]: Sums(r["n"], r["s"].toArray(), r["q"].toArray().reshape(len(r["s"]), -1)) for r in got}


def _all(sums: list[Sums]) -> Sums:
    total = sums[0]
    for x in sums[1:]:
        total = total + x
    return total


# ---- fusion of two blocks -----------------------------------------------------------------


def so_pls(cov: np.ndarray, first: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """Coefficients of sequential orthogonalised PLS (Naes, Tomic, Mevik & Martens, 2011): PLS on one block, then
    on the part of the other that its scores do not explain. `first` and `second` are indices; the target is last."""
    saa, sab, say = cov[np.ix_(first, first)], cov[np.ix_(first, second)], cov[first, -1:]
    rot, ca = pls_kernel(saa, say, k)
    explained = rot @ np.linalg.pinv(rot.T @ saa @ rot) @ rot.T @ sab
    _, cb = pls_kernel(cov[np.ix_(second, second)] - explained.T @ saa @ explained, cov[second, -1:] - explained.T @ say, k)
    coef = np.zeros(len(cov) - 1)
    coef[first], coef[second] = (ca - explained @ cb)[:, 0], cb[:, 0]
    return coef


def strategies(cov: np.ndarray, width: int, k: int) -> dict[str, np.ndarray]:
    """Coefficients of each way to use two blocks; the first has `width` variables."""
    p = len(cov) - 1
    a, b = np.arange(width), np.arange(width, p)
    xx, xy = cov[:p, :p], cov[:p, p:]

    def placed(at: np.ndarray) -> np.ndarray:
        out = np.zeros(p)
        out[at] = pls_kernel(xx[np.ix_(at, at)], xy[at], k)[1][:, 0]
        return out

    only = {"a": placed(a), "b": placed(b)}
    scale = np.concatenate([np.full(len(at), 1 / np.sqrt(max(np.trace(xx[np.ix_(at, at)]), 1e-300))) for at in (a, b)])
    low = scale * pls_kernel(scale[:, None] * xx * scale, scale[:, None] * xy, k)[1][:, 0]
    loads = np.zeros((p, 2 * k))
    for i, at in enumerate((a, b)):
        kept = np.linalg.eigh(xx[np.ix_(at, at)])[1][:, ::-1][:, :k]
        loads[at, i * k : i * k + kept.shape[1]] = kept
    mid = loads @ pls_kernel(loads.T @ xx @ loads, loads.T @ xy, k)[1][:, 0]
    return only | {"low_level": low, "mid_level": mid, "so_pls_ab": so_pls(cov, a, b, k), "so_pls_ba": so_pls(cov, b, a, k), "high_level": (only["a"] + only["b"]) / 2}


def compare(df: DataFrame, a: str, b: str, target: str, fold: str, k: int = 4) -> DataFrame:
    """One row a strategy: n, cross-validated rmse and r2 over the folds in column `fold`."""
    by = sums_by(df, [a, b], target, F.col(fold))
    width = len(df.select(a).where(F.col(a).isNotNull()).first()[0])
    total, sse = _all(list(by.values())), {}
    for own in by.values():
        mean, cov = (total - own).centred()
        for name, coef in strategies(cov, width, k).items():
            sse[name] = sse.get(name, 0.0) + own.errors(mean, coef)[0]
    spread = total.q[-1, -1] - total.s[-1] ** 2 / total.n
    return df.sparkSession.createDataFrame([(name, total.n, float(np.sqrt(x / total.n)), float(1 - x / max(spread, 1e-300))) for name, x in sse.items()], "strategy string, n long, rmse double, r2 double")


# ---- validation ---------------------------------------------------------------------------


def learning_curve(df: DataFrame, values: str, target: str, key: str, k: int = 4, steps: int = 5, seed: int = 0) -> DataFrame:
    """One row a training size: share, n, rmse on the training rows and on a fixed test part (2 of 2 + 2 * steps parts by hash)."""
    parts = 2 + 2 * steps
    by = sums_by(df, [values], target, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(parts)))
    groups = [by[str(i)] for i in range(parts) if str(i) in by]
    test, rest, rows = _all(groups[:2]), groups[2:], []
    for step in range(1, steps + 1):
        train = _all(rest[: 2 * step])
        mean, cov = train.centred()
        coef = pls_kernel(cov[:-1, :-1], cov[:-1, -1:], k)[1][:, 0]
        rows.append((step / steps, train.n, *(float(np.sqrt(x.errors(mean, coef)[0] / max(1, x.n))) for x in (train, test))))
    return df.sparkSession.createDataFrame(rows, "share double, n long, rmse_train double, rmse_test double")


def instruments(df: DataFrame, values: str, target: str, instrument: str, fold: str, k: int = 4) -> DataFrame:
    """(train, test, n, rmse, bias) of PLS on one instrument, or on all others (pooled), applied to another; the diagonal is cross-validated."""
    # folds are digits, so the last separator parts the two
    by = sums_by(df, [values], target, F.concat(F.col(instrument).cast("string"), F.lit("|"), F.col(fold).cast("string")))
    parts: dict[str, list[Sums]] = {}
    for name, x in by.items():
        parts.setdefault(name.rpartition("|")[0], []).append(x)
    whole = {name: _all(x) for name, x in parts.items()}

    def judged(train: Sums, test: Sums) -> np.ndarray:
        mean, cov = train.centred()
        return np.array(test.errors(mean, pls_kernel(cov[:-1, :-1], cov[:-1, -1:], k)[1][:, 0]))

    rows = []
    for test, own in whole.items():
        found = {train: judged(x, own) for train, x in whole.items() if train != test}
        if len(parts[test]) > 1:
            found[test] = sum(judged(own - x, x) for x in parts[test])
        if len(whole) > 1:
            found["pooled"] = judged(_all([x for name, x in whole.items() if name != test]), own)
        rows += [(train, test, own.n, float(np.sqrt(e / own.n)), float(-first / own.n)) for train, (e, first) in found.items()]
    return df.sparkSession.createDataFrame(rows, "train string, test string, n long, rmse double, bias double")


def enrichment(df: DataFrame, values: str, target: str, instrument: str, key: str, sizes: tuple[int, ...] = (0, 3, 5, 10, 20), repeats: int = 5, k: int = 4) -> DataFrame:
    """(instrument, added, rmse, sd): PLS on all other instruments and `added` rows of this one, tested on its remaining rows; mean and deviation over `repeats` draws.

    A draw takes the rows of the lowest hashes, so max(sizes) rows an instrument and repeat come to the driver, whatever
    the table's size. Draws that leave no test row are left out, and an instrument with none for a size has no row there.
    """
    from pyspark.sql import Window

    rows = df.where(F.col(target).isNotNull() & F.col(instrument).isNotNull())
    by = sums_by(rows, [values], target, F.col(instrument))
    drawn: dict[tuple[str, int], list[np.ndarray]] = {}
    for repeat in range(repeats):
        place = F.row_number().over(Window.partitionBy(instrument).orderBy(F.xxhash64(F.lit(repeat), F.col(key)), F.col(key)))
        taken = rows.select(F.col(instrument).cast("string").alias("g"), _vector([values], target).alias("v"), place.alias("place")).where(F.col("place") <= max(sizes))
        for r in sorted(taken.collect(), key=lambda r: r["place"]):
            drawn.setdefault((r["g"], repeat), []).append(np.asarray(r["v"], np.float64))

    out = []
    for name, own in by.items():
        others = [x for other, x in by.items() if other != name]
        for size in sizes if others else ():
            rmse = []
            for repeat in range(1 if size == 0 else repeats):
                x = np.stack(drawn[name, repeat])[:size]
                added = Sums(len(x), x.sum(0), x.T @ x)
                train, test = _all([*others, added]), own - added
                if test.n > 0:
                    mean, cov = train.centred()
                    rmse.append(np.sqrt(test.errors(mean, pls_kernel(cov[:-1, :-1], cov[:-1, -1:], k)[1][:, 0])[0] / test.n))
            if rmse:
                out.append((name, size, float(np.mean(rmse)), float(np.std(rmse))))
    return df.sparkSession.createDataFrame(out, "instrument string, added int, rmse double, sd double")


def shares(df: DataFrame, a: str, b: str, target: str, k: int = 4) -> DataFrame:
    """(strategy, share_a, share_b): the variance of each block's part of the prediction over the sum of both; null where both are 0."""
    total = _all(list(sums_by(df, [a, b], target, F.lit("all")).values()))
    width, (_, cov) = len(df.select(a).where(F.col(a).isNotNull()).first()[0]), total.centred()
    out = []
    for name, coef in strategies(cov, width, k).items():
        parts = [float(c @ cov[at, at] @ c) for at in (slice(0, width), slice(width, len(cov) - 1)) for c in (coef[at],)]
        out.append((name, *(x / sum(parts) if sum(parts) > 0 else None for x in parts)))
    return df.sparkSession.createDataFrame(out, "strategy string, share_a double, share_b double")


def confirm(by: dict[str, Sums], regions: list[tuple[int, int]], draws: int = 5, k: int = 4, seed: int = 0) -> list[tuple[str, float]]:
    """Cross-validated rmse of PLS on all variables, on the regions [first, last] and on `draws` sets of windows of the same widths at random places.

    `by` holds the sums of each fold; a set of variables is a part of them, so no row is read again.
    """
    total, rng = _all(list(by.values())), np.random.default_rng(seed)
    p = len(total.s) - 1

    def judged(at: np.ndarray) -> float:
        cols = np.append(at, p)
        part = lambda x: Sums(x.n, x.s[cols], x.q[np.ix_(cols, cols)])
        error = 0.0
        for own in by.values():
            mean, cov = part(total - own).centred()
            error += part(own).errors(mean, pls_kernel(cov[:-1, :-1], cov[:-1, -1:], min(k, len(at)))[1][:, 0])[0]
        return float(np.sqrt(error / total.n))

    spread = lambda windows: np.unique(np.concatenate([np.arange(low, high + 1) for low, high in windows]))
    at_random = [[(low, low + high - first) for first, high in regions for low in (int(rng.integers(0, p - (high - first))),)] for _ in range(draws)]
    return [("all", judged(np.arange(p))), ("regions", judged(spread(regions))), *((f"random_{i + 1}", judged(spread(w))) for i, w in enumerate(at_random))]
