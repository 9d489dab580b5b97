"""Folds, supervised models on second moments, metrics and reliability."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import special
from spectraloom.operators import pairs
from spectraloom.operators.relational import cumulative, quantiles
from spectraloom.operators.stats import moments, moments_by
from spectraloom.sources.shared import dropped, written


def folds(df: DataFrame, key: str, k: int, label: str | None = None, seed: int = 0) -> DataFrame:
    """Adds fold: rows dealt in order of a hash, within classes where a label is given."""
    w = Window.partitionBy(*[label] if label else []).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k) if label else df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))


@dataclass
class Linear:
    """y = (x - mean) @ coef + intercept; coef is p x m."""

    mean: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray

    def scores(self, df: DataFrame, values: str, into: str = "yhat") -> DataFrame:
        from spectraloom.operators.signal import map_matrix

        return map_matrix(df.withColumn(into, F.transform(values, lambda x: x.cast("double"))), into, lambda x: (x - self.mean) @ self.coef + self.intercept)


def pls_kernel(xx: np.ndarray, xy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (p x components) and coefficients (p x targets) of partial least squares from X'X and X'Y."""
    weights, loads, answers = [], [], []
    for _ in range(k):
        u = np.linalg.svd(xy, full_matrices=False)[0][:, 0]
        r = u - sum((load @ u) * rot for load, rot in zip(loads, weights, strict=True)) if loads else u
        tt = r @ xx @ r
        if tt < 1e-14:
            break
        load, answer = xx @ r / tt, xy.T @ r / tt
        xy = xy - np.outer(load, answer) * tt
        loads.append(load)
        weights.append(r)
        answers.append(answer)
    if not weights:
        return np.zeros((len(xx), 0)), np.zeros(xy.shape)
    return np.array(weights).T, np.array(weights).T @ np.array(answers)


def pls(df: DataFrame, values: str, targets: list[str], k: int) -> Linear:
    """Partial least squares from second moments (kernel form): X'X and X'Y are aggregates, the rest is p x p on the driver."""
    both = df.select(F.concat(F.transform(values, lambda x: x.cast("double")), F.array(*[F.col(t).cast("double") for t in targets])).alias("v"))
    _, mean, cov = moments(both, "v")
    p = len(mean) - len(targets)
    return Linear(mean[:p], pls_kernel(cov[:p, :p], cov[:p, p:], k)[1], mean[p:])


def lda(df: DataFrame, values: str, label: str, ridge: float = 1e-8) -> tuple[list, Linear]:
    """Linear discriminants from class means and the pooled covariance; scores are log posteriors up to a constant."""
    stats = moments_by(df, values, label)
    n = sum(s[0] for s in stats.values())
    pooled = sum((s[0] - 1) * s[2] for s in stats.values()) / max(1, n - len(stats))
    inverse = np.linalg.pinv(pooled + ridge * np.trace(pooled) / len(pooled) * np.eye(len(pooled)))
    grand = sum(s[0] * s[1] for s in stats.values()) / n
    centred = np.array([s[1] - grand for s in stats.values()])
    prior = np.log([s[0] / n for s in stats.values()])
    return list(stats), Linear(grand, inverse @ centred.T, prior - 0.5 * np.einsum("ij,jk,ik->i", centred, inverse, centred))


def classify(df: DataFrame, values: str, names: list, model: Linear) -> DataFrame:
    """Adds scores and yhat, the class with the largest score."""
    out = model.scores(df, values, "scores")
    at = F.array_position("scores", F.array_max("scores")).cast("int")
    return out.withColumn("yhat", F.element_at(F.array(*[F.lit(n) for n in names]), at))


#: Query rows of a block; TRAIN_BLOCK training rows meet it in a cell.
QUERY_BLOCK, TRAIN_BLOCK = 16384, 32768


def _nearest(ids: np.ndarray, x: np.ndarray, more: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of the k rows y[j] nearest to each x[i], the first on ties, without those of its own key."""
    low, own = pairs.Bounds(x, y), len(np.intersect1d(ids, more)) > 0
    d, at = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
    squared = lambda a, b: np.concatenate([np.zeros(0), *(((x[a[i : i + pairs.AT_ONCE]] - y[b[i : i + pairs.AT_ONCE]]) ** 2).sum(1) for i in range(0, len(a), pairs.AT_ONCE))])
    for i in range(0, len(x), pairs.TILE):
        rows = np.arange(i, min(i + pairs.TILE, len(x)))
        for j in range(0, len(y), pairs.WIDE):
            columns = np.arange(j, min(j + pairs.WIDE, len(y)))
            tile, worst = low.tile(slice(rows[0], rows[-1] + 1), slice(j, columns[-1] + 1)), d[rows, -1]
            if own:
                tile[ids[rows][:, None] == more[columns][None]] = np.inf
            if j == 0 and len(columns) > k:  # k distances that surely are reached
                first = np.argpartition(tile, k - 1, axis=1)[:, :k]
                reached = np.where(np.isfinite(np.take_along_axis(tile, first, 1)), squared(np.repeat(rows, k), first.ravel()).reshape(-1, k), np.inf)
                worst = reached.max(1)
            found = np.flatnonzero((tile <= low.limit(np.sqrt(worst), up=True)[:, None]) & (tile < np.inf)) if own else np.flatnonzero(tile <= low.limit(np.sqrt(worst), up=True)[:, None])
            if not len(found):
                continue
            a, b = rows[found // len(columns)], columns[found % len(columns)]
            some = np.unique(a)
            of, far, to = np.concatenate([np.repeat(some, k), a]), np.concatenate([d[some].ravel(), squared(a, b)]), np.concatenate([at[some].ravel(), b])
            order = np.lexsort((to, far, of))
            starts = np.searchsorted(of[order], some)
            kept = order[(starts[:, None] + np.arange(k)).ravel()]
            d[some], at[some] = far[kept].reshape(-1, k), to[kept].reshape(-1, k)
    a, b = np.nonzero(np.isfinite(d))
    return a, at[a, b], d[a, b]


def knn(queries: DataFrame, train: DataFrame, key: str, label: str, values: str, k: int = 5) -> DataFrame:
    """(key, yhat): majority of the k nearest training rows, the smaller class on ties; a row is no neighbour of its own key.

    A block of query rows meets each block of training rows in a cell, which hands on the k nearest of its pairs for every query.
    Rows without a key or with values that are not all finite are left out.
    """
    side = lambda df, *more: df.where(F.col(key).isNotNull() & pairs.finite(values)).select(F.lit(0).alias("part"), F.col(key).cast("long").alias("id"), F.transform(values, lambda x: x.cast("double")).alias("x"), *more)
    asked, known = pairs.blocks(side(queries), QUERY_BLOCK), pairs.blocks(side(train, F.col(label).alias("y")), TRAIN_BLOCK, "y")
    kind = train.schema[label].dataType.simpleString()

    def cell(part: int, one: tuple, other: tuple, same: bool):
        (ids, x), (more, y, labels) = one, other
        i, j, d = _nearest(ids, x, more, y, k)
        if len(i):
            yield [ids[i], more[j], labels.take(pa.array(j)), d]

    near = pairs.cells(asked, known, lambda a, b: F.lit(True), cell, f"q long, t long, y {kind}, d double", ("y",))
    near = written(near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "t"))).where(F.col("r") <= k), "near")
    dropped(asked, known)
    votes = near.groupBy("q", "y").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.min(F.struct(-F.col("n"), "y"))["y"].alias("yhat")).withColumnRenamed("q", key)


def pls_da(df: DataFrame, values: str, label: str, k: int) -> tuple[list, Linear]:
    """Discriminant PLS (Barker & Rayens, 2003): PLS of the classes' indicators on autoscaled variables; the largest answer wins."""
    by = moments_by(df, values, label)
    n, mean = sum(m[0] for m in by.values()), sum(m[0] * m[1] for m in by.values()) / sum(m[0] for m in by.values())
    total = sum((m[0] - 1) * m[2] + m[0] * np.outer(m[1] - mean, m[1] - mean) for m in by.values())
    share = np.array([m[0] / n for m in by.values()])
    cross = np.array([m[0] * (m[1] - mean) for m in by.values()]).T
    sd = np.sqrt(np.diag(total) / max(1, n - 1))
    sd = np.where(sd > 0, sd, 1.0)
    spread = np.sqrt(np.maximum(n * share * (1 - share) / max(1, n - 1), 1e-300))
    _, coef = pls_kernel(total / np.outer(sd, sd), cross / np.outer(sd, spread), k)
    return list(by), Linear(mean, coef * spread / sd[:, None], share)


def confusion(rows: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return rows.groupBy(y, yhat).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row a class: support, precision, recall, specificity and F1."""
    both = rows.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), (F.col(y) == F.col(yhat)).cast("int").alias("tp"), F.lit(0).alias("p")), F.struct(F.col(yhat).alias("c"), F.lit(0).alias("t"), F.lit(0).alias("tp"), F.lit(1).alias("p")))).alias("e")).select("e.*")
    s = both.groupBy("c").agg(F.sum("t").alias("support"), F.sum("tp").alias("tp"), F.sum("p").alias("predicted"))
    n = rows.agg(F.count("*").alias("n"))
    s = s.crossJoin(F.broadcast(n))  # one row
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    return s.select(F.col("c").alias("class"), sup.alias("support"), safe(tp, pred).alias("precision"), safe(tp, sup).alias("recall"), safe(F.col("n") - sup - pred + tp, F.col("n") - sup).alias("specificity"), safe(2 * tp, sup + pred).alias("f1"))


def regression_metrics(rows: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: n, rmse, mae, r2, rpd (sample deviation over rmse) and rpiq."""
    e = F.col(y) - F.col(yhat)
    rmse = F.sqrt(F.avg(e * e))
    sst = F.var_pop(y) * F.count(y)
    out = rows.agg(F.count("*").alias("n"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / sst).alias("r2"), (F.stddev_samp(y) / rmse).alias("rpd"))
    iqr = quantiles(rows, y, {"q1": 0.25, "q3": 0.75}).select((F.col("q3") - F.col("q1")).alias("iqr"))
    return out.crossJoin(F.broadcast(iqr)).withColumn("rpiq", F.col("iqr") / F.col("rmse")).drop("iqr")  # one row each


def roc(rows: DataFrame, positive: Column, score: str) -> DataFrame:
    """(threshold, tpr, fpr): one point a distinct score, from the highest down."""
    by = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("f"))
    total = by.agg(F.sum("p").alias("ps"), F.sum("f").alias("fs"))
    upto = cumulative(by.withColumn("down", -F.col("threshold")), "down", ["p", "f"]).crossJoin(F.broadcast(total))  # one row
    return upto.select("threshold", F.try_divide("upto_p", "ps").alias("tpr"), F.try_divide("upto_f", "fs").alias("fpr"))


def conformal_radius(residuals: DataFrame, alpha: float = 0.1, value: str = "residual", *keys: str) -> DataFrame:
    """A row by keys: n and the k-th smallest absolute residual, k = ceil((n + 1)(1 - alpha)); infinite where k exceeds n."""
    ranked = residuals.where(F.col(value).isNotNull()).groupBy(*keys, F.abs(value).alias("r")).agg(F.count("*").alias("c"))
    n = ranked.groupBy(*keys).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).withColumn("k", F.ceil((F.col("n") + 1) * F.lit(1 - alpha) - 1e-9))
    upto = cumulative(ranked, "r", ["c"], *keys)
    joined = n.join(upto, list(keys), "left") if keys else n.join(upto, F.col("upto_c") >= F.col("k"), "left")
    return joined.groupBy(*keys, "n").agg(F.coalesce(F.min(F.when(F.col("upto_c") >= F.col("k"), F.col("r"))), F.lit(float("inf"))).alias("radius"))


def overall(rows: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: n, accuracy, balanced accuracy, macro precision, recall and F1, Cohen's kappa and Matthews' correlation, from the class counts."""
    m = class_metrics(rows, y, yhat)
    pred = rows.groupBy(F.col(yhat).alias("class")).agg(F.count("*").alias("predicted"))
    hit = rows.where(F.col(y) == F.col(yhat)).groupBy(F.col(y).alias("class")).agg(F.count("*").alias("right"))
    c = m.join(pred, "class", "left").join(hit, "class", "left").fillna(0, ["predicted", "right"])
    s = c.agg(F.sum("support").alias("n"), F.sum("right").alias("c"), F.sum(F.col("support") * F.col("predicted")).alias("tp"), F.sum(F.col("support") * F.col("support")).alias("tt"), F.sum(F.col("predicted") * F.col("predicted")).alias("pp"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    n, right, tp, tt, pp = (F.col(x).cast("double") for x in ("n", "c", "tp", "tt", "pp"))
    mcc = F.coalesce(F.try_divide(right * n - tp, F.sqrt(n * n - pp) * F.sqrt(n * n - tt)), F.lit(0.0))
    return s.select("n", (right / n).alias("accuracy"), "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", F.coalesce(F.try_divide(right * n - tp, n * n - tp), F.lit(0.0)).alias("kappa"), mcc.alias("mcc"))


def auc(scores: DataFrame, positive: Column, score: str, *keys: str) -> DataFrame:
    """(keys…, auc): the share of (positive, negative) pairs in order, ties half (Mann & Whitney), from counts of distinct scores."""
    by = scores.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("f"))
    upto = cumulative(by, "s", ["f"], *keys)
    won = upto.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("upto_f") - F.col("f") / 2)).alias("w"), F.sum("p").alias("ps"), F.sum("f").alias("fs"))
    return won.select(*keys, F.try_divide("w", F.col("ps") * F.col("fs")).alias("auc"))


def stratified(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Adds fold: rows of a class dealt by ascending key (a number), the folds being as many as the smallest class has rows at most."""
    most = df.groupBy(label).agg(F.count("*").alias("c")).agg(F.least(F.lit(k).cast("long"), F.min("c")).alias("_k"))
    dealt = cumulative(df.withColumn("_one", F.lit(1)), key, ["_one"], label)
    return dealt.crossJoin(F.broadcast(most)).withColumn("fold", ((F.col("upto__one") - 1) % F.greatest(F.lit(1), F.col("_k"))).cast("int")).drop("_one", "upto__one", "_k")  # one row


def mcnemar(rows: DataFrame, a_right: Column, b_right: Column) -> DataFrame:
    """One row: the counts where only one of two classifiers is right, and chi-square with continuity correction."""
    n = rows.agg(F.count_if(a_right & ~b_right).alias("only_a"), F.count_if(b_right & ~a_right).alias("only_b"))
    return n.withColumn("chi2", F.try_divide((F.abs(F.col("only_a") - F.col("only_b")) - 1.0) ** 2, F.col("only_a") + F.col("only_b")))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact binomial below 25 discordant rows, else the chi-square tail."""
    n = only_a + only_b
    if n >= 25:
        return 1 - special.chi2_cdf((abs(only_a - only_b) - 1) ** 2 / n, 1)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(only_a, only_b) + 1)) / 2**n)


def paired_t(rows: DataFrame, difference: Column) -> DataFrame:
    """One row: n and Student's t of paired differences; its p-value is special.t_cdf of n - 1 degrees."""
    return rows.agg(F.count(difference).alias("n"), (F.avg(difference) / (F.stddev_samp(difference) / F.sqrt(F.count(difference)))).alias("t"))


def pairwise(by_fold: DataFrame, names: list[str]) -> DataFrame:
    """(one, other, n, difference, t, p, finding) of every two models' errors by fold, one column a model; folds are few."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = by_fold.select(F.explode(F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])).alias("e")).select("e.*")
    out = rows.groupBy("one", "other").agg(F.count("d").alias("n"), F.avg("d").alias("difference"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t"))
    p = F.udf(lambda t, n: None if t is None or n < 2 else float(2 * (1 - special.t_cdf(abs(t), n - 1))), "double")  # a row a pair of models
    better = F.when(F.col("difference") < 0, F.col("one")).otherwise(F.col("other"))
    finding = F.when(F.col("p") < 0.05, F.concat(better, F.lit(" is better"))).otherwise("no clear difference")
    return out.withColumn("p", p("t", "n")).withColumn("finding", finding)


def fewest(rows: DataFrame, size: str, score: str, within: float) -> DataFrame:
    """One row: the least size whose score is within `within` of the best."""
    best = rows.agg(F.max(score).alias("_best"))
    return rows.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("_best") - within).agg(F.min(size).alias(size))  # one row
