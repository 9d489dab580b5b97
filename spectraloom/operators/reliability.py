"""Running sums over many rows, class-conditional sets, peak metrics, partners for mixing and permuting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.models import Linear, conformal_radius
from spectraloom.operators.relational import cumulative, quantiles
from spectraloom.operators.signal import map_matrix, savgol
from spectraloom.operators.stats import average_rank


def class_thresholds(calibration: DataFrame, label: str, score: str, alpha: float = 0.1) -> DataFrame:
    """(label, n, threshold): by class the k-th smallest nonconformity score, k = ceil((n + 1)(1 - alpha)); infinite where k exceeds n."""
    counts = calibration.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(label, F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    n = counts.groupBy(label).agg(F.sum("_c").alias("n")).withColumn("k", F.ceil((F.col("n") + 1) * F.lit(1 - alpha) - 1e-9))
    upto = cumulative(counts, "_s", ["_c"], label).join(n, label)
    return upto.groupBy(label, "n").agg(F.coalesce(F.min(F.when(F.col("upto__c") >= F.col("k"), F.col("_s"))), F.lit(float("inf"))).alias("threshold"))


def conformal_sets(scores: DataFrame, key: str, label: str, score: str, thresholds: DataFrame) -> DataFrame:
    """(key, classes): all classes whose score is within their threshold, in order; from one row a key and class (Vovk, 2012)."""
    inside = scores.join(thresholds.select(label, "threshold"), label).where(F.col(score) <= F.col("threshold"))
    return scores.select(key).distinct().join(inside.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("classes")), key, "left").withColumn("classes", F.coalesce("classes", F.array().cast(inside.select(F.array(label)).schema[0].dataType)))


def acceptance(judged: DataFrame, label: str) -> DataFrame:
    """By class model, from rows (label, own, inside): sensitivity, specificity, false alarms, missed and efficiency, the root of the first two's product."""
    share = lambda keep, c: F.avg(F.when(keep, c.cast("double")))
    own, inside = F.col("own"), F.col("inside")
    out = judged.groupBy(label).agg(share(own, inside).alias("sensitivity"), share(~own, ~inside).alias("specificity"), F.count_if(~own & inside).alias("false_alarms"), F.count_if(own & ~inside).alias("missed"))
    return out.withColumn("efficiency", F.sqrt(F.col("sensitivity") * F.col("specificity")))


def tercile_radii(rows: DataFrame, yhat: str, residual: str, alpha: float = 0.1, least: int = 30) -> DataFrame:
    """(tercile, n, radius): conformal radii by tercile of the prediction; one radius for all (tercile null) below `least` rows."""
    cuts = quantiles(rows, yhat, {"a": 1 / 3, "b": 2 / 3}).first()
    if cuts is None or cuts["n"] < least:
        return conformal_radius(rows, alpha, residual).select(F.lit(None).cast("int").alias("tercile"), "n", "radius")
    tercile = F.when(F.col(yhat) <= cuts["a"], 0).when(F.col(yhat) <= cuts["b"], 1).otherwise(2)
    return conformal_radius(rows.withColumn("tercile", tercile), alpha, residual, "tercile")


def consensus(rows: DataFrame, key: str, a: str, b: str, top: float = 0.75) -> DataFrame:
    """(key, consensus, category): the mean of two measures' average-rank shares, and which of the two put it on top. One row a variable."""
    n = F.count("*").over(Window.partitionBy())
    shares = rows.withColumns({"_a": average_rank(F.col(a)) / n, "_b": average_rank(F.col(b)) / n})
    high_a, high_b = F.col("_a") >= top, F.col("_b") >= top
    return shares.select(key, ((F.col("_a") + F.col("_b")) / 2).alias("consensus"), F.when(high_a & high_b, "both").when(high_a, "first").when(high_b, "second").otherwise("none").alias("category"))


def peak(rows: DataFrame, low: int, high: int, *keys: str, axis: str = "var_idx") -> DataFrame:
    """Of the window [low, high] of an axis, after its own 5th percentile is taken off: height, position (first on ties), centroid and
    trapezoid area; base: the 5th percentile of all x. A flat window's centroid is its position; a window of fewer than three points has nulls."""
    inside = F.col(axis).between(low, high)
    w = Window.partitionBy(*keys).orderBy(axis)
    back, was = F.col(axis) - F.lag(axis).over(w), F.lag(axis).over(w) >= low
    x, at = F.when(inside, F.col("x")), F.when(inside, F.col(axis))
    found = rows.withColumns({"_step": F.when(inside & was, back * (F.col("x") + F.lag("x").over(w)) / 2), "_wide": F.when(inside & was, back)}).groupBy(*keys).agg(
        F.count(x).alias("_n"), F.percentile(x, F.lit(0.05)).alias("_b"), F.max(x).alias("_m"), F.sum(x * at).alias("_xi"), F.sum(F.when(x.isNotNull(), at)).alias("_i"), F.sum(x).alias("_x"), F.sum("_step").alias("_area"), F.sum("_wide").alias("_wide"),
        F.max(F.when(inside, F.struct(F.col("x"), (-F.col(axis)).alias("i")))).alias("_top"),
        F.percentile("x", F.lit(0.05)).alias("base"),
    )
    b, mass, position = F.col("_b"), F.col("_x") - F.col("_b") * F.col("_n"), -F.col("_top.i")
    enough = lambda c: F.when(F.col("_n") >= 3, c)
    return found.select(
        *keys,
        enough(F.col("_m") - b).alias("height"),
        enough(position).alias("position"),
        enough(F.when(mass > 0, (F.col("_xi") - b * F.col("_i")) / mass).otherwise(position.cast("double"))).alias("centroid"),
        enough(F.col("_area") - b * F.col("_wide")).alias("area"),
        "base",
    )


def noise(df: DataFrame, values: str, n: int, *keys: str, low: int, high: int) -> DataFrame:
    """(keys…, noise, snr): the deviation of the spectrum from its Savitzky-Golay smoothing (11 points, degree 2), and the window's height over its own 5th percentile by it.

    snr is null where the noise is 0. A spectrum is one row; nothing is shuffled.
    """
    both = savgol(df.select(*keys, values, F.col(values).alias("_smooth")), "_smooth", n, 11, 2)
    rest = both.withColumn("noise", arrays.sd_pop(F.zip_with(values, "_smooth", lambda a, b: a - b)))
    window = F.array_sort(F.slice(values, low + 1, high - low + 1))
    at = 0.05 * (high - low)
    under = F.get(window, F.lit(int(at)))
    base = under + (F.get(window, F.lit(min(int(at) + 1, high - low))) - under) * (at - int(at))
    height = F.array_max(window) - base
    return rest.select(*keys, "noise", F.when(F.col("noise") > 0, height / F.col("noise")).alias("snr"))


# ---- partners -----------------------------------------------------------------------------


def partnered(df: DataFrame, key: str, values: str, *keys: str, groups: int = 1024, seed: int = 0) -> DataFrame:
    """Adds partner: the values of the next row by hash, within keys and one of `groups` hash groups (the last takes the first's).

    A permutation of the rows that any task makes again; a hot key is spread over the groups.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    w = Window.partitionBy(*keys, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(groups))).orderBy(h, key)
    return df.withColumn("partner", F.coalesce(F.lead(values).over(w), F.first(values).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def mixup(df: DataFrame, key: str, values: str, label: str, groups: int = 1024, seed: int = 0) -> DataFrame:
    """One simulated row a row: a share of it and the rest of a partner of its class (Zhang et al., 2018), the share fixed by the key."""
    share = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    both = partnered(df, key, values, label, groups=groups, seed=seed).withColumn("share", share)
    mixed = F.zip_with(values, "partner", lambda a, b: F.col("share") * a + (1 - F.col("share")) * b)
    return both.withColumn(values, mixed).drop("partner")


def shifted(df: DataFrame, key: str, values: str, most: int = 3, seed: int = 0) -> DataFrame:
    """Each row's values moved by -most..most places, fixed by the key; ends repeat the edge."""
    by = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2 * most + 1)) - most).cast("int")
    moved = df.withColumn("shift", by)
    at = lambda i: F.greatest(F.lit(0), F.least(F.size(values) - 1, i - F.col("shift")))
    return moved.withColumn(values, F.transform(values, lambda x, i: F.get(F.col(values), at(i))))


def permutation_importance(df: DataFrame, key: str, values: str, target: str, model: Linear, windows: int, groups: int = 1024) -> DataFrame:
    """(win, loss): by how much the mean squared error of a linear model grows when a window's variables come from partners."""
    cuts = np.linspace(0, len(model.mean), windows + 1).astype(int)
    p = len(model.mean)
    weights = np.zeros((p, windows))
    for j in range(windows):
        weights[cuts[j] : cuts[j + 1], j] = model.coef[cuts[j] : cuts[j + 1], 0]

    def run(x: np.ndarray) -> np.ndarray:
        own, other, y = x[:, :p], x[:, p : 2 * p], x[:, -1:]
        error = y - ((own - model.mean) @ model.coef[:, :1] + model.intercept[0])
        return (error - (other - own) @ weights) ** 2 - error**2

    both = partnered(df.where(F.col(target).isNotNull()), key, values, groups=groups)
    joined = F.concat(arrays.doubles(F.col(values)), arrays.doubles(F.col("partner")), F.array(F.col(target).cast("double")))
    lost = map_matrix(both.select(joined.alias("v")), "v", run)
    return lost.select(F.posexplode("v").alias("win", "loss")).groupBy("win").agg(F.avg("loss").alias("loss"))
