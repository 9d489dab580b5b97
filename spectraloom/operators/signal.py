"""Pretreatments that need all rows (fitted) or a matrix (Arrow), on (id, …, x) long rows or array columns.

Fitted state is a small table by variable, joined by broadcast: its rows are the variables, whose
number is the width of one spectrum and does not grow with the samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import arrays


def long_view(df: DataFrame, values: str, *keep: str) -> DataFrame:
    """(keep…, var_idx, x): one row a sample and variable."""
    return df.select(*keep, F.posexplode(arrays.doubles(F.col(values))).alias("var_idx", "x"))


def autoscale(rows: DataFrame) -> DataFrame:
    """Adds z: centred and scaled to population deviation 1 by variable."""
    fit = rows.groupBy("var_idx").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return rows.join(F.broadcast(fit), "var_idx").withColumn("z", (F.col("x") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).drop("m", "s")


def msc(rows: DataFrame, key: str) -> DataFrame:
    """Multiplicative scatter correction (Geladi, 1985): (key, slope, intercept) of each row on the mean spectrum."""
    ref = rows.groupBy("var_idx").agg(F.avg("x").alias("ref"))
    return rows.join(F.broadcast(ref), "var_idx").groupBy(key).agg(F.regr_slope("x", "ref").alias("slope"), F.regr_intercept("x", "ref").alias("intercept"))


def msc_apply(rows: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    slope = F.when(F.abs("slope") < 1e-12, F.lit(1e-12)).otherwise(F.col("slope"))
    return rows.join(fit, key).withColumn("x", (F.col("x") - F.col("intercept")) / slope).drop("slope", "intercept")


def pqn(rows: DataFrame, key: str) -> DataFrame:
    """Probabilistic quotient normalisation (Dieterle, 2006): (key, quotient), the median of x / reference over variables."""
    ref = rows.groupBy("var_idx").agg(F.median("x").alias("ref"))
    q = F.when(F.abs("ref") > 1e-12, F.col("x") / F.col("ref"))
    return rows.join(F.broadcast(ref), "var_idx").groupBy(key).agg(F.median(q).alias("quotient"))


def bucket(rows: DataFrame, width: float, *keys: str, axis: str = "var_idx") -> DataFrame:
    """Sum in bins of an axis, from its least value on: (keys…, bin, centre, x). An empty bin has sum 0 and its middle as centre.

    Axis points are those of the rows, whose number is one spectrum's; a width beyond the axis' range is an error.
    """
    points = rows.select(F.col(axis).cast("double").alias("at")).distinct().agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    if points["low"] is not None and width > points["high"] - points["low"]:
        raise ValueError("a bin is wider than the axis")
    bin_of = F.floor((F.col(axis) - F.lit(points["low"])) / width)
    sums = rows.withColumn("bin", bin_of).groupBy(*keys, "bin").agg(F.avg(axis).alias("centre"), F.sum("x").alias("x"))
    full = rows.select(bin_of.alias("bin")).distinct().count()
    last = int((points["high"] - points["low"]) // width) + 1 if points["low"] is not None else 0
    if full == last:
        return sums
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(rows.sparkSession.range(last).select(F.col("id").alias("bin"))))  # bins of one spectrum
    middle = F.lit(points["low"]) + (F.col("bin") + 0.5) * width
    return grid.join(sums, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("centre", middle).alias("centre"), F.coalesce("x", F.lit(0.0)).alias("x"))


def block_scale(rows: DataFrame, kind: str) -> DataFrame:
    """Adds z by variable, with sample deviations: none, center, auto, pareto, range, level or robust (median, MAD)."""
    fit = rows.groupBy("var_idx").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.median("x").alias("md"))
    if kind == "robust":
        mad = rows.join(F.broadcast(fit), "var_idx").groupBy("var_idx").agg((1.4826 * F.median(F.abs(F.col("x") - F.col("md")))).alias("mad"))
        fit = fit.join(mad, "var_idx")
    centre, scale = {
        "none": (F.lit(0.0), F.lit(1.0)), "center": (F.col("m"), F.lit(1.0)), "auto": (F.col("m"), F.col("s")), "pareto": (F.col("m"), F.sqrt("s")),
        "range": (F.col("m"), F.col("hi") - F.col("lo")), "level": (F.col("m"), F.abs("m")), "robust": (F.col("md"), F.col("mad") if kind == "robust" else F.lit(1.0)),
    }[kind]
    out = rows.join(F.broadcast(fit), "var_idx")
    return out.withColumn("z", (F.col("x") - centre) / F.when(F.coalesce(scale, F.lit(0.0)) == 0, 1.0).otherwise(scale)).select(*rows.columns, "z")


def block_norm(rows: DataFrame, key: str) -> DataFrame:
    """One row: n, the Frobenius norm and norm / sqrt(n)."""
    return rows.agg(F.countDistinct(key).alias("n"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("frobenius")).withColumn("scale", F.col("frobenius") / F.sqrt("n"))


def block_mean(rows: DataFrame, spatial: int, spectral: int, height: int, width: int, bands: int, *keys: str) -> DataFrame:
    """Cube reduction: by keys, means of spatial x spatial x spectral blocks; what does not fill a block is dropped."""
    inside = rows.where((F.col("row") < height // spatial * spatial) & (F.col("col") < width // spatial * spatial) & (F.col("var_idx") < bands // spectral * spectral))
    return inside.groupBy(*keys, F.floor(F.col("row") / spatial).alias("row"), F.floor(F.col("col") / spatial).alias("col"), F.floor(F.col("var_idx") / spectral).alias("var_idx")).agg(F.avg("x").alias("x"))


def window_of(index: Column, n_vars: int, n_windows: int, rule: str = "linspace") -> Column:
    """Window of a 0-based variable: cuts at floor(k * p / n) (linspace), or the first p mod n windows one longer (split)."""
    if rule == "linspace":
        return F.floor(((index + 1) * n_windows - 1) / F.lit(n_vars))
    short, longer = divmod(n_vars, n_windows)
    edge = longer * (short + 1)
    return F.when(index < edge, F.floor(index / (short + 1))).otherwise(longer + F.floor((index - edge) / F.lit(max(short, 1))))


def decimate(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Least and largest value of each block of `size` variables, with their places (the first of equals)."""
    block = rows.withColumn("block", F.floor(F.col("var_idx") / size))
    return block.groupBy(*keys, "block").agg(F.min(F.struct("x", "var_idx")).alias("lo"), F.max(F.struct("x", (-F.col("var_idx")).alias("i"))).alias("hi")).select(*keys, "block", F.col("lo.x").alias("lo"), F.col("lo.var_idx").alias("lo_at"), F.col("hi.x").alias("hi"), (-F.col("hi.i")).alias("hi_at"))


def smooth3(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds `smooth`: the mean of a value and its neighbours, the ends repeating themselves."""
    w = Window.partitionBy(*keys).orderBy("var_idx")
    before, after = (F.coalesce(f("x").over(w), F.col("x")) for f in (F.lag, F.lead))
    return rows.withColumn("smooth", (before + F.col("x") + after) / 3)


def high_regions(rows: DataFrame, *keys: str, share: float = 0.75, top: int = 15) -> DataFrame:
    """(keys…, first, last, n, peak, height, place): runs of variables whose smoothed x reaches its quantile, the `top` highest peaks.

    A quantile and a window per key see one spectrum; peak is the first of equals.
    """
    keyed = list(keys)
    smooth = smooth3(rows, *keys)
    cut = smooth.groupBy(*keyed).agg(F.percentile("smooth", F.lit(share)).alias("_cut"))
    high = smooth.join(cut, keyed).where(F.col("smooth") >= F.col("_cut"))
    at = F.row_number().over(Window.partitionBy(*keyed).orderBy("var_idx"))
    runs = high.withColumn("_run", F.col("var_idx") - at)
    highest = F.max(F.struct("smooth", (-F.col("var_idx")).alias("i")))
    found = runs.groupBy(*keyed, "_run").agg(F.min("var_idx").alias("first"), F.max("var_idx").alias("last"), F.count("*").alias("n"), highest.alias("_top"))
    place = F.row_number().over(Window.partitionBy(*keyed).orderBy(F.desc("_top.smooth"), "first"))
    return found.withColumn("place", place).where(F.col("place") <= top).select(*keyed, "first", "last", "n", (-F.col("_top.i")).alias("peak"), F.col("_top.smooth").alias("height"), "place")


def running_median(rows: DataFrame, half: int, *keys: str) -> DataFrame:
    """Adds `median`: of 2 * half + 1 neighbours, zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy("var_idx").rowsBetween(-half, half)
    near = F.collect_list("x").over(w)
    full = F.concat(near, F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size(near)))
    return rows.withColumn("median", F.element_at(F.array_sort(full), half + 1))


def _local(i: Column, x: Column, s: Column) -> Column:
    """Prominence of position i (from 0) of s, at value x: its height over the higher of the two lowest points before something higher or an end."""

    def lowest(side: Column) -> Column:
        start = F.struct(F.lit(True).alias("open"), x.alias("low"))
        step = lambda a, v: F.when(a["open"] & (v <= x), F.struct(F.lit(True).alias("open"), F.least(a["low"], v).alias("low"))).otherwise(F.struct(F.lit(False).alias("open"), a["low"].alias("low")))
        return F.aggregate(side, start, step, lambda a: a["low"])

    return x - F.greatest(lowest(F.reverse(F.slice(s, F.lit(1), i))), lowest(F.slice(s, i + 2, F.size(s))))


def peaks(df: DataFrame, values: str, *keys: str, share: float = 0.05, top: int = 10) -> DataFrame:
    """(keys…, position, height, prominence, place): the `top` highest maxima of the smoothed values, equals by position.

    A maximum is above both neighbours and its prominence at least `share` of the largest smoothed value. Without any, the
    first largest value is given with a null prominence. Null and empty arrays give no row. No shuffle: an array is one row's,
    and its work is maxima x points, so noisy arrays of tens of thousands of points should be smoothed or cut first.
    """
    x, last = F.col(values), F.size(values) - 1
    smooth = F.transform(x, lambda v, i: (F.get(x, F.greatest(i - 1, F.lit(0))) + v + F.get(x, F.least(i + 1, last))) / 3)
    rows = df.where(F.size(values) > 0).select(*keys, smooth.alias("_s"))
    s = F.col("_s")
    placed = F.transform(s, lambda v, i: F.struct(i.alias("position"), v.alias("height")))
    maxima = F.filter(placed, lambda p: (p["height"] > F.get(s, p["position"] - 1)) & (p["height"] > F.get(s, p["position"] + 1)))
    judged = F.transform(maxima, lambda p: F.struct((-p["height"]).alias("_h"), p["position"].alias("position"), _local(p["position"], p["height"], s).alias("prominence")))
    high = F.slice(F.array_sort(F.filter(judged, lambda p: p["prominence"] >= share * F.array_max(s))), 1, top)
    first = F.struct((-F.array_max(s)).alias("_h"), (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("position"), F.lit(None).cast("double").alias("prominence"))
    found = rows.select(*keys, high.alias("_p"), first.alias("_f")).select(*keys, F.posexplode(F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.array("_f"))).alias("place", "p"))
    return found.select(*keys, "p.position", (-F.col("p._h")).alias("height"), "p.prominence", (F.col("place") + 1).alias("place"))


def centred_by(rows: DataFrame, group: str) -> DataFrame:
    """Long rows with each group's mean of a variable taken off; groups are few, so that the means are groups x variables."""
    means = rows.groupBy(group, "var_idx").agg(F.avg("x").alias("_m"))
    return rows.join(means, [group, "var_idx"]).withColumn("x", F.col("x") - F.col("_m")).drop("_m")


# ---- matrices: Arrow-batched NumPy ------------------------------------------------------------


def map_matrix(df: DataFrame, values: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with its array column replaced by f of the batch's matrix (rows are samples of equal length)."""

    @F.pandas_udf("array<double>")
    def run(c: pd.Series) -> pd.Series:
        if not len(c):
            return c
        return pd.Series(list(f(np.stack([np.asarray(v, np.float64) for v in c.to_list()]))))

    return df.withColumn(values, run(F.col(values)))


def savgol_matrix(n: int, width: int, degree: int, order: int = 0) -> np.ndarray:
    """n x n operator of the Savitzky-Golay filter (1964): local polynomial fits, the first and last fit serving the ends."""
    if width % 2 == 0 or width > n or degree >= width:
        raise ValueError("the width must be odd, at most the number of variables and above the degree")
    half, out = width // 2, np.zeros((n, n))
    factor = float(np.prod(np.arange(1, order + 1)))
    for i in range(n):
        centre = min(max(i, half), n - 1 - half)
        near = np.arange(centre - half, centre + half + 1)
        basis = np.vander(near - i, degree + 1, increasing=True).astype(float)
        out[i, near] = np.linalg.pinv(basis)[order] * factor if order <= degree else 0.0
    return out


def savgol(df: DataFrame, values: str, n: int, width: int = 7, degree: int = 2, order: int = 0) -> DataFrame:
    """The filter of savgol_matrix(n, …) by its width coefficients and the fits of both ends, whatever the number of variables."""
    if width > n:
        raise ValueError("the width must be odd, at most the number of variables and above the degree")
    own, half = savgol_matrix(width, width, degree, order), width // 2

    def f(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[:, half : n - half] = sum(own[half, k] * x[:, k : n - width + 1 + k] for k in range(width))
        out[:, :half] = x[:, :width] @ own[:half].T
        out[:, n - half :] = x[:, n - width :] @ own[half + 1 :].T
        return out

    return map_matrix(df, values, f)


def emsc(df: DataFrame, values: str, reference: np.ndarray, degree: int = 2) -> DataFrame:
    """Extended scatter correction (Martens & Stark, 1991): fit [1, ref, t, t^2…], remove all but the reference's part, divide by its slope."""
    t = np.linspace(-1, 1, len(reference))
    basis = np.stack([np.ones_like(t), reference, *[t**k for k in range(1, degree + 1)]], axis=1)
    solve = np.linalg.pinv(basis)

    def f(x: np.ndarray) -> np.ndarray:
        coef = x @ solve.T
        slope = np.where(np.abs(coef[:, 1]) < 1e-8, 1.0, coef[:, 1])
        other = np.delete(basis, 1, axis=1)
        return (x - np.delete(coef, 1, axis=1) @ other.T) / slope[:, None]

    return map_matrix(df, values, f)


def solve_pentadiagonal(d: np.ndarray, e: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solutions of symmetric pentadiagonal systems, one a row: diagonals d (rows x n), e (n - 1) and f (n - 2), by L D L'."""
    n = d.shape[1]
    a, u, v, z = np.empty_like(d), np.zeros_like(d), np.zeros_like(d), np.empty_like(d)
    for i in range(n):
        own, low, right = d[:, i], e[i] if i < n - 1 else 0.0, y[:, i]
        if i >= 1:
            own = own - a[:, i - 1] * u[:, i - 1] ** 2
            low = low - a[:, i - 1] * u[:, i - 1] * v[:, i - 1]
            right = right - u[:, i - 1] * z[:, i - 1]
        if i >= 2:
            own = own - a[:, i - 2] * v[:, i - 2] ** 2
            right = right - v[:, i - 2] * z[:, i - 2]
        a[:, i], z[:, i] = own, right
        u[:, i] = low / own
        v[:, i] = f[i] / own if i < n - 2 else 0.0
    x = z / a
    for i in range(n - 2, -1, -1):
        x[:, i] -= u[:, i] * x[:, i + 1]
        if i < n - 2:
            x[:, i] -= v[:, i] * x[:, i + 2]
    return x


def als_baseline(df: DataFrame, values: str, smooth: float = 1e5, p: float = 0.01, rounds: int = 10) -> DataFrame:
    """x minus its asymmetric-least-squares baseline (Eilers & Boelens, 2005); the systems of a batch are solved together, band by band."""

    def f(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n < 3:
            return np.zeros_like(x)
        second = np.array([1.0, -2.0, 1.0])
        bands = np.zeros((3, n))  # of D'D, where D takes second differences
        for i in range(n - 2):
            for k in range(3):
                bands[k, i : i + 3 - k] += second[: 3 - k] * second[k:]
        w = np.ones_like(x)
        for _ in range(rounds):
            z = solve_pentadiagonal(w + smooth * bands[0], smooth * bands[1, : n - 1], smooth * bands[2, : n - 2], w * x)
            w = np.where(x > z, p, 1 - p)
        return x - z

    return map_matrix(df, values, f)


def despike(df: DataFrame, values: str, half: int = 3, limit: float = 6.0) -> DataFrame:
    """Values whose modified z-score against the running median exceeds the limit become that median.

    Where the median deviation is 0, the mean deviation stands in for it.
    """

    def f(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (half, half)))
        med = np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=1), axis=2)
        d = x - med
        off = np.abs(d - np.median(d, axis=1, keepdims=True))
        mad, mean = np.median(off, axis=1, keepdims=True), off.mean(1, keepdims=True)
        scale = np.where(mad > 0, mad / 0.6745, 1.2533 * mean)
        z = d / np.where(scale > 0, scale, np.inf)
        return np.where(np.abs(z) > limit, med, x)

    return map_matrix(df, values, f)


def interpolate(df: DataFrame, values: str, axis: np.ndarray, target: np.ndarray) -> DataFrame:
    """Linear interpolation to another axis, clamped at the ends; adds `outside`, whether the target exceeds the axis."""
    order = np.argsort(axis)
    out = map_matrix(df, values, lambda x: np.stack([np.interp(target, axis[order], y[order]) for y in x]))
    return out.withColumn("outside", F.lit(bool(target.min() < axis.min() or target.max() > axis.max())))


def align(df: DataFrame, values: str, reference: np.ndarray, cuts: list[int], most: int = 8) -> DataFrame:
    """Interval alignment (Savorani, 2010): each interval moves by the shift that correlates best with the reference; the smallest of equals."""

    def f(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 3:
                continue
            ref = reference[a:b] - reference[a:b].mean()
            best = np.full(len(x), -np.inf)
            for s in sorted(range(-most, most + 1), key=lambda s: (abs(s), s)):
                at = np.clip(np.arange(a, b) - s, a, b - 1)
                y = x[:, at] - x[:, at].mean(1, keepdims=True)
                r = y @ ref / np.maximum(np.linalg.norm(y, axis=1) * np.linalg.norm(ref), 1e-12)
                better = r > best + 1e-12
                best = np.where(better, r, best)
                out[better, a:b] = x[better][:, at]
        return out

    return map_matrix(df, values, f)


def without_groups(df: DataFrame, values: str, group: str, tolerance: float = 1e-9) -> DataFrame:
    """Spectra without the directions in which the groups' means differ: external parameter orthogonalisation (Roger, 2003).

    The driver sees one mean a group (instruments: few) and decomposes them; one group changes nothing.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    means = df.where(F.col(group).isNotNull()).groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(values))).alias("m")).orderBy(group).collect()
    if len(means) < 2:
        return df
    m = np.stack([r["m"].toArray() for r in means])
    _, size, axes = np.linalg.svd(m - m.mean(0), full_matrices=False)
    axes = axes[size > tolerance * max(size[0], 1e-300)]
    return map_matrix(df, values, lambda x: x - (x @ axes.T) @ axes)
