"""Non-linear importance by windows of neighbouring variables: forests that a window is scrambled for, and mutual information."""

from __future__ import annotations

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators import catalogue, kernels, models
from spectraloom.operators.relational import cumulative, in_ranges
from spectraloom.operators.reliability import partnered

#: Rows among which a window's values change places.
GROUP = 4096
#: Distinct values of a class that one task holds in order.
BLOCK = 65_536


def cuts(p: int, n: int) -> list[tuple[int, int]]:
    """First and end of up to n windows of about the same width, 2 at least."""
    at = np.linspace(0, p, max(2, min(n, p)) + 1).astype(int)
    return [(int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def means(df: DataFrame, values: str, windows: list[tuple[int, int]], *keep: str) -> DataFrame:
    """A row a window: keep…, win and x, the mean of the window's values."""
    mean = F.array(*[arrays.mean(F.slice(values, a + 1, b - a)) for a, b in windows])
    return df.select(*keep, F.posexplode(mean).alias("win", "x"))


# ---- forests ------------------------------------------------------------------------------


def _scrambled(test: DataFrame, key: str, values: str, windows: list[tuple[int, int]], repeats: int, seed: int) -> DataFrame:
    """Each row as it is (win -1), and once a window and repeat with that window's values from another row."""
    groups = max(1, test.count() // GROUP)
    lo, hi = (F.array(*[F.lit(w[i]) for w in windows]) for i in (0, 1))
    out = test.withColumns({"win": F.lit(-1), "turn": F.lit(0)})
    for turn in range(repeats):
        other = partnered(test, key, values, groups=groups, seed=seed + 31 * turn)
        wide = other.withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(len(windows) - 1)))).withColumns({"_lo": F.get(lo, F.col("win")), "_hi": F.get(hi, F.col("win"))})
        mixed = F.zip_with(F.zip_with(values, "partner", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.sequence(F.lit(0), F.size(values) - 1), lambda v, i: F.when((i >= F.col("_lo")) & (i < F.col("_hi")), v["b"]).otherwise(v["a"]))
        out = out.unionAll(wide.withColumns({values: mixed, "turn": F.lit(turn)}).select(out.columns))
    return out


def forest_importance(df: DataFrame, key: str, values: str, target: str, fold: str, windows: list[tuple[int, int]], classify: bool, trees: int = 150, depth: int = 15, repeats: int = 2, seed: int = 0) -> tuple[DataFrame, float, np.ndarray]:
    """(win, loss, importance), the held-out error, and each variable's impurity importance, largest 1.

    For each fold a forest learns from the others; loss is by how much its error on the fold grows when a window's values
    come from other rows of the fold, averaged over repeats and folds, 0 at least. The error is the squared one, for classes summed
    over their probabilities (Brier, 1950). Rows without a target, fold or values are left out; keys must be distinct.
    """
    rows = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull() & F.col(values).isNotNull()).select(key, F.col(fold).alias("_fold"), target, arrays.doubles(F.col(values)).alias(values))
    if classify:
        rows = rows.withColumn("_y", F.col(target).cast("string"))
        rows = StringIndexer(inputCol="_y", outputCol="_t", stringOrderType="alphabetAsc").fit(rows).transform(rows).drop("_y")
        forest = C.RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", labelCol="_t", featuresCol="_x", seed=seed)
        share = vector_to_array("probability")
        error = F.aggregate(F.zip_with(share, F.sequence(F.lit(0), F.size(share) - 1), lambda s, i: F.pow(s - (i == F.col("_t")).cast("double"), 2)), F.lit(0.0), lambda a, b: a + b)
    else:
        rows = rows.withColumn("_t", F.col(target).cast("double"))
        forest = R.RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.2", labelCol="_t", featuresCol="_x", seed=seed)
        error = F.pow(F.col("prediction") - F.col("_t"), 2)
    x = array_to_vector(values)
    every = None
    names = [r[0] for r in rows.select("_fold").distinct().orderBy("_fold").collect()]
    for name in names:
        model = forest.fit(rows.where(F.col("_fold") != F.lit(name)).withColumn("_x", x))
        judged = model.transform(_scrambled(rows.where(F.col("_fold") == F.lit(name)), key, values, windows, repeats, seed).withColumn("_x", x))
        part = judged.groupBy("win").agg(F.avg(error).alias("error")).withColumn("_fold", F.lit(str(name)))
        every = part if every is None else every.unionAll(part)
    if every is None:
        return df.sparkSession.createDataFrame([], "win int, loss double, importance double"), float("nan"), np.zeros(0)
    got = every.collect()  # folds x windows rows
    base = {r["_fold"]: r.error for r in got if r.win == -1}
    lost = np.zeros(len(windows))
    for r in got:
        if r.win >= 0:
            lost[r.win] += (r.error - base[r["_fold"]]) / len(names)
    lost = np.maximum(lost, 0)
    whole = forest.fit(rows.withColumn("_x", x)).featureImportances.toArray()
    table = [(i, float(v), float(v / (lost.max() or 1))) for i, v in enumerate(lost)]
    return df.sparkSession.createDataFrame(table, "win int, loss double, importance double"), sum(base.values()) / len(base), whole / (whole.max() or 1)


def by_window(variables: np.ndarray, windows: list[tuple[int, int]]) -> list[float]:
    """Means of a curve over variables inside each window."""
    return [float(variables[a:b].mean()) for a, b in windows]


# ---- mutual information ---------------------------------------------------------------------


def digamma(n: Column) -> Column:
    """The digamma function of numbers from 1: its asymptotic series at n + 6, taken back by the recurrence."""
    z = n.cast("double") + 6
    tail = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10)
    return tail - sum((1 / (n + i) for i in range(1, 6)), 1 / n.cast("double"))


def between(points: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """(who, inside): the sum of n over points (keys…, at, n) with lo < at < hi, or, where lo = hi, of those there; queries: keys…, lo, hi, who (distinct).

    Points and both ends of each query are put in order together, in ranges of about equal size, so no task sees a key's points whole.
    """
    tied = F.col("lo") == F.col("hi")
    low = queries.select(*keys, F.col("lo").alias("at"), F.when(tied, 0).otherwise(2).alias("_kind"), F.lit(0).cast("long").alias("n"), "who", F.lit(-1).alias("_sign"))
    high = queries.select(*keys, F.col("hi").alias("at"), F.when(tied, 2).otherwise(0).alias("_kind"), F.lit(0).cast("long").alias("n"), "who", F.lit(1).alias("_sign"))
    mine = points.select(*keys, "at", F.lit(1).alias("_kind"), "n", F.lit(None).cast(queries.schema["who"].dataType).alias("who"), F.lit(0).alias("_sign"))
    ranged = in_ranges(mine.unionAll(low).unionAll(high), "at")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sums.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_part").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.join(base, [*keys, "_part"]).withColumn("upto", F.col("_base") + F.sum("n").over(inner)).where(F.col("_sign") != 0)
    return counted.groupBy("who").agg(F.sum(F.col("_sign") * F.col("upto")).alias("inside"))


def mutual_information(rows: DataFrame, label: str, k: int = 3) -> DataFrame:
    """(win, mi): mutual information in nats of x and the class, by distances to the k-th neighbour of the own class (Ross, 2014).

    rows: win, x and label. Rows without x or label and the rows of classes with one row are left out; a window with none left has no row. Equal values
    are neighbours at distance 0, whose row counts its ties alone. 0 at least.
    """
    own = rows.where(F.col("x").isNotNull() & F.col(label).isNotNull()).select("win", F.col(label).alias("_c"), F.col("x").cast("double").alias("at"))
    distinct = own.groupBy("win", "_c", "at").agg(F.count("*").alias("n"))
    size = distinct.groupBy("win", "_c").agg(F.sum("n").alias("size")).where("size > 1")
    distinct = distinct.join(size, ["win", "_c"])
    # neighbours in order: blocks of distinct values with k of both neighbouring blocks
    numbered = cumulative(distinct.withColumn("one", F.lit(1)), "at", ["one"], "win", "_c").withColumn("r", F.col("upto_one") - 1)
    block, place = F.floor(F.col("r") / BLOCK), F.col("r") % BLOCK
    copies = F.filter(F.array(block, F.when(place < k, block - 1), F.when(place >= BLOCK - k, block + 1)), lambda b: b.isNotNull())
    spread = numbered.withColumns({"_home": block, "_block": F.explode(copies)})
    w = Window.partitionBy("win", "_c", "_block").orderBy("at")
    near = [F.struct(F.abs(f("at", i).over(w) - F.col("at")).alias("d"), f("at", i).over(w).alias("v"), f("n", i).over(w).alias("n")) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    spread = spread.withColumn("near", F.array_sort(F.filter(F.array(F.struct(F.lit(0.0).alias("d"), F.col("at").alias("v"), (F.col("n") - 1).alias("n")), *near), lambda s: s["d"].isNotNull()))).where("_block = _home")
    want = F.least(F.lit(k), F.col("size") - 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
    found = F.aggregate("near", start, lambda a, s: F.when(a["seen"] >= want, a).otherwise(F.struct((a["seen"] + s["n"]).alias("seen"), s["v"].alias("v"))))["v"]
    # the far end lies as far beyond the row as the neighbour on the other side; the neighbour itself is outside
    reach = spread.select("win", "_c", "at", "n", "size", want.alias("k"), found.alias("v"))
    asked = reach.select("win", F.least("v", 2 * F.col("at") - F.col("v")).alias("lo"), F.greatest("v", 2 * F.col("at") - F.col("v")).alias("hi"), F.struct("win", "_c", "at", "n", "size", "k").alias("who"))
    counted = between(distinct.groupBy("win", "at").agg(F.sum("n").alias("n")), asked, "win").select("who.*", "inside")
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    mi = digamma(F.sum("n")) + mean(digamma(F.col("k"))) - mean(digamma(F.col("size"))) - mean(digamma(F.col("inside")))
    return counted.groupBy("win").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


# ---- linear against non-linear ------------------------------------------------------------


def compared(df: DataFrame, values: str, target: str, fold: str, classify: bool, components: int = 5) -> DataFrame:
    """(model, kind, score): PLS, forest and support vector machine on the same folds; mean recall over classes, or Q2, of all held-out predictions.

    Rows without a target or fold are left out.
    """
    rows = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    names = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    out = []
    for model, kind in (("pls", "linear"), ("forest", "non-linear"), ("svm", "non-linear")):
        held = None
        for name in names:
            train, test = rows.where(F.col(fold) != F.lit(name)), rows.where(F.col(fold) == F.lit(name))
            if model == "forest":
                part = (catalogue.classify if classify else catalogue.regress)(train, test, values, target, "forest").select(F.col(target).cast("string" if classify else "double").alias("y"), "yhat")
            elif classify:
                part = models.classify(test, values, *(models.pls_da(train, values, target, components) if model == "pls" else kernels.svc(train, values, target))).select(F.col(target).cast("string").alias("y"), F.col("yhat").cast("string").alias("yhat"))
            else:
                machine = models.pls(train, values, [target], components) if model == "pls" else kernels.svr(train, values, target)
                part = machine.scores(test, values).select(F.col(target).cast("double").alias("y"), F.col("yhat")[0].alias("yhat"))
            held = part if held is None else held.unionAll(part)
        if classify:
            score = held.groupBy("y").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("recall")).agg(F.avg("recall")).first()[0]
        else:
            r = held.agg(F.sum((F.col("y") - F.col("yhat")) ** 2).alias("e"), (F.var_pop("y") * F.count("y")).alias("s")).first()
            score = 1 - r.e / r.s if r.s else None
        out.append((model, kind, score))
    return df.sparkSession.createDataFrame(out, "model string, kind string, score double")
