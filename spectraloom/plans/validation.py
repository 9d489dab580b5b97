"""Registered queries on fusion, validation, reliability and simulated rows; see registry for the tables' roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.operators import fusion, models, reliability, signal
from spectraloom.plans.modelling import folded
from spectraloom.plans.registry import long, query, rounded, spectra, table


@query()
def m36_m37_fusion(spark, d):
    df = folded(spark, d).withColumns({"a": F.slice("spectrum", 1, 32), "b": F.slice("spectrum", 33, 32)})
    return rounded(fusion.compare(df, "a", "b", "y", "fold"), "rmse", "r2")


@query()
def v7_learning_curve(spark, d):
    return rounded(fusion.learning_curve(folded(spark, d), "spectrum", "y", "vec_id"), "rmse_train", "rmse_test")


@query()
def m40_m42_instruments(spark, d):
    """Four instruments, the later ones with a gain and an offset."""
    inst = F.col("vec_id") % 4
    df = folded(spark, d).withColumn("inst", inst).withColumn("spectrum", F.transform("spectrum", lambda x: x * (1 + 0.02 * F.col("inst")) + 0.05 * F.col("inst")))
    return rounded(fusion.instruments(df, "spectrum", "y", "inst", "fold"), "rmse", "bias")


@query()
def m29_permutation_importance(spark, d):
    df = folded(spark, d)
    model = models.pls(df.where("fold <> 0"), "spectrum", ["y"], 6)
    return rounded(reliability.permutation_importance(df, "vec_id", "spectrum", "y", model, 8, groups=16), "loss")


@query()
def m43_mixup(spark, d):
    return rounded(signal.long_view(reliability.mixup(spectra(spark, d), "vec_id", "spectrum", "label", groups=16), "spectrum", "vec_id", "label"), "x")


@query()
def m43_shift(spark, d):
    return rounded(signal.long_view(reliability.shifted(spectra(spark, d), "vec_id", "spectrum"), "spectrum", "vec_id", "shift"), "x")


_SETS = """WITH {LONG}, m AS (SELECT label AS c, var_idx, avg(x) AS m FROM long GROUP BY 1, 2), q AS (SELECT vec_id, label, c, round(sum((x - m) * (x - m)), 6) AS d2 FROM long JOIN m USING (var_idx) GROUP BY 1, 2, 3),
 cal AS (SELECT c, d2, row_number() OVER (PARTITION BY c ORDER BY d2) AS r, count(*) OVER (PARTITION BY c) AS n FROM q WHERE label = c AND vec_id % 2 = 0),
 t AS (SELECT c, coalesce(min(CASE WHEN r >= ceil((n + 1) * 0.9 - 1e-9) THEN d2 END), 'Infinity'::DOUBLE) AS threshold FROM cal GROUP BY 1)
 SELECT vec_id, count(*) FILTER (d2 <= threshold) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d2 <= threshold), '') AS classes FROM q JOIN t USING (c) WHERE vec_id % 2 = 1 GROUP BY 1"""


@query(_SETS)
def m46_conformal_sets(spark, d):
    """Even rows calibrate, odd ones get sets; the score is the squared distance from a class's mean."""
    rows = long(spark, d)
    m = rows.groupBy(F.col("label").alias("c"), "var_idx").agg(F.avg("x").alias("m"))  # classes x variables, whatever the number of rows
    q = rows.join(F.broadcast(m), "var_idx").groupBy("vec_id", "label", "c").agg(F.round(F.sum((F.col("x") - F.col("m")) ** 2), 6).alias("d2"))
    limits = reliability.class_thresholds(q.where("label = c AND vec_id % 2 = 0"), "c", "d2", 0.1)
    sets = reliability.conformal_sets(q.where("vec_id % 2 = 1"), "vec_id", "c", "d2", limits)
    return sets.select("vec_id", F.size("classes").cast("long").alias("size"), F.array_join(F.transform("classes", lambda c: c.cast("string")), ",").alias("classes"))


@query("""WITH {LONG}, s AS (SELECT *, (var_idx - lag(var_idx) OVER w) * (x + lag(x) OVER w) / 2 AS step, lag(var_idx) OVER w AS was FROM long WINDOW w AS (PARTITION BY vec_id ORDER BY var_idx)),
 g AS (SELECT vec_id, quantile_cont(x, 0.05) AS b, max(x) AS m, arg_max(var_idx, (x, -var_idx)) AS position, sum(x * var_idx) AS xi, sum(var_idx) AS i, sum(x) AS x, count(*) AS n, sum(step) FILTER (was >= 20) AS area FROM s WHERE var_idx BETWEEN 20 AND 40 GROUP BY 1), q AS (SELECT vec_id, quantile_cont(x, 0.05) AS base FROM s GROUP BY 1)
 SELECT vec_id, round(m - b, 6) AS height, CAST(position AS INTEGER) AS position, round((xi - b * i) / (x - b * n), 5) AS centroid, round(area - b * 20, 6) AS area, round(base, 6) AS base FROM g JOIN q USING (vec_id)""")
def m51_peak_metrics(spark, d):
    return rounded(reliability.peak(long(spark, d), 20, 40, "vec_id"), "height", "area", "base").withColumn("centroid", F.round("centroid", 5))


@query("SELECT o_totalprice AS price, round(sum(n) OVER (ORDER BY o_totalprice), 0) AS upto FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)")
def w15_running_counts(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_totalprice").alias("price")).agg(F.count("*").alias("n"))
    return reliability.cumulative(counts, "price", ["n"]).select("price", F.col("upto_n").cast("double").alias("upto"))
