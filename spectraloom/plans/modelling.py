"""Registered queries on models, transfer, augmentation and comparisons; see registry for the tables' roles."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators import blocks, catalogue, models, signal, stats
from spectraloom.plans.registry import long, query, rounded, spectra, table


def folded(spark, d) -> DataFrame:
    """Spectra with a target y made of three of their variables, in five folds."""
    y = F.element_at("spectrum", 1) + 0.5 * F.element_at("spectrum", 9) - F.element_at("spectrum", 33)
    return models.folds(spectra(spark, d).withColumn("y", y), "vec_id", 5)


# ---- small relational ones ----------------------------------------------------------------


@query("WITH {LONG} SELECT var_idx, round(stddev_pop(x), 6) AS sd FROM long GROUP BY 1 HAVING avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END) <= 0.2 AND stddev_pop(x) > 1e-12")
def p7_p8_variable_filter(spark, d):
    rows = long(spark, d).groupBy("var_idx").agg(F.avg(F.isnull("x").cast("int")).alias("missing"), F.stddev_pop("x").alias("sd"))
    return rounded(rows.where("missing <= 0.2 AND sd > 1e-12").select("var_idx", "sd"), "sd")


@query("WITH {LONG} SELECT vec_id, var_idx, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, var_idx) AS r FROM long) WHERE r <= 10")
def t2_top_variables(spark, d):
    w = Window.partitionBy("vec_id").orderBy(F.abs("x").desc(), "var_idx")
    return rounded(long(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("vec_id", "var_idx", "x"), "x")


@query("SELECT c_custkey, round((rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0) / count(*) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer")
def w9_average_rank(spark, d):
    share = stats.average_rank(F.col("c_acctbal"), "c_nationkey") / F.count("*").over(Window.partitionBy("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", F.round(share, 6).alias("share"))


@query("WITH {LONG}, v AS (SELECT var_idx, var_pop(x) AS v FROM long GROUP BY 1) SELECT var_idx, round(sum(v) OVER (ORDER BY v DESC, var_idx ROWS UNBOUNDED PRECEDING) / sum(v) OVER (), 6) AS upto FROM v")
def w15_cumulative_variance(spark, d):
    v = long(spark, d).groupBy("var_idx").agg(F.var_pop("x").alias("v"))  # a row a variable
    upto = F.sum("v").over(Window.orderBy(F.desc("v"), "var_idx").rowsBetween(Window.unboundedPreceding, 0))
    return v.select("var_idx", F.round(upto / F.sum("v").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6).alias("upto"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, 1500 * l_quantity AS h FROM lineitem), e AS (SELECT sqrt(avg((y - h) * (y - h))) AS rmse FROM p) SELECT l_orderkey, l_linenumber, round(y - h, 2) AS residual, round(h - 1.96 * rmse, 4) AS lo, round(h + 1.96 * rmse, 4) AS hi FROM p, e")
def k5_m49_residual_interval(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("h"))
    e = p.agg(F.sqrt(F.avg((F.col("y") - F.col("h")) ** 2)).alias("rmse"))
    both = p.crossJoin(F.broadcast(e))  # one row
    return both.select("l_orderkey", "l_linenumber", F.round(F.col("y") - F.col("h"), 2).alias("residual"), F.round(F.col("h") - 1.96 * F.col("rmse"), 4).alias("lo"), F.round(F.col("h") + 1.96 * F.col("rmse"), 4).alias("hi"))


@query("WITH p AS (SELECT (l_quantity > 25) = (l_returnflag = 'R') AS a, (l_extendedprice > 38000) = (l_returnflag = 'R') AS b FROM lineitem), n AS (SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM p) SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN power(abs(only_a - only_b) - 1.0, 2) / (only_a + only_b) END, 6) AS chi2 FROM n")
def v8_mcnemar(spark, d):
    flag = F.col("l_returnflag") == "R"
    return rounded(models.mcnemar(table(spark, d, "lineitem"), (F.col("l_quantity") > 25) == flag, (F.col("l_extendedprice") > 38000) == flag), "chi2")


@query("WITH e AS (SELECT power(l_extendedprice - 1500 * l_quantity, 2) - power(l_extendedprice - 1450 * l_quantity, 2) AS e FROM lineitem) SELECT count(*) AS n, round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 4) AS t FROM e")
def v9_paired_t(spark, d):
    y, q = F.col("l_extendedprice"), F.col("l_quantity")
    return rounded(models.paired_t(table(spark, d, "lineitem"), (y - 1500 * q) ** 2 - (y - 1450 * q) ** 2), "t", digits=4)


@query("SELECT o_custkey AS custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u7_complement(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    return orders.select("custkey").subtract(orders.where("o_orderstatus = 'F'").select("custkey"))


# ---- models -------------------------------------------------------------------------------


def _classifier(name: str, kind: str):
    def run(spark, d):
        df = folded(spark, d).withColumn("label", F.col("label").cast("string")).withColumnRenamed("label", "y_class")
        return catalogue.classify(df.where("fold <> 0"), df.where("fold = 0"), "spectrum", "y_class", kind).select("vec_id", "y_class", "yhat")

    run.__name__ = name
    query()(run)


def _regressor(name: str, kind: str):
    def run(spark, d):
        df = folded(spark, d).drop("label")
        return rounded(catalogue.regress(df.where("fold <> 0"), df.where("fold = 0"), "spectrum", "y", kind).select("vec_id", "y", "yhat"), "y", "yhat")

    run.__name__ = name
    query()(run)


for _name, _kind in {"l3_logistic": "logistic", "l4_naive_bayes": "naive_bayes", "l5_forest": "forest", "l7_tree": "tree", "l10_perceptron": "perceptron"}.items():
    _classifier(_name, _kind)
for _name, _kind in {"l8_boosted": "boosted", "l12_pcr": "pcr", "l13_least_squares": "least_squares", "l14_ridge": "ridge", "l14_lasso": "lasso", "l14_elastic_net": "elastic_net"}.items():
    _regressor(_name, _kind)


@query()
def m56_kmeans(spark, d):
    return catalogue.clusters(spectra(spark, d), "spectrum", 10).select("vec_id", "cluster")


@query()
def v6_grid_search(spark, d):
    found = catalogue.grid_search(folded(spark, d).drop("label"), "spectrum", "y", LinearRegression(), {"regParam": [0.001, 0.1], "elasticNetParam": [0.0, 1.0]}, "fold")
    return found.select(F.element_at("params", "regParam").alias("reg"), F.element_at("params", "elasticNetParam").alias("l1"), F.round("rmse", 6).alias("rmse"))


@query()
def m32_opls(spark, d):
    df = folded(spark, d)
    scored = blocks.opls(df.where("fold <> 0"), "spectrum", "y", 3).scored(df.where("fold = 0"), "spectrum")
    return scored.select("vec_id", *[F.round(F.element_at("opls", i + 1), 6).alias(n) for i, n in enumerate(("score", "yhat", "orthogonal"))])


@query()
def m38_transfer(spark, d):
    """A second instrument that smears, scales and lifts spectra; distances to the master's before and after."""
    x = lambda i: F.get("spectrum", i)
    smeared = F.transform("spectrum", lambda v, i: 0.1 + 1.05 * (0.8 * v + 0.2 * F.coalesce(x(i + 1), v)))
    df = models.folds(spectra(spark, d).withColumn("second", smeared), "vec_id", 5)
    apart = lambda c: F.sqrt(arrays.mean(F.zip_with(c, "spectrum", lambda a, b: (a - b) * (a - b))))
    out = df.where("fold = 0").withColumn("before", apart("second"))
    for kind in ("offset", "ds", "pds"):
        out = blocks.transfer(df.where("fold <> 0"), "second", "spectrum", kind).scores(out, "second", kind).withColumn(kind, F.round(apart(kind), 6))
    return rounded(out.select("vec_id", "before", "offset", "ds", "pds"), "before")


@query()
def m11_mcr_als(spark, d):
    df = spectra(spark, d).withColumn("spectrum", F.transform("spectrum", F.abs))
    pure, _ = blocks.mcr_als(df, "spectrum", 3, rounds=10)
    return rounded(signal.long_view(blocks.concentrations(df, "spectrum", pure), "c", "vec_id"), "x", digits=4)


@query()
def m43_augment(spark, d):
    made = blocks.augment(spectra(spark, d), "vec_id", "spectrum", copies=2)
    return rounded(signal.long_view(made, "spectrum", "vec_id", "copy"), "x")


@query()
def m48_contributions(spark, d):
    df = folded(spark, d)
    model = models.pls(df.where("fold <> 0"), "spectrum", ["y"], 6)
    return rounded(signal.long_view(blocks.window_contributions(df.where("fold = 0"), "spectrum", model, 8), "contributions", "vec_id"), "x").withColumnRenamed("var_idx", "win")
