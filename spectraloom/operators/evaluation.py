"""Training, cross-validation and a held-out test in one call, with the out-of-fold shares of every class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators import catalogue, kernels, models

#: Classifiers whose scores are turned into shares by softmax.
SCORED = {
    "lda": lambda df, values, label: models.lda(df, values, label),
    "pls_da": lambda df, values, label: models.pls_da(df, values, label, 5),
    "svm": lambda df, values, label: kernels.svc(df, values, label),
}


def classify(train: DataFrame, test: DataFrame, values: str, label: str, kind: str) -> DataFrame:
    """test with yhat and shares (class as text -> share), by a classifier of SCORED or of the catalogue that gives probabilities.

    Rows of train without a class are left out; a class that train lacks gets no share.
    """
    rows = train.where(F.col(label).isNotNull() & F.col(values).isNotNull()).withColumn("_y", F.col(label).cast("string"))
    if kind in SCORED:
        names, model = SCORED[kind](rows, values, "_y")
        scored = models.classify(test, values, names, model)
        return scored.withColumn("shares", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), arrays.softmax(F.col("scores")))).drop("scores")
    index = StringIndexer(inputCol="_y", outputCol="_t", stringOrderType="alphabetAsc").fit(rows)
    ready = catalogue.features(index.transform(rows), values)
    model = catalogue.CLASSIFIERS[kind](len(ready.first()["features"]), len(index.labels), ready.count()).setLabelCol("_t").fit(ready)
    names = F.array(*[F.lit(x) for x in index.labels])
    out = model.transform(catalogue.features(test, values))
    return out.select(*test.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("yhat"), F.map_from_arrays(names, vector_to_array("probability")).alias("shares"))


def out_of_fold(df: DataFrame, key: str, values: str, label: str, fold: str, kind: str, enlarge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, fold, y, yhat, shares) of every row with a class and a fold, by a model of the other folds.

    enlarge adds simulated rows to (key, values, y, fold); it is given the other folds alone, so no simulated row comes from a row that is judged.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull() & F.col(values).isNotNull()).select(key, values, F.col(label).cast("string").alias("y"), F.col(fold).alias("fold"))
    out = None
    for (name,) in sorted(tuple(r) for r in rows.select("fold").distinct().collect()):
        train = rows.where(F.col("fold") != F.lit(name))
        part = classify(enlarge(train) if enlarge else train, rows.where(F.col("fold") == F.lit(name)), values, "y", kind).drop(values)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else rows.drop(values).withColumns({"yhat": F.lit(None).cast("string"), "shares": F.lit(None).cast("map<string,double>")})


def judged(rows: DataFrame) -> DataFrame:
    """One row of models.overall(), the mean specificity and the mean area under the curve of each class against the rest, from (y, yhat, shares)."""
    by = models.class_metrics(rows).agg(F.avg("specificity").alias("macro_specificity"))
    each = rows.select("y", F.explode("shares").alias("class", "share"))
    area = models.auc(each, F.col("y") == F.col("class"), "share", "class").agg(F.avg("auc").alias("auc"))
    return models.overall(rows).crossJoin(F.broadcast(by)).crossJoin(F.broadcast(area))  # one row each


def validated(df: DataFrame, key: str, values: str, label: str, fold: str, held_out: str, kind: str, enlarge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """judged() by stage: "cv", out-of-fold predictions of the rows that are not held out, and "test", the held-out rows by a model of all others. enlarge: see out_of_fold()."""
    rows = df.where(F.col(label).isNotNull() & F.col(values).isNotNull())
    train, test = rows.where(~F.col(held_out)), rows.where(F.col(held_out))
    out = judged(out_of_fold(train, key, values, label, fold, kind, enlarge)).withColumn("stage", F.lit("cv"))
    if test.isEmpty():
        return out
    made = enlarge(train.select(key, values, F.col(label).cast("string").alias("y"), F.col(fold).alias("fold"))).withColumnRenamed("y", label) if enlarge else train
    final = classify(made, test, values, label, kind).select(F.col(label).cast("string").alias("y"), "yhat", "shares")
    return out.unionByName(judged(final).withColumn("stage", F.lit("test")))
