"""Named estimators of pyspark.ml for spectra in array columns, with folds kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classifiers by name; each takes the numbers of variables, classes and rows.
CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda p, k, n: C.LogisticRegression(regParam=1 / max(1, n), standardization=False, maxIter=2000),  # C = 1
    "naive_bayes": lambda p, k, n: C.NaiveBayes(modelType="gaussian"),
    "tree": lambda p, k, n: C.DecisionTreeClassifier(maxDepth=30, seed=0),
    "forest": lambda p, k, n: C.RandomForestClassifier(numTrees=150, maxDepth=15, seed=0),
    "boosted": lambda p, k, n: C.OneVsRest(classifier=C.GBTClassifier(maxIter=10, seed=0)),
    "linear_svm": lambda p, k, n: C.OneVsRest(classifier=C.LinearSVC(maxIter=50)),
    "perceptron": lambda p, k, n: C.MultilayerPerceptronClassifier(layers=[p, 50, k], seed=0),
}
#: Regressors by name; each takes the numbers of variables and rows and the target's population deviation, by which Spark's penalties are scaled.
REGRESSORS: dict[str, Callable] = {
    "ridge": lambda p, n, sd: R.LinearRegression(regParam=1.0 / max(1, n) * sd, standardization=False, solver="normal"),
    "lasso": lambda p, n, sd: R.LinearRegression(regParam=0.01, elasticNetParam=1.0, standardization=False),
    "elastic_net": lambda p, n, sd: R.LinearRegression(regParam=0.005 * (1 + sd), elasticNetParam=1 / (1 + sd), standardization=False),
    "least_squares": lambda p, n, sd: R.LinearRegression(solver="normal"),
    "tree": lambda p, n, sd: R.DecisionTreeRegressor(maxDepth=30, seed=0),
    "forest": lambda p, n, sd: R.RandomForestRegressor(numTrees=100, featureSubsetStrategy="0.2", seed=0),
    "boosted": lambda p, n, sd: R.GBTRegressor(maxIter=20, seed=0),
    "pcr": lambda p, n, sd: Pipeline(stages=[PCA(k=min(10, p), inputCol="features", outputCol="pcs"), R.LinearRegression(featuresCol="pcs", solver="normal")]),
}


def features(df: DataFrame, values: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(values, lambda x: x.cast("double"))))


def classify(train: DataFrame, test: DataFrame, values: str, label: str, kind: str) -> DataFrame:
    """test with yhat, the class a model of `kind` gives after learning from train."""
    index = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc")
    rows = features(train.withColumn("_y", F.col(label).cast("string")), values)
    fitted = index.fit(rows)
    p = len(rows.first()["features"])
    model = CLASSIFIERS[kind](p, len(fitted.labels), rows.count()).fit(fitted.transform(rows))
    names = F.array(*[F.lit(x) for x in fitted.labels])
    return model.transform(features(test, values)).select(*test.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("yhat"))


def regress(train: DataFrame, test: DataFrame, values: str, target: str, kind: str) -> DataFrame:
    """test with yhat of a model of `kind` that learnt from train."""
    rows = features(train.withColumn("label", F.col(target).cast("double")), values)
    n, sd = rows.agg(F.count("label"), F.coalesce(F.stddev_pop("label"), F.lit(0.0))).first()
    model = REGRESSORS[kind](len(rows.first()["features"]), n, sd).fit(rows)
    return model.transform(features(test, values)).select(*test.columns, F.col("prediction").alias("yhat"))


def kmeans(df: DataFrame, values: str, k: int, seed: int = 0):
    return KMeans(k=k, seed=seed).fit(features(df, values))


def nearest(model, df: DataFrame, values: str) -> DataFrame:
    """df with cluster, the number of the nearest centre."""
    return model.transform(features(df, values)).withColumnRenamed("prediction", "cluster").drop("features")


def clusters(df: DataFrame, values: str, k: int, seed: int = 0) -> DataFrame:
    """df with cluster, by k-means."""
    return nearest(kmeans(df, values, k, seed), df, values)


def grid_search(df: DataFrame, values: str, target: str, estimator, grid: dict[str, list], fold: str, metric: str = "rmse") -> DataFrame:
    """One row a setting: its parameters and the mean metric over the folds in column `fold`."""
    build = ParamGridBuilder()
    for name, options in grid.items():
        build = build.addGrid(estimator.getParam(name), options)
    settings = build.build()
    judge = RegressionEvaluator(metricName=metric) if metric in ("rmse", "mae", "r2") else MulticlassClassificationEvaluator(metricName=metric)
    rows = features(df.withColumn("label", F.col(target).cast("double")), values).withColumn("_fold", F.col(fold).cast("int"))
    n = rows.agg(F.max("_fold")).first()[0] + 1
    found = CrossValidator(estimator=estimator, estimatorParamMaps=settings, evaluator=judge, numFolds=n, foldCol="_fold", parallelism=2).fit(rows)
    return df.sparkSession.createDataFrame([({p.name: str(v) for p, v in s.items()}, float(m)) for s, m in zip(settings, found.avgMetrics, strict=True)], f"params map<string,string>, {metric} double")
