"""Named variables: row norms, transforms and scalings that are fitted on some rows and applied to others.

A fit is one row of numbers (or one a variable), joined by broadcast: its size is that of a row, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.relational import quantiles


def row_median(c: Column) -> Column:
    """Median of an array without nulls."""
    half = F.floor(F.size(c) / 2).cast("int")
    return arrays.bound(F.array_sort(c), lambda s: F.when(F.size(s) % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2))


@dataclass
class RowNorm:
    """Rows divided by a factor of their own and multiplied by the factor's median over the fitted rows: sum, median or pqn (Dieterle, 2006)."""

    kind: str
    reference: list[float]
    level: float

    @staticmethod
    def fit(df: DataFrame, values: str, kind: str) -> RowNorm:
        width = len(df.select(values).first()[0])
        reference = []
        if kind == "pqn":
            long = df.select(F.posexplode(values).alias("i", "x"))
            medians = {r["i"]: r["m"] for r in quantiles(long, "x", {"m": 0.5}, "i").collect()}  # a number a variable
            reference = [medians[i] for i in range(width)]
        norm = RowNorm(kind, reference, 1.0)
        level = quantiles(df.select(norm.factor(F.col(values)).alias("f")), "f", {"m": 0.5}).first()["m"]
        return RowNorm(kind, reference, level)

    def factor(self, c: Column) -> Column:
        if self.kind == "sum":
            return arrays.total(c)
        if self.kind == "median":
            return row_median(c)
        ref = F.array(*[F.lit(x) for x in self.reference])
        shares = F.filter(F.zip_with(c, ref, lambda x, r: F.when(F.abs(r) > 1e-12, x / r)), lambda q: q.isNotNull())
        return row_median(shares)

    def apply(self, c: Column) -> Column:
        return arrays.bound(self.factor(c), lambda f: F.transform(c, lambda x: x / F.when(F.abs(f) < 1e-12, F.lit(1.0)).otherwise(f) * self.level))


@dataclass
class Transform:
    """sqrt, log10, log2 or ln of a variable made positive by a fitted offset, or glog with a fitted lambda.

    offset: 0 where all fitted values are positive, else half the least positive one minus the least; lambda: the square of half the least positive value.
    """

    kind: str
    offset: float
    lam: float

    @staticmethod
    def fit(df: DataFrame, value: str, kind: str) -> Transform:
        r = df.agg(F.min(value).cast("double").alias("low"), F.min(F.when(F.col(value) > 0, F.col(value))).cast("double").alias("least")).first()
        least = r["least"] if r["least"] is not None else 1.0
        return Transform(kind, 0.0 if r["low"] is None or r["low"] > 0 else least / 2 - r["low"], (least / 2) ** 2)

    def apply(self, c: Column) -> Column:
        if self.kind == "glog":
            return F.ln((c + F.sqrt(c * c + self.lam)) / 2)
        moved = F.greatest(c + self.offset, F.lit(1e-300))  # new rows may lie below the fitted least
        return {"sqrt": F.sqrt, "log10": F.log10, "log2": F.log2, "ln": F.ln}[self.kind](moved)


@dataclass
class Scaler:
    """Autoscaling by variable on (var_idx, x) rows, fitted on some rows and applied to others."""

    stats: DataFrame

    @staticmethod
    def fit(rows: DataFrame) -> Scaler:
        return Scaler(rows.groupBy("var_idx").agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s")))

    def apply(self, rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(self.stats), "var_idx")
        return out.withColumn("z", (F.col("x") - F.col("_m")) / F.when(F.coalesce("_s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")
