"""Fitted models as Parquet: what is needed to predict later, and to tell whether the data have changed since.

A model is a dataclass of numbers, arrays, lists and other models; each of its fields is a row. A bundle also holds the axis, the kept variables, the
pretreatment steps, the classes and a fingerprint of the rows that it learnt from.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import arrays
from spectraloom.operators.blocks import OPLS
from spectraloom.operators.domain import Distance, Domain
from spectraloom.operators.kernels import Fourier, Machine
from spectraloom.operators.models import Linear
from spectraloom.operators.stats import PCA

KINDS = {c.__name__: c for c in (Linear, PCA, OPLS, Domain, Distance, Fourier, Machine)}
FIELDS = "place string, kind string, shape array<int>, numbers array<double>, text string"
#: What a bundle must hold to be loaded.
NEEDED = {"task", "model", "mask", "axis", "steps"}


@dataclass
class Bundle:
    """task: classification or regression; mask: the variables of `axis` that the model takes; steps: (name, parameters) in order."""

    task: str
    model: object
    axis: list[float]
    mask: list[bool]
    steps: list[tuple[str, dict]] = field(default_factory=list)
    classes: list | None = None
    fingerprint: int | None = None

    def matches(self, axis: list[float], tolerance: float = 1e-6) -> bool:
        return len(axis) == len(self.axis) and bool(np.allclose(axis, self.axis, rtol=0, atol=tolerance))

    def ready(self, df: DataFrame, values: str, steps: dict) -> DataFrame:
        """df with values pretreated by the bundle's steps (functions of a Column and the parameters, by name) and cut to its variables."""
        x = arrays.doubles(F.col(values))
        for name, more in self.steps:
            x = steps[name](x, **more)
        kept = [i for i, m in enumerate(self.mask) if m]
        out = df.withColumn(values, F.explode(F.array(x)))  # worked out before a model's function takes it: Spark 4.1 fails on nested lambdas below one
        return out if len(kept) == len(self.mask) else out.withColumn(values, F.array(*[F.get(values, F.lit(i)) for i in kept]))


def fingerprint(df: DataFrame, *columns: str) -> int:
    """A number that changes with any value of the columns, whatever the order of the rows; repeated rows count."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    row = df.agg(F.sum(h).alias("s"), F.count("*").alias("n")).first()
    return (int(row.s or 0) * 1_000_003 + row.n) % (1 << 63)


def _rows(place: str, value) -> list[tuple]:
    if dataclasses.is_dataclass(value):
        out = [(place, type(value).__name__, None, None, None)]
        for f in dataclasses.fields(value):
            out += _rows(f"{place}.{f.name}", getattr(value, f.name))
        return out
    if isinstance(value, np.ndarray):
        return [(place, "array", list(value.shape), value.astype(float).ravel().tolist(), None)]
    if isinstance(value, (list, tuple)) and any(isinstance(v, np.ndarray) or isinstance(v, (list, tuple)) and any(isinstance(w, np.ndarray) for w in v) or dataclasses.is_dataclass(v) for v in value):
        out = [(place, "list" if isinstance(value, list) else "tuple", [len(value)], None, None)]
        for i, v in enumerate(value):
            out += _rows(f"{place}.{i}", v)
        return out
    return [(place, "json", None, None, json.dumps(value, default=lambda v: v.item()))]


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Write a bundle as a table of its own; an existing one is not overwritten."""
    rows = [r for name, value in vars(bundle).items() for r in _rows(name, value)]
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Bundle:
    """A saved bundle; an error tells what a table lacks that is none."""
    table = spark.read.parquet(path)
    if set(table.columns) != {"place", "kind", "shape", "numbers", "text"}:
        raise ValueError("not a saved model: its columns differ")
    held = {r.place: r for r in table.collect()}  # a model's size
    if missing := NEEDED - {p.split(".")[0] for p in held}:
        raise ValueError(f"not a saved model: {', '.join(sorted(missing))} missing")

    def value(place: str):
        r = held[place]
        if r.kind == "array":
            return np.array(r.numbers).reshape(r["shape"])
        if r.kind == "json":
            return json.loads(r.text)
        if r.kind in ("list", "tuple"):
            items = [value(f"{place}.{i}") for i in range(r["shape"][0])]
            return items if r.kind == "list" else tuple(items)
        return KINDS[r.kind](**{f.name: value(f"{place}.{f.name}") for f in dataclasses.fields(KINDS[r.kind])})

    out = Bundle(**{f.name: value(f.name) for f in dataclasses.fields(Bundle) if f.name in held})
    out.steps = [(n, m) for n, m in out.steps]
    return out


def stale(current: dict[str, int | None], used: dict[str, int | None]) -> dict[str, str]:
    """By result "current", "stale" (its rows' fingerprint has changed since) or "absent", from fingerprints now and then."""
    return {name: "absent" if used.get(name) is None else "current" if used[name] == now else "stale" for name, now in current.items()}


def predicted(df: DataFrame, values: str, bundle: Bundle, steps: dict[str, Column] | None = None, into: str = "yhat") -> DataFrame:
    """df with the loaded model's number, or class, of each row; values are pretreated and cut first, and kept as they came."""
    rows = bundle.ready(df.withColumn("_v", F.col(values)), "_v", steps or {})
    if bundle.classes is None:
        return bundle.model.scores(rows, "_v", into).withColumn(into, F.col(into)[0]).drop("_v")
    from spectraloom.operators.models import classify

    return classify(rows, "_v", bundle.classes, bundle.model).withColumnRenamed("yhat", into).drop("_v", "scores")
