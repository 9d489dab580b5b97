"""Projects on disk: Parquet tables and a JSON manifest, written and read by Spark; lookups, cubes and manual columns.

Nothing is unpickled: a project holds tables and plain values only.
"""

from __future__ import annotations

import io
import json
import uuid
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.relational import number_of
from spectraloom.sources.readers import read_table

VERSION = 1


def trace_id(now: datetime | None = None) -> str:
    """YYYYMMDD-HHMMSS-hex6."""
    return f"{now or datetime.now(UTC):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"


def environment(spark: SparkSession) -> dict[str, str]:
    import platform

    import pyspark

    return {"spark": spark.version, "pyspark": pyspark.__version__, "python": platform.python_version(), "numpy": np.__version__}


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], values: dict | None = None) -> str:
    """Write tables and values under path; returns the project's trace id."""
    own = trace_id()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    manifest = {"version": VERSION, "id": own, "tables": sorted(tables), "values": values or {}, "environment": environment(spark)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return own


def load(spark: SparkSession, path: str, required: list[str] = (), tolerate: int = 2) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest; up to `tolerate` of the required tables may be absent."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    missing = [n for n in required if n not in manifest["tables"]]
    if len(missing) > tolerate:
        raise ValueError(f"the project lacks {missing}")
    return {n: spark.read.parquet(f"{path}/tables/{n}") for n in manifest["tables"]}, manifest


def card(fields: dict) -> str:
    """A model card as Markdown."""
    return "\n".join(["# Model card", "", *[f"* **{k}**: {v}" for k, v in fields.items()]]) + "\n"


def append_history(df: DataFrame, path: str) -> None:
    """Add runs to an append-only history, partitioned by series."""
    if "series" not in df.columns:
        raise ValueError("a history needs a column series")
    df.write.mode("append").partitionBy("series").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "series" not in df.columns:
        raise ValueError("not a history: no column series")
    return df


def preview(df: DataFrame, rows: int = 6, first: int = 14, last: int = 3) -> DataFrame:
    """A few rows; of many columns the first and the last."""
    names = df.columns if len(df.columns) <= first + last else df.columns[:first] + df.columns[-last:]
    return df.select(*[F.col(f"`{n}`") for n in names]).limit(rows)


def class_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, class) as text from a file's first two columns."""
    t = read_table(spark, path)
    a, b = t.columns[:2]
    return t.select(F.col(f"`{a}`").cast("string").alias("id"), F.col(f"`{b}`").cast("string").alias("class"))


def value_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, y) from a file's first two columns; what is no number is null."""
    t = read_table(spark, path)
    a, b = t.columns[:2]
    return t.select(F.col(f"`{a}`").cast("string").alias("id"), number_of(F.col(f"`{b}`")).alias("y"))


def design_file(spark: SparkSession, path: str, factors: int = 2) -> DataFrame:
    """(id, factor columns) as text."""
    t = read_table(spark, path)
    return t.select(F.col(f"`{t.columns[0]}`").cast("string").alias("id"), *[F.col(f"`{c}`").cast("string") for c in t.columns[1 : 1 + factors]])


def manual(df: DataFrame, order: str, text: str, into: str) -> DataFrame:
    """df with a column typed in as comma-separated text, one entry a row in order; the numbers must agree."""
    from pyspark.sql import Window

    given = [x.strip() for x in text.split(",")]
    n = df.count()
    if n != len(given):
        raise ValueError(f"{len(given)} entries for {n} rows")
    place = F.row_number().over(Window.orderBy(order))  # as many rows as were typed in
    return df.withColumn(into, F.element_at(F.array(*[F.lit(x) for x in given]), place))


def cube_array(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, spectrum) of a .npy or .npz cube (entries cube and, optionally, axis: reversed where it falls); one task a file."""
    def rows(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                got = np.load(io.BytesIO(content), allow_pickle=False)
                cube, axis = (got["cube"], got["axis"] if "axis" in got else None) if isinstance(got, np.lib.npyio.NpzFile) else (got, None)
                if cube.ndim != 3:
                    raise ValueError("a cube has three dimensions")
                if axis is not None and len(axis) > 1 and axis[0] > axis[-1]:
                    cube = cube[:, :, ::-1]
                for i, line in enumerate(cube.astype(np.float32)):
                    yield pd.DataFrame({"row": i, "col": range(len(line)), "spectrum": list(line)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row int, col int, spectrum array<float>")


def cube_table(table: DataFrame, x: str, y: str, bands: list[str]) -> DataFrame:
    """(row, col, spectrum) of a long table of pixels; offsets of the coordinates go, absent pixels stay absent."""
    low = table.agg(F.min(F.col(x).cast("int")).alias("_x"), F.min(F.col(y).cast("int")).alias("_y"))
    at = table.crossJoin(F.broadcast(low))  # one row
    return at.select((F.col(y).cast("int") - F.col("_y")).alias("row"), (F.col(x).cast("int") - F.col("_x")).alias("col"), F.array(*[F.col(f"`{b}`").cast("float") for b in bands]).alias("spectrum"))


def spatial_step(height: int, width: int, bands: int, most: int = 25_000_000) -> int:
    """The least block side that brings a cube down to `most` values."""
    step = 1
    while (height // step) * (width // step) * bands > most:
        step += 1
    return step
