"""Delimited files: sniffing, headers, roles. All parsing is Spark's; the driver sees the first lines only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spectraloom.operators.relational import number_of


def sniff(lines: list[str]) -> tuple[str, bool]:
    """Delimiter and whether commas are decimal.

    Of , ; and tab, the one that is most frequent in the first line where it parts all lines into as many fields, else the most frequent one.
    """
    first = lines[0] if lines else ""
    there = [c for c in ",;\t" if c in first]
    even = [c for c in there if len({x.count(c) for x in lines if x.strip()}) == 1]
    sep = max(even or there or [","], key=first.count)
    return sep, sep != "," and any(re.search(r"\d,\d", x) for x in lines)


def unique_headers(names: list[str | None]) -> list[str]:
    """Blank headers are named by place, repeated ones numbered."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"Unnamed: {i}"
        seen[n] = seen.get(n, -1) + 1
        out.append(n if not seen[n] else f"{n}.{seen[n]}")
    return out


def read_table(spark: SparkSession, path: str, encoding: str | None = None, header_row: int = 1) -> DataFrame:
    """A delimited file as strings, delimiter and headers worked out; the header is row 1 to 10, rows before it are left out.

    Without an encoding given, UTF-8 is taken unless the first lines show it is none, then Latin-1.
    """
    text = lambda e: spark.read.text(path).select((F.col("value") if e == "UTF-8" else F.decode(F.col("value").cast("binary"), e)).alias("value"))
    head = lambda e: [r[0].lstrip("\ufeff") for r in text(e).limit(15).collect()]
    encoding = encoding or ("ISO-8859-1" if any("\ufffd" in x for x in head("UTF-8")) else "UTF-8")
    lines = head(encoding)[header_row - 1 :]
    sep, _ = sniff(lines)
    names = unique_headers([c.strip('"') for c in lines[0].split(sep)] if lines else [])
    schema = StructType([StructField(n, StringType()) for n in names])
    if header_row == 1:
        return spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    top = lines.where("start = 0").groupBy("file").agg(F.min("id").alias("first"))  # a row a file; ids rise along a file's first block
    body = lines.join(F.broadcast(top), "file").where((F.col("start") > 0) | (F.col("id") >= F.col("first") + header_row))
    body = body.select((F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)).alias("value"))
    parsed = F.from_csv("value", ", ".join(f"`{n}` STRING" for n in names), {"sep": sep})
    return body.select(parsed.alias("r")).select("r.*")


def typed(table: DataFrame) -> DataFrame:
    """Columns as numbers where no value but null would be lost, else as they are; one pass counts what each would lose."""
    lost = table.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`")) != "") & number_of(F.col(f"`{c}`")).isNull()).alias(f"_{i}") for i, c in enumerate(table.columns)]).first()
    return table.select(*[(number_of(F.col(f"`{c}`")) if not lost[i] else F.col(f"`{c}`")).alias(c) for i, c in enumerate(table.columns)])


def matching(table: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; an error lists those that are absent."""
    missing = [n for n in names if n not in table.columns]
    if missing:
        raise ValueError(f"columns are absent: {', '.join(missing)}")
    return table.select(*[F.col(f"`{n}`") for n in names])


def is_axis(name: str) -> bool:
    try:
        float(name.replace(",", "."))
        return True
    except ValueError:
        return False


def spectra(table: DataFrame, key: str | None = None) -> tuple[DataFrame, list[float]]:
    """(id, attributes…, spectrum array) with the numeric headers in ascending axis order, and that axis."""
    axis = sorted(((float(c.replace(",", ".")), c) for c in table.columns if is_axis(c)))
    other = [c for c in table.columns if not is_axis(c)]
    key = key or (other[0] if other else None)
    values: list[Column] = [number_of(F.col(f"`{c}`")) for _, c in axis]
    named = [F.col(f"`{key}`").cast("string").alias("id")] if key else [F.monotonically_increasing_id().cast("string").alias("id")]
    return table.select(*named, *[F.col(f"`{c}`") for c in other if c != key], F.array(*values).alias("spectrum")), [a for a, _ in axis]


def wide(df: DataFrame, values: str, axis: list[float]) -> DataFrame:
    """The inverse: one column an axis point, for CSV sinks."""
    return df.select(*[c for c in df.columns if c != values], *[F.element_at(values, i + 1).alias(f"{a:g}") for i, a in enumerate(axis)])
