"""Lookup, interval and set operators, variable selection and gaps-and-islands."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in `order`, of equals the one with the largest columns. Pre-aggregated, so a frequent key is not gathered."""
    rest = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return top.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def lookup(left: DataFrame, right: DataFrame, key: str, order: str, defaults: dict | None = None) -> DataFrame:
    """Left join on a key whose last right row wins; missing columns take their default."""
    out = left.join(last_by(right, key, order), key, "left")
    return out.fillna(defaults) if defaults else out


def matched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys that are equal or both null."""
    other = right.select(*[F.col(k).alias(f"_{k}_") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys])).drop(*[f"_{k}_" for k in keys])


def overlaps(regions: DataFrame, bands: DataFrame, top: int = 3) -> DataFrame:
    """Interval join of regions (region, lo, hi) with a small band table (band, b_lo, b_hi).

    score is the overlap over the lesser width; of a region, the `top` bands by score stay, the
    narrower first on ties. Bands are a dimension table of fixed size and are broadcast.
    """
    width = F.least(F.col("hi") - F.col("lo"), F.col("b_hi") - F.col("b_lo"))
    shared = F.least("hi", "b_hi") - F.greatest("lo", "b_lo")
    hits = regions.join(F.broadcast(bands), (F.col("b_lo") < F.col("hi")) & (F.col("lo") < F.col("b_hi")) & (width > 0)).withColumn("score", shared / width)
    best = Window.partitionBy("region").orderBy(F.desc("score"), F.col("b_hi") - F.col("b_lo"), "band")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def inside(axis: Column, regions: list[tuple[float, float]]) -> Column:
    """Whether an axis value lies in a union of closed intervals, given in either order."""
    out = F.lit(False)
    for a, b in regions:
        out = out | axis.between(min(a, b), max(a, b))
    return out


def crop(rows: DataFrame, axis: str, regions: list[tuple[float, float]], keep: bool = True) -> DataFrame:
    hit = inside(F.col(axis), regions)
    return rows.where(hit if keep else ~hit)


def islands(rows: DataFrame, index: str, gap: int, *keys: str) -> DataFrame:
    """(keys…, first, last, n): runs of indices that follow each other within `gap`."""
    w = Window.partitionBy(*keys).orderBy(index)
    step = rows.withColumn("__new", (F.col(index) - F.lag(index).over(w) > gap).cast("int"))
    step = step.withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    return step.groupBy(*keys, "__run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("__run")


def unique_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated ids get _2, _3… in load order; null ids are named after their order."""
    named = rows.withColumn(key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("sample_"), F.col(order).cast("string"))))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return named.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 1, F.concat_ws("_", key, "__n")).otherwise(F.col(key))).drop("__n")


def number_of(label: Column) -> Column:
    """An axis label as a number, null where it is none: a lone comma is decimal, commas beside a dot separate thousands."""
    plain = F.when(label.contains(".") & label.contains(","), F.replace(label, F.lit(","), F.lit(""))).otherwise(F.replace(label, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def shared_classes(rows: DataFrame, label: str, group: str) -> DataFrame:
    """Classes that occur in every group."""
    n = rows.agg(F.countDistinct(group).alias("groups"))
    return rows.groupBy(label).agg(F.countDistinct(group).alias("n")).crossJoin(F.broadcast(n)).where("n = groups").select(label)  # one row


# ---- orders over many rows ----------------------------------------------------------------


def in_ranges(df: DataFrame, order: str, parts: int = 256) -> DataFrame:
    """Adds _part: the place of a row's range of `order` (a number or time; nulls first), of about `parts` ranges by approximate quantiles.

    Rows with equal `order` are in one range.
    """
    inf = float("inf")
    at, kind = F.col(order), df.schema[order].dataType.typeName()
    if kind in ("date", "timestamp_ntz"):  # not by way of a time zone, whose clock may be set back
        at = F.unix_date(at.cast("date")) * 86_400 + (F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at) if kind == "timestamp_ntz" else 0)
    ranged = df.withColumn("_at", F.coalesce(at.cast("double"), F.lit(-inf)))
    cuts = sorted(set(ranged.approxQuantile("_at", [i / parts for i in range(1, parts)], 0.002))) if parts > 1 else []
    cuts = [c for c in cuts if -inf < c < inf]
    if not cuts:
        return ranged.withColumn("_part", F.lit(0.0)).drop("_at")
    return Bucketizer(splits=[-inf, *cuts, inf], inputCol="_at", outputCol="_part", handleInvalid="keep").transform(ranged).drop("_at")


def cumulative(df: DataFrame, order: str, values: list[str], *keys: str, parts: int = 256) -> DataFrame:
    """Adds upto_<value>: sums over the rows up to each one, by ascending `order` (a number, not null), within keys.

    Rows are dealt by quantiles of `order` into `parts` ranges: sums of ranges plus a window inside a range, so no
    task sees all rows. Rows should be distinct in keys and order, as counts of values are.
    """
    ranged = in_ranges(df, order, parts)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows a key
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    base = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inner = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(base, [*keys, "_part"])
    return out.select(*df.columns, *[(F.col(f"_{v}") + F.sum(v).over(inner)).alias(f"upto_{v}") for v in values])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys…, n and a column a share): exact quantiles with linear interpolation, nulls left out.

    Values are counted first and ranks are running sums of the counts (see cumulative), so no task holds a key's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    upto = cumulative(counts, "_v", ["_c"], *keys)
    upto = upto.join(n, list(keys)) if keys else upto.crossJoin(F.broadcast(n))  # one row
    at = lambda share: F.lit(share) * (F.col("n") - 1)
    ranked = lambda rank: F.min(F.when(F.col("upto__c") > rank, F.col("_v")))
    found = upto.groupBy(*keys, "n").agg(*[x for name, q in shares.items() for x in (ranked(F.floor(at(q))).alias(f"_lo_{name}"), ranked(F.ceil(at(q))).alias(f"_hi_{name}"))])
    part = lambda q: at(q) - F.floor(at(q))
    return found.select(*keys, "n", *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part(q)).alias(name) for name, q in shares.items()])


def levels(rows: DataFrame, factor: str, order: str, least: int = 2, most: int = 12) -> DataFrame:
    """(factor, first, n): levels in order of first appearance, none unless their number is within bounds."""
    found = rows.where(F.col(factor).isNotNull()).groupBy(factor).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    number = found.agg(F.count("*").alias("_levels"))
    return found.crossJoin(F.broadcast(number)).where(F.col("_levels").between(least, most)).drop("_levels")  # one row


def design(samples: DataFrame, factors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Samples joined with their factor levels; those without a level of every factor go."""
    return samples.join(factors.select(key, *columns).where(" and ".join(f"`{c}` is not null" for c in columns)), key)
