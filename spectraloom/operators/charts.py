"""Control charts over ordered series, per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.operators import relational


#: Rows of a series that one task orders; a halo must not be longer.
BLOCK = 1 << 16


def baseline(rows: DataFrame, value: str, order: list[str], first: int, *keys: str) -> DataFrame:
    """Adds n (1-based place), mu and sd of the first `first` rows, and z.

    A null key is a series like any other. A series is numbered range by range of its first order column: counts of ranges plus places in a range.
    """
    ranged = relational.in_ranges(rows, order[0])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_c")).select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n"))
    out = relational.matched(ranged, base, *keys, "_part").withColumn("n", F.col("_n") + F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    out = out.select(*rows.columns, "n")
    ref = out.where(F.col("n") <= first).groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    out = relational.matched(out, ref, *keys) if keys else out.crossJoin(F.broadcast(ref))  # one row
    sd = F.greatest(F.coalesce("sd", F.lit(0.0)), 0.05 * F.abs("mu"), F.lit(1e-9))
    return out.withColumn("z", (F.col(value) - F.col("mu")) / sd)


def _block() -> Column:
    return F.floor((F.col("n") - 1) / BLOCK)


def _with_halo(rows: DataFrame, size: int) -> DataFrame:
    """Adds _block; the last `size` rows of a block go to the next one too, so that windows reach back over its border."""
    if size > BLOCK:
        raise ValueError(f"a window may reach back {BLOCK} rows")
    late = (F.col("n") - 1) % BLOCK >= BLOCK - size
    return rows.withColumn("_block", F.explode(F.when(late, F.array(_block(), _block() + 1)).otherwise(F.array(_block()))))


def _own(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_block") == _block()).drop("_block")


def _ordered(*keys: str):
    return Window.partitionBy(*keys, "_block").orderBy("n")


def cusum(rows: DataFrame, *keys: str, slack: float = 0.5) -> DataFrame:
    """Adds `cusum`: max(0, c + z - slack), as running sum minus its running minimum, floored at 0.

    Sums and minima run inside blocks; those of the blocks before are added from one row a block.
    """
    w = _ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_block", _block()).withColumn("_s", F.sum(F.col("z") - slack).over(w))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = inside.groupBy(*keys, "_block").agg(F.sum(F.col("z") - slack).alias("_total"), F.min("_s").alias("_min"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    blocks = blocks.select(*keys, "_block", "_base", F.least(F.lit(0.0), F.min(F.col("_base") + F.col("_min")).over(before)).alias("_low"))
    out = inside.withColumn("_own", F.min("_s").over(w)).transform(relational.matched, blocks, *keys, "_block")
    total = F.col("_base") + F.col("_s")
    return out.withColumn("cusum", total - F.least(F.col("_low"), F.col("_base") + F.col("_own"))).select(*rows.columns, "cusum")


def ewma(rows: DataFrame, value: str, *keys: str, weight: float = 0.2, width: float = 3.0) -> DataFrame:
    """Adds ewma, lower and upper: z_i = weight * v_i + (1 - weight) * z_(i-1) from mu, limits by the exact variance.

    The values up to a row are folded in order, as far back as they count for more than 1e-18, below a double's
    precision: 186 rows for the default weight, 4,124 for 0.01.
    """
    back = math.ceil(math.log(1e-18) / math.log1p(-weight)) if weight < 1 else 1
    near = F.collect_list(value).over(_ordered(*keys).rowsBetween(1 - back, 0))
    fold = F.aggregate("_near", F.col("mu"), lambda z, v: weight * v + (1 - weight) * z)
    spread = width * F.col("sd") * F.sqrt(F.lit(weight / (2 - weight)) * (1 - F.pow(F.lit(1 - weight), 2 * F.col("n"))))
    out = _own(_with_halo(rows, back - 1).withColumn("_near", near)).withColumn("ewma", fold).drop("_near")
    return out.withColumn("lower", F.col("mu") - spread).withColumn("upper", F.col("mu") + spread)


def westgard(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds the rules 1-3s, 2-2s, R-4s (successive points), 4-1s and 10-x as booleans."""
    w = _ordered(*keys)

    def same_side(size: int, limit: float) -> Column:
        near = w.rowsBetween(1 - size, 0)
        full = F.count("z").over(near) == size
        return full & ((F.min("z").over(near) > limit) | (F.max("z").over(near) < -limit))

    jump = F.coalesce(F.abs(F.col("z") - F.lag("z").over(w)) > 4, F.lit(False))
    rules = {"r_1_3s": F.abs("z") > 3, "r_2_2s": same_side(2, 2.0), "r_4s": jump, "r_4_1s": same_side(4, 1.0), "r_10x": same_side(10, 0.0)}
    return _own(_with_halo(rows, 9).withColumns(rules))


def health(batches: DataFrame, order: str, metrics: list[str], baseline: int = 5) -> DataFrame:
    """Adds cusum and status to batches (a row each, with their metrics and outside, the % of rows outside the domain).

    cusum is the largest one-sided CUSUM over the metrics, each standardised by the first `baseline` batches (slack 0.5; a deviation of
    5 % of their mean at least). Those batches are the reference; the others are to retrain, to watch or ok.
    """
    w = Window.orderBy(order)  # one row a batch
    out = batches.withColumn("_i", F.row_number().over(w))
    early = lambda f, m: f(F.when(F.col("_i") <= baseline, F.col(m))).over(Window.partitionBy())
    for m in metrics:
        mean = early(F.avg, m)
        sd = F.greatest(F.coalesce(early(F.stddev_samp, m), F.lit(0.0)), 0.05 * F.greatest(F.abs(mean), F.lit(1e-9)), F.lit(1e-9))
        out = out.withColumn(f"_z_{m}", (F.col(m) - mean) / sd - 0.5).withColumn(f"_s_{m}", F.sum(f"_z_{m}").over(w))
        out = out.withColumn(f"_c_{m}", F.col(f"_s_{m}") - F.least(F.lit(0.0), F.min(f"_s_{m}").over(w)))
    drift = F.greatest(*[F.col(f"_c_{m}") for m in metrics]) if len(metrics) > 1 else F.col(f"_c_{metrics[0]}")
    worst = (F.col("outside") > 25) & (F.lag("outside").over(w) > 25)
    status = F.when(F.col("_i") <= baseline, "reference").when((drift > 5) | F.coalesce(worst, F.lit(False)), "retrain").when((drift > 2.5) | (F.col("outside") > 10), "watch").otherwise("ok")
    return out.withColumn("status", status).withColumn("cusum", drift).select(*batches.columns, "cusum", "status")


def status(rows: DataFrame, distance: Column, warn: float, act: float) -> DataFrame:
    """Adds status to runs: ok, warning or ACTION by two limits of a distance."""
    return rows.withColumn("status", F.when(distance > act, "ACTION").when(distance > warn, "warning").otherwise("ok"))
