"""All pairs of rows: blocks of rows, and cells in which two blocks meet.

A block is one record of a table in the shared folder. A cell's task reads its two blocks there, so that no row is shuffled to its
partners and a task holds two blocks, however many rows there are.

Distances are screened by a matrix product that bounds them from below or above, with the rounding of its precision added to the rows'
squared lengths. What a bound can't settle is worked out from the rows' differences, so results are those of the plain formula.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.sources.shared import written

#: Bytes of a block's points as doubles; blocks that a small part is dealt into, and the rows that make it worth a second one.
BYTES, LEAST_BLOCKS, SMALL = 1 << 24, 6, 2048
#: Rows of a tile, of either side; pairs that are worked out at once.
TILE, WIDE, AT_ONCE = 256, 1024, 1 << 16


def finite(values: str) -> Column:
    """Whether values are there and all finite."""
    return F.col(values).isNotNull() & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def unpacked(points: bytes, n: int) -> np.ndarray:
    """A block's n points as doubles; they are kept as singles where that loses nothing."""
    width = int.from_bytes(points[:1], "little")
    return np.frombuffer(points, np.float32 if width == 4 else np.float64, offset=8).reshape(n, -1).astype(np.float64)


def packed(x: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    kept = single if np.array_equal(single, x) else x
    return kept.itemsize.to_bytes(8, "little") + np.ascontiguousarray(kept).tobytes()


def blocks(rows: DataFrame, most: int, *more: str, extra: tuple[str, Callable] | None = None) -> DataFrame:
    """(part, block, of, ids, points, more…): rows (part int, id long, x array<double> of finite entries, more…) of each part dealt by a hash of id.

    A block has about `most` rows and BYTES bytes at most, its ids ascend, `of` is the number of its part's blocks. Parts are few. extra is
    a column "name kind" of a value for each row, worked out by a function of a block's points.
    """
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"))
    rows_of = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BYTES) / 8 / F.greatest(F.lit(1), F.col("p")))))
    of = F.greatest(F.ceil(F.col("n") / rows_of), F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / SMALL))).cast("int")
    dealt = rows.join(F.broadcast(sizes.select("part", of.alias("of"))), "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))  # a row a part
    kinds = {c: rows.schema[c].dataType.simpleString() for c in more}
    schema = "part int, block int, of int, ids array<bigint>, points binary" + "".join(f", {c} array<{k}>" for c, k in kinds.items()) + (f", {extra[0].split()[0]} array<{extra[0].split()[1]}>" if extra else "")

    def pack(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order] + 0.0
        ends = pa.array([0, len(ids)], pa.int32())
        columns = {c: t[c].slice(0, 1) for c in ("part", "block", "of")} | {"ids": pa.array([ids[order]]), "points": pa.array([packed(x)], pa.binary())}
        for c in more:
            columns[c] = pa.ListArray.from_arrays(ends, t[c].combine_chunks().take(pa.array(order)))
        if extra:
            columns[extra[0].split()[0]] = pa.array([extra[1](x)])
        return pa.table(columns)

    return written(dealt.groupBy("part", "block").applyInArrow(pack, schema), "blocks")


def cells(one: DataFrame, other: DataFrame, condition: Callable[[Column, Column], Column], f: Callable, schema: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """What f yields as columns for every block of `one` with every block of `other` for which condition(block, other block) holds, in their part.

    f has part, ids, points and the carried columns of both: (part, (ids, x, …), (ids, x, …), whether they are the same block).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    form = to_arrow_schema(StructType.fromDDL(schema))
    side = lambda df, to: df.select(*[F.col(c).alias(f"{to}_{c}") for c in ("part", "block", "ids", "points", *(c for c in carried if c in df.columns))])
    met = side(one, "a").join(side(other, "b").hint("shuffle_replicate_nl"), (F.col("a_part") == F.col("b_part")) & condition(F.col("a_block"), F.col("b_block")))

    def held(batch: pa.RecordBatch, i: int, to: str) -> tuple:
        ids = batch[f"{to}_ids"][i].values.to_numpy()
        return (ids, unpacked(batch[f"{to}_points"][i].as_buffer(), len(ids)), *(batch[name][i].values for c in carried if (name := f"{to}_{c}") in batch.schema.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch["a_block"][i].as_py() == batch["b_block"][i].as_py()
                for found in f(batch["a_part"][i].as_py(), held(batch, i, "a"), held(batch, i, "b"), same):
                    yield pa.RecordBatch.from_arrays([c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(found, form, strict=True)], schema=form)

    return met.mapInArrow(run, schema)


def apart(x: np.ndarray, y: np.ndarray, scale: tuple[float, float] | None = None) -> np.ndarray:
    """Distances of rows to a row, or of rows to rows one by one; with a scale the last entry is the target, and the distances of both parts add up over their largest."""
    if scale is None:
        return np.sqrt(((x - y) ** 2).sum(1))
    dx, dy = np.sqrt(((x[:, :-1] - y[..., :-1]) ** 2).sum(1)), np.abs(x[:, -1] - y[..., -1])
    return (dx / scale[0] if scale[0] > 0 else dx) + (dy / scale[1] if scale[1] > 0 else dy)


def of_pairs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, scale: tuple[float, float] | None = None) -> np.ndarray:
    """Distances of x[i] to y[j], so many at once."""
    return np.concatenate([np.zeros(0), *(apart(x[i[k : k + AT_ONCE]], y[j[k : k + AT_ONCE]], scale) for k in range(0, len(i), AT_ONCE))])


class Bounds:
    """Bounds of the squared distances between rows of x and of y, in units of `unit`: none is below (low) or above (high) the true one.

    The product has p + 2 terms. With u the unit roundoff, centring, scaling, rounding and summing change a squared distance by
    less than (p + 8) u (|x| + |y|)^2 <= 2 (p + 8) u (|x|^2 + |y|^2), with the lengths after centring; twice that is added.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, high: bool = False, kind: type = np.float32):
        centre = y.mean(0) if len(y) else 0.0
        x, y = x - centre, y - centre
        self.unit = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) or 1.0
        x, y = x / self.unit, y / self.unit
        e = 1 + (1 if high else -1) * 4 * (x.shape[1] + 8) * np.finfo(kind).eps / 2
        nx, ny = (x * x).sum(1) * e, (y * y).sum(1) * e
        self.a = np.hstack([-2 * x, nx[:, None], np.ones((len(x), 1))]).astype(kind)
        self.b = np.hstack([y, np.ones((len(y), 1)), ny[:, None]]).astype(kind)

        self.kind = kind

    def limit(self, d: np.ndarray | float, up: bool) -> np.ndarray:
        """Distances in the units of tiles, rounded up or down."""
        with np.errstate(over="ignore"):
            return np.nextafter(np.asarray((np.asarray(d) / self.unit) ** 2).astype(self.kind), self.kind(np.inf if up else -np.inf))

    def tile(self, i, j) -> np.ndarray:
        return self.a[i] @ self.b[j].T


class JointBounds(Bounds):
    """Bounds of the joint distances by a scale, targets being the last entries; a millionth and more than single precision needs is added."""

    def __init__(self, x: np.ndarray, y: np.ndarray, scale: tuple[float, float], high: bool = False):
        super().__init__(x[:, :-1], y[:, :-1], high)
        self.by, self.more = self.unit / (scale[0] if scale[0] > 0 else 1.0), 2e-6 if high else -2e-6
        low = min(x[:, -1].min(initial=np.inf), y[:, -1].min(initial=np.inf))
        self.u, self.v = (((z[:, -1] - low) / (scale[1] if scale[1] > 0 else 1.0)).astype(np.float32) for z in (x, y))

    def limit(self, d: np.ndarray | float, up: bool) -> np.ndarray:
        return np.nextafter(np.asarray(d, np.float64).astype(np.float32), np.float32(np.inf if up else -np.inf))

    def tile(self, i, j) -> np.ndarray:
        far = super().tile(i, j)
        np.sqrt(np.maximum(far, 0, out=far), out=far)
        far *= np.float32(self.by * (1 + self.more))
        far += np.abs(self.u[i][:, None] - self.v[j][None])
        return far + np.float32(self.more)


def bounds(x: np.ndarray, y: np.ndarray, scale: tuple[float, float] | None, high: bool = False) -> Bounds:
    return Bounds(x, y, high) if scale is None else JointBounds(x, y, scale, high)


def distinct(x: np.ndarray) -> np.ndarray:
    """The first row of each of equal ones."""
    raw, width, seen = np.ascontiguousarray(x).tobytes(), x.shape[1] * 8, {}
    for i in range(len(x)):
        seen.setdefault(raw[i * width : (i + 1) * width], i)
    return np.fromiter(seen.values(), np.int64, len(seen))
