"""Helpers shared by the text operators: shared folders, Arrow maps, word hashing.

Words are runs of bytes other than space and 0x09-0x0D. Their 64-bit hashes are multilinear
sums over whole numpy blocks: each place in a word has a random multiplier of its own, so no structure of
a word makes it collide with another (powers of one base would), and hashing costs no Python step per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal id of rows without one; they sort after all others and are returned as null.
NO_ID = (1 << 63) - 1
#: Texts are hashed in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session may do without, by a temporary one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="spectraloom-")
    return f"file://{_own_dir}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files as they end; without it these stay until the driver's garbage is collected.

    Later steps read the written table, so a lost executor never needs those files.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for tables that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python worker holds as Python objects at a time.
SLICE_ROWS = 2_000


def map_arrow(df: DataFrame, columns: list[str], schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """mapInArrow over dicts of Python lists, one dict for each SLICE_ROWS rows; only `columns` are read."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for cols in rows(b.slice(at, SLICE_ROWS).to_pydict() for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            yield pa.RecordBatch.from_pydict(cols, schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "text")


def own_id(name: str = "doc_id"):
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


# ---- word hashing -----------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """Random odd multipliers of the first n places; more places continue the same sequence."""
    return np.random.default_rng(21).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> np.ndarray:
    """Powers of one base: words of one structure may share a hash, which is no matter where hashes only number a model's buckets."""
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_places: dict[Callable, np.ndarray] = {}


def _hash_block(data: np.ndarray, places: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    if lengths.max() > len(_places.get(places, ())):
        _places[places] = places(int(lengths.max()) * 2)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(first, lengths)
    terms = _BYTE[data[~space[1:-1]]] * _places[places][inside]
    sums = np.add.reduceat(terms, first)
    return starts, mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(data: bytes, places: Callable[[int], np.ndarray] = multipliers) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of data, worked in blocks cut at spaces."""
    whole = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(whole):
        end = min(len(whole), at + BLOCK_BYTES)
        while end < len(whole) and not _SPACE[whole[end]]:
            step = np.flatnonzero(_SPACE[whole[end : end + BLOCK_BYTES]])
            end = end + int(step[0]) if len(step) else min(len(whole), end + BLOCK_BYTES)
        s, h = _hash_block(whole[at:end], places)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def hash_texts(texts: list[bytes], places: Callable[[int], np.ndarray] = multipliers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and each text's first word's index (and the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts, hashes = hash_words(b" ".join(texts), places)
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def blocks(items: list, size: Callable[[object], int], most: int = BLOCK_BYTES) -> Iterator[list]:
    """Consecutive items in lists of about `most` bytes."""
    part, total = [], 0
    for x in items:
        part.append(x)
        total += size(x)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part
