"""Exact substring dedup with a log-structured fingerprint index.

A window is WINDOW words in a row; its fingerprint has 64 bits. The index is a list of immutable
runs, each a table bucketed by the fingerprints' leading bits, holding sorted fingerprints with the least doc_id
that had them. A batch of documents goes through these steps:

* pack: texts are laid down in chunks of a few MB (a table of compressed rows);
* fingerprint: each chunk sends each bucket its sorted distinct fingerprints, one entry for a
  fingerprint however many of its documents hold it, so no window is hot beyond one row a chunk;
* merge-join: each bucket merges the chunks' entries with the runs and sends a chunk the
  fingerprints whose least doc_id lies outside and below the chunk's own;
* mark: chunks are joined with their answers, windows are hashed again, words under repeated windows go.

The merged entries become a new run, and when there are `fanout` runs they are compacted into one.
Fingerprints are verified by a second, independent hash of CHECK_BITS bits that travels with each: windows
count as equal only where both agree. Among n different windows some pair agrees in both with
probability about n * n / 2**81, 3e-5 at 8 billion windows (30 GB of tables).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import hash_texts, map_arrow, materialize, mix, own_id, shared_dir, shuffles_freed, with_id

WINDOW = 13
CHUNK_BYTES = 4 << 20
#: Fingerprints a bucket should hold.
BUCKET_ENTRIES = 2_000_000
CHECK_BITS = 16
#: Quantiles of doc_id at which dedup() starts another batch. What comes before the last is written as runs, and once more when they are compacted.
BATCH_CUTS = [0.05, 0.1, 0.2]
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_R = np.uint64(0x165667B19E3779F9)


# ---- packed forms -------------------------------------------------------------------------


def _pack_texts(ids: list[int], texts: list[bytes]) -> bytes:
    head = np.array([len(ids), *ids, *map(len, texts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=4).compress(head + b"".join(texts))


def _unpack_texts(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * n)
    ends = np.cumsum(head[1 + n :]) + 8 * len(head)
    return head[1 : 1 + n], [data[e - s : e] for e, s in zip(ends.tolist(), head[1 + n :].tolist(), strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of the numbers, so that equal high bytes lie together."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(kind).reshape(n)


def _pack_entries(prints: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, their checks, ids as places in a sorted list."""
    names, place = np.unique(ids, return_inverse=True)
    head = np.array([len(prints), len(names)], np.int64).tobytes()
    small = np.uint16 if len(names) < 1 << 16 else np.uint32
    step = np.diff(prints, prepend=np.uint64(0))
    body = _planes(step) + _planes(np.diff(names, prepend=np.int64(0))) + _planes(checks) + _planes(place.astype(small))
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def _unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    at = np.cumsum([16, 8 * n, 8 * m, 2 * n]).tolist()
    prints = np.cumsum(_unplanes(data[at[0] : at[1]], np.uint64, n), dtype=np.uint64)
    names = np.cumsum(_unplanes(data[at[1] : at[2]], np.int64, m))
    place = _unplanes(data[at[3] :], np.uint16 if m < 1 << 16 else np.uint32, n)
    return prints, _unplanes(data[at[2] : at[3]], np.uint16, n), names[place]


def _pack_answers(prints: np.ndarray, checks: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(prints, prepend=np.uint64(0))) + _planes(checks))


def _unpack_answers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(data) // 10
    return np.cumsum(_unplanes(data[: 8 * n], np.uint64, n), dtype=np.uint64), _unplanes(data[8 * n :], np.uint16, n)


# ---- windows ------------------------------------------------------------------------------


def windows(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, check, doc_id and first word's place of each window, and the texts' first words' places (and the end)."""
    words, cuts = hash_texts(texts)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), cuts
    prints, checks, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64), mix(words ^ _R)
    for j in range(WINDOW):
        prints = prints * _Q + words[j : j + n]
        checks = checks * _R + other[j : j + n]
    owner = np.repeat(np.arange(len(ids)), np.diff(cuts))
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    checks = (mix(checks[at]) >> np.uint64(64 - CHECK_BITS)).astype(np.uint16)
    return mix(prints[at]), checks, np.asarray(ids, np.int64)[owner[at]], at, cuts


def _least(prints: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (fingerprint, check) in order, each with its least id."""
    order = np.lexsort((ids, checks, prints))
    prints, checks, ids = prints[order], checks[order], ids[order]
    first = _firsts(prints, checks)
    return prints[first], checks[first], ids[first]


def _firsts(prints: np.ndarray, checks: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])]) if len(prints) else np.zeros(0, bool)


def _places(prints: np.ndarray, checks: np.ndarray, among: np.ndarray, checked: np.ndarray) -> np.ndarray:
    """Place of each (fingerprint, check) in a list sorted by fingerprint, or -1."""
    out = np.full(len(prints), -1)
    if not len(among):
        return out
    first = np.searchsorted(among, prints)
    todo = np.flatnonzero(first < len(among))
    step = 0
    while len(todo):  # more than one turn only where different windows share a fingerprint
        at = first[todo] + step
        todo, at = todo[at < len(among)], at[at < len(among)]
        same = among[at] == prints[todo]
        todo, at = todo[same], at[same]
        good = checked[at] == checks[todo]
        out[todo[good]] = at[good]
        todo = todo[~good]
        step += 1
    return out


# ---- steps --------------------------------------------------------------------------------


def pack(docs: DataFrame, batch: F.Column | None = None) -> DataFrame:
    """Written table (chunk, batch, n_words, blob) of all rows of docs; batch is a Column or 0."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        held: dict[int, tuple[list, list]] = {}
        size: dict[int, int] = {}
        made = 0

        def flush(b: int) -> dict:
            nonlocal made
            made += 1
            ids, texts = held.pop(b)
            size.pop(b)
            return {"chunk": [f"{part}-{made}"], "batch": [b], "n_words": [sum(len(t.split()) for t in texts)], "blob": [_pack_texts(ids, texts)]}

        for cols in batches:
            for i, t, b in zip(cols["doc_id"], cols["text"], cols["batch"], strict=True):
                data = (t or "").encode()
                ids, texts = held.setdefault(b, ([], []))
                ids.append(i)
                texts.append(data)
                size[b] = size.get(b, 0) + len(data) + 64
                if size[b] >= CHUNK_BYTES:
                    yield flush(b)
        for b in list(held):
            yield flush(b)

    rows_in = with_id(docs).withColumn("batch", F.lit(0) if batch is None else batch)
    return materialize(map_arrow(rows_in, ["doc_id", "text", "batch"], "chunk string, batch int, n_words long, blob binary", rows), "packed")


def fingerprints(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, chunk, data): each chunk's distinct fingerprints with their least doc_id, cut by leading bits."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            for chunk, blob in zip(cols["chunk"], cols["blob"], strict=True):
                prints, checks, ids, _, _ = windows(*_unpack_texts(blob))
                prints, checks, ids = _least(prints, checks, ids)
                bucket = ((prints >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(cuts)).tolist()
                for at in range(0, len(full), 64):
                    some = full[at : at + 64]
                    yield {"bucket": some, "chunk": [chunk] * len(some), "data": [_pack_entries(*(x[cuts[b] : cuts[b + 1]] for x in (prints, checks, ids))) for b in some]}

    return map_arrow(packed, ["chunk", "blob"], "bucket int, chunk string, data binary", rows)


def _join_bucket(new: pd.DataFrame, old: pd.DataFrame, keep_run: bool) -> pd.DataFrame:
    """Merge one bucket: answers for the chunks (kind dup) and the new entries (kind run)."""
    parts = [_unpack_entries(x) for x in new["data"]] + [_unpack_entries(x) for x in old["data"]]
    prints, checks, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.lexsort((ids, checks, prints))
    prints, checks, ids, source = prints[order], checks[order], ids[order], source[order]
    first = _firsts(prints, checks)
    least = ids[np.flatnonzero(first)[np.cumsum(first) - 1]]
    repeated = (ids > least) & (source < len(new))
    chunks = new["chunk"].to_numpy()
    bucket = int(new["bucket"].iloc[0])
    out = []
    p, c, s = prints[repeated], checks[repeated], source[repeated]
    for k in np.unique(s).tolist():
        out.append(("dup", bucket, chunks[k], _pack_answers(p[s == k], c[s == k])))
    if keep_run:
        fresh = first & (source < len(new))  # what an old run has with a smaller id needs no second entry
        out.append(("run", bucket, "", _pack_entries(prints[fresh], checks[fresh], ids[fresh])))
    return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "data"])


def _merge_runs(entries: pd.DataFrame) -> pd.DataFrame:
    parts = [_unpack_entries(x) for x in entries["data"]]
    merged = _least(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
    return pd.DataFrame({"kind": ["run"], "bucket": [int(entries["bucket"].iloc[0])], "chunk": [""], "data": [_pack_entries(*merged)]})


class FingerprintIndex:
    """Runs of historical window fingerprints, as bucketed tables in the shared folder."""

    SCHEMA = "kind string, bucket int, chunk string, data binary"

    def __init__(self, spark: SparkSession, n_buckets: int, fanout: int = 3):
        self.spark, self.n_buckets, self.fanout = spark, n_buckets, fanout
        self.files = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []

    def _save(self, df: DataFrame) -> DataFrame:
        name = f"fingerprints_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        with shuffles_freed(self.spark):
            df.write.bucketBy(self.files, "bucket").sortBy("bucket").option("path", path).saveAsTable(name)
        saved = self.spark.table(name)
        saved._written_to = path
        return saved

    def ingest(self, packed: DataFrame, last: bool = False) -> DataFrame:
        """Join a batch with the runs: (chunk, data), the repeated fingerprints of each chunk.

        Unless it is the last batch, its entries become a run; `fanout` runs are compacted to one.
        """
        new = fingerprints(packed, self.n_buckets)
        old = self.spark.createDataFrame([], self.SCHEMA).select("bucket", "data")
        for i, run in enumerate(self.runs):
            entries = run.where("kind = 'run'").select("bucket", "data")
            old = entries if i == 0 else old.unionAll(entries)

        def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a):
                return pd.DataFrame([], columns=["kind", "bucket", "chunk", "data"])
            return _join_bucket(a, b, not last)

        if self.runs:
            merged = new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(join, self.SCHEMA)
        else:
            merged = new.groupBy("bucket").applyInPandas(lambda a: _join_bucket(a, a.iloc[:0], not last), self.SCHEMA)
        saved = self._save(merged)
        answers = saved.where("kind = 'dup'").select("chunk", "data")
        if not last:
            self.runs.append(saved)
            if len(self.runs) >= self.fanout:
                self.compact()
        return answers

    def compact(self) -> None:
        """Merge all runs into one."""
        both = self.runs[0].where("kind = 'run'")
        for run in self.runs[1:]:
            both = both.unionAll(run.where("kind = 'run'"))
        self.runs = [self._save(both.groupBy("bucket").applyInPandas(_merge_runs, self.SCHEMA))]


def _mark(ids: np.ndarray, texts: list[bytes], answers: list[bytes]) -> Iterator[tuple[int, list[bytes], np.ndarray | None]]:
    """Each text's id, words and mask of words to keep (None: all)."""
    prints, checks, owner, at, cuts = windows(ids, texts)
    if len(prints):
        own, own_checks, least = _least(prints, checks, owner)
        bad = owner > least[_places(prints, checks, own, own_checks)]
        if answers:  # one search in all of them: their number grows with that of the buckets
            among, checked = (np.concatenate(x) for x in zip(*map(_unpack_answers, answers), strict=True))
            order = np.argsort(among, kind="stable")
            bad |= _places(prints, checks, among[order], checked[order]) >= 0
        edge = np.zeros(cuts[-1] + 1, np.int64)
        np.add.at(edge, at[bad], 1)
        np.add.at(edge, at[bad] + WINDOW, -1)
        keep = np.cumsum(edge)[:-1] == 0
    for i, (k, t) in enumerate(zip(ids.tolist(), texts, strict=True)):
        mask = keep[cuts[i] : cuts[i + 1]] if len(prints) else None
        yield k, t.split(), None if mask is None or mask.all() else mask


def dedup(docs: DataFrame, batches: list[float] | None = None, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 (and the kept text, if asked for).

    Documents are taken in batches of ascending doc_id, cut at these quantiles of it (four batches by default, three
    of which become runs that are compacted before the last one joins), so that a window's earlier holder is in the history, or in
    the batch with a smaller doc_id. A null text has no words; a text of any length is one row of one chunk. Rows with a null doc_id come after all others, rows that repeat a
    doc_id do not remove from each other.
    """
    spark = docs.sparkSession
    quantiles = BATCH_CUTS if batches is None else batches
    cuts = docs.agg(F.percentile_approx("doc_id", quantiles or [0.5], 1000)).first()[0] or []
    batch = F.lit(0)
    for c in cuts if quantiles else []:
        batch = batch + (F.col("doc_id") > c).cast("int")
    packed = pack(docs, batch)
    words = packed.agg(F.sum("n_words")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = FingerprintIndex(spark, max(parts, -(-words // BUCKET_ENTRIES)))
    answers = None
    for b in range(len(quantiles) + 1):
        found = index.ingest(packed.where(F.col("batch") == b), last=b == len(quantiles))
        answers = found if answers is None else answers.unionAll(found)
    answers = answers.groupBy("chunk").agg(F.collect_list("data").alias("answers"))
    joined = packed.select("chunk", "blob").join(answers, "chunk", "left")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            for blob, given in zip(cols["blob"], cols["answers"], strict=True):
                out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
                for k, words, mask in _mark(*_unpack_texts(blob), given or []):
                    kept = words if mask is None else list(compress(words, mask.tolist()))
                    text = b" ".join(kept)
                    for c, v in zip(out, (k, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None), strict=True):
                        out[c].append(v)
                yield out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    done = map_arrow(joined, ["blob", "answers"], schema, rows)
    return done.select(own_id(), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)
