"""Quality by importance resampling (Xie et al., 2023): hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models over BUCKETS hash buckets (words and word pairs) are counted: raw over all documents, target
over labelled documents of quality. A document's log weight is the sum over its n-grams of
log p_target - log p_raw. Adding Gumbel noise and keeping the k largest samples k documents without replacement
in proportion to their weights. k follows from the labels: it is that share of all documents which has quality among the labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import NO_ID, blocks, hash_texts, map_arrow, materialize, mix, own_id, powers

BUCKETS = 10_000
#: Labelled target rows the target model is fitted on, at most; their ids (8 bytes each) are broadcast.
MAX_TARGET = 5_000
_Q = np.uint64(0x9FB21C651E98DF25)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, text by text, and where each text's begin (and the end)."""
    words, cuts = hash_texts(texts, powers)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
    same = np.flatnonzero(owner[1:] == owner[:-1])
    both = np.concatenate([words, mix(words[same] * _Q + words[same + 1])])
    of = np.concatenate([owner, owner[same]])
    order = np.argsort(of, kind="stable")
    return (both[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(of[order], np.arange(len(texts) + 1))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3) -> np.ndarray:
    """Log ratio of each bucket, counts smoothed by one."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    good = good.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(MAX_TARGET)
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("__id"), "left")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for cols in batches:
            for part in blocks(list(zip(cols["text"], cols["hit"], strict=True)), lambda x: len(x[0] or "")):
                grams, cuts = _grams([(t or "").lower().encode() for t, _ in part])
                raw += np.bincount(grams, minlength=BUCKETS)
                hit = np.repeat([h for _, h in part], np.diff(cuts))
                target += np.bincount(grams[hit], minlength=BUCKETS)
        yield {"bucket": np.arange(BUCKETS), "raw": raw, "target": target}

    marked = marked.select("text", F.col("__id").isNotNull().alias("hit"))
    counts = map_arrow(marked, ["text", "hit"], "bucket int, raw long, target long", rows).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = counts["bucket"].to_numpy(np.int64)
    raw[at] += counts["raw"].to_numpy(np.float64)
    target[at] += counts["target"].to_numpy(np.float64)
    if target.sum() == BUCKETS:  # nothing labelled: no preference
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, model: np.ndarray, seed: int = 3) -> DataFrame:
    """(doc_id, n_grams, log_weight, key): key is the log weight plus Gumbel noise drawn from doc_id."""
    fixed = np.rint(model * (1 << 20)).astype(np.int64)  # fixed point: sums do not depend on the order
    shared = docs.sparkSession.sparkContext.broadcast(fixed)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            n, weight = [], []
            for part in blocks([(t or "").lower().encode() for t in cols["text"]], len):
                grams, cuts = _grams(part)
                total = np.concatenate([[0], np.cumsum(shared.value[grams])])
                n += np.diff(cuts).tolist()
                weight += ((total[cuts[1:]] - total[cuts[:-1]]) / (1 << 20)).tolist()
            yield {"doc_id": cols["doc_id"], "n_grams": n, "log_weight": weight}

    source = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    found = map_arrow(source, ["doc_id", "text"], "doc_id long, n_grams long, log_weight double", rows)
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    found = found.withColumn("log_weight", F.when(F.col("n_grams") == 0, F.lit(float("-inf"))).otherwise(F.col("log_weight")))
    return found.withColumn("key", F.col("log_weight") - F.log(-F.log(unit)))


def top_k(rows: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest key and how many of the rows that have exactly this key belong to the k.

    Bisection by histograms: each pass counts 4096 ranges of what is left, so the driver holds 4096 counts at a time.
    """
    ends = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    low, high, n = ends[0], ends[1], ends[2]
    if k <= 0 or not n:
        return float("inf"), 0
    if k >= n:
        return float("-inf"), 0
    left = k
    while low < high:
        width = (high - low) / 4096
        inside = rows.where(F.col("key").between(low, high))
        place = F.least(F.lit(4095), F.floor((F.col("key") - low) / width)) if width > 0 else F.lit(0)
        found = inside.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["p"]):
            if r["n"] >= left:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low, left


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_grams, log_weight, key and kept: whether it is in the sample.

    Texts without n-grams (null, empty, white space) have the weight 0, log_weight -Infinity, and are never kept. Rows that repeat a doc_id share their noise. Of rows with
    exactly the last key that fits, those are kept whose doc_id is least. Without labels, nothing is preferred and all rows are kept.
    """
    known = labels.agg(F.count(F.when(F.col("quality").isNotNull(), 1)).alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("good")).first()
    share = known["good"] / known["n"] if known["n"] else 1.0
    rows = materialize(weigh(docs, fit(docs, labels)), "weights")
    held = rows.where(F.col("n_grams") > 0)
    k = round(held.count() * share)
    last, room = top_k(held, k)
    ties = held.where(F.col("key") == last).select("doc_id") if room else None
    kept = F.col("key") > last
    if room:
        # ties share a key only by repeating a doc_id or by chance: the doc_id that still fits is found by counting
        if ties.count() > room:
            counts = ties.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").limit(room).agg(F.max("doc_id")).first()[0]
            kept = kept | ((F.col("key") == last) & (F.col("doc_id") <= counts))
        else:
            kept = kept | (F.col("key") == last)
    kept = kept & (F.col("n_grams") > 0)
    return rows.select(own_id(), "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), kept.alias("kept"))
