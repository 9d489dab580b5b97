"""Phrase collocation mining by Toivonen's sampling algorithm, per language.

A sample proposes frequent words and pairs. A pass over all texts counts the proposals together with their
negative border: all words, the pairs of proposed words, the triples of two proposed pairs (so a
triple needs no proposal of its own). Frequent phrases of the border that were not proposed are failures: they are
added to the proposals, and a further pass counts what is new on the border, until a pass has none.
As the first pass counts every word and the second every pair of frequent words, three passes
always close it; counts are exact whatever the sample held.

Proposals are held as bitmaps of a fixed size. A wrong hit only has a phrase counted in vain, and
what each pass counts is decided by the bitmaps alone, so no phrase is counted twice or missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import arrow_schema, blocks, discard, materialize

#: Words in a phrase at most.
WIDEST = 3
#: Share of the documents that propose, and how often a proposal occurs in them.
SAMPLE, PROPOSED = 0.05, 2
#: Bits (a power of two's exponent) of the bitmaps of words and of pairs.
WORD_BITS, PAIR_BITS = 25, 26
#: Bytes of text counted at a time; tokens that share one numbering (three numbers fit 63 bits).
BLOCK, SEGMENT = 1 << 21, 1 << 20
#: A phrase part is hot if it makes up more than this share of all words: at most 4,096 words and as many pairs.
HOT = 4096
UNKNOWN = "und"

_STOP = b"."
_FOLD = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

COUNTS = "lang string, size int, phrase string, n long"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, and "." where a piece ends."""
    return text.translate(_FOLD).replace(_STOP, b" . ").split()


def _pair_hash(left, right):
    return (left << np.uint64(17) | left >> np.uint64(47)) ^ right


class Proposals:
    """Bitmaps of the proposed words and pairs; no bitmap: everything is proposed."""

    def __init__(self, words: bytes | None = None, pairs: bytes | None = None):
        self.words, self.pairs = (None if x is None else np.frombuffer(x, np.uint8) for x in (words, pairs))

    @staticmethod
    def _held(bitmap, hashes):
        if bitmap is None:
            return np.ones(len(hashes), bool)
        at = hashes & np.uint64(len(bitmap) * 8 - 1)
        return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def border(self, hashes: np.ndarray, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the pair and the triple that start at each place are to be counted; word: whether a place is a word."""
        proposed = (self._held(self.words, hashes)[ids]) & word
        pair = np.zeros(len(ids), bool)
        pair[:-1] = proposed[:-1] & proposed[1:]
        h = hashes[ids]
        known = pair.copy()
        at = np.flatnonzero(pair)
        known[at] = self._held(self.pairs, _pair_hash(h[at], h[at + 1]))
        triple = np.zeros(len(ids), bool)
        triple[:-1] = known[:-1] & known[1:]
        return pair, triple


def _count(found: list[bytes], lang: str, now: Proposals, before: Proposals | None, widest: int) -> Iterator[tuple]:
    """(size, phrases, counts) of the n-grams of one block of tokens that this pass counts and the one before did not."""
    prefix = f"{lang}\0".encode()
    total = 0
    for start in range(0, len(found), SEGMENT):
        part = found[start : start + SEGMENT + WIDEST - 1]  # n-grams that start in the segment may end beyond
        names = list(set(part))
        number = dict(zip(names, range(len(names)), strict=True))
        ids = np.fromiter(map(number.__getitem__, part), np.int64, len(part))
        word = ids != number.get(_STOP, -1)
        starts = np.arange(len(ids)) < SEGMENT
        hashes = np.fromiter((xxhash.xxh64_intdigest(prefix + w, 42) for w in names), np.uint64, len(names))
        strings = pa.array(names, pa.binary())
        if before is None:
            n = np.bincount(ids[word & starts], minlength=len(names))
            total += int(n.sum())
            at = np.flatnonzero(n)
            yield 1, strings.take(pa.array(at)), n[at]
        masks = now.border(hashes, ids, word)
        old = (np.zeros(len(ids), bool),) * 2 if before is None else before.border(hashes, ids, word)
        for size, mask, counted in zip((2, 3), masks, old, strict=True):
            at = np.flatnonzero(mask & ~counted & starts)
            if size > widest or not len(at):
                continue
            bits = np.int64(20 + 1)
            key = ids[at]
            for k in range(1, size):
                key = key << bits | ids[at + k]
            keys, n = np.unique(key, return_counts=True)
            words = [strings.take(pa.array(keys >> bits * k & ((1 << bits) - 1))) for k in reversed(range(size))]
            yield size, pc.binary_join_element_wise(*words, b" "), n
    if before is None:
        yield 0, pa.array([b""]), np.array([total])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about 4 BLOCK bytes of text."""
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    for rows in blocks(range(batch.num_rows), sizes.__getitem__, 4 * BLOCK):
        yield batch.slice(rows[0], len(rows))


def _pass(docs: DataFrame, now: Proposals, before: Proposals | None, widest: int = WIDEST) -> DataFrame:
    """Partial counts: rows of size 0 count all words of a language, the others a phrase."""
    shared = docs.sparkSession.sparkContext.broadcast((now, before))
    out = arrow_schema(docs.sparkSession, COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = shared.value
        for b in (part for batch in batches for part in _slices(batch)):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                texts.setdefault(lang, []).append(text.as_py())
            for lang, own in texts.items():
                for part in blocks(own, len, BLOCK):
                    for size, phrases, n in _count(tokens(b" . ".join(part)), lang, now, before, widest):
                        k = len(n)
                        cols = [pa.array([lang] * k, pa.string()), pa.array(np.full(k, size, np.int32)), phrases.cast(pa.string()), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(cols, schema=out)

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, COUNTS)


def _summed(partial: DataFrame, least: int, tag: str) -> DataFrame:
    """Counts of at least `least`, and the words of each language (size 0)."""
    return materialize(partial.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0)), tag)


def _bitmap(phrases: DataFrame, size: int, bits: int) -> bytes:
    """The bitmap of phrases of one size: 2**bits bits, put together on the executors 64 at a time."""
    hashes = [F.xxhash64(F.concat("lang", F.lit("\0"), F.split("phrase", " ")[k])) for k in range(size)]
    h = hashes[0] if size == 1 else F.shiftleft(hashes[0], 17).bitwiseOR(F.shiftrightunsigned(hashes[0], 47)).bitwiseXOR(hashes[1])
    slots = phrases.where(F.col("size") == size).select(h.bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"))
    longs = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[longs["at"].to_numpy()] = longs["bits"].to_numpy()
    return out.astype("<i8").tobytes()


def _joined(x: bytes, y: bytes) -> bytes:
    return (np.frombuffer(x, np.int64) | np.frombuffer(y, np.int64)).tobytes()


def counts(docs: DataFrame, min_count: int = 10, sample: float = SAMPLE, proposed: int = PROPOSED) -> tuple[DataFrame, int]:
    """Exact counts (lang, size, phrase, n) of all phrases of up to WIDEST words that occur min_count times, and the number of passes.

    Size 0 holds each language's number of words. The table stays in the shared folder.
    """
    chosen = docs.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(10_000)) < int(sample * 10_000))
    seen = _summed(_pass(chosen, Proposals(), None, 2), proposed, "sampled")
    words, pairs = _bitmap(seen, 1, WORD_BITS), _bitmap(seen, 2, PAIR_BITS)
    discard(seen)
    found: list[DataFrame] = []
    before = None
    while True:
        now = Proposals(words, pairs)
        new = _summed(_pass(docs, now, before), min_count, "counted")
        found.append(new)
        more = _joined(words, _bitmap(new, 1, WORD_BITS)), _joined(pairs, _bitmap(new, 2, PAIR_BITS))
        if more == (words, pairs):  # no frequent phrase of the border lacks a proposal: closed
            break
        before, (words, pairs) = now, more
    every = found[0]
    for x in found[1:]:
        every = every.unionAll(x)
    if len(found) == 1:
        return every, 1
    whole = materialize(every, "phrases")
    discard(*found)
    return whole, len(found)


def _looked_up(cuts: DataFrame, parts: DataFrame, hot: DataFrame, part: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Adds the count of the phrase in column `part`: hot parts by a broadcast of at most 2 * HOT rows, the rest by a shuffle.

    A part of share 1 / HOT or less has few phrases of its own, so the shuffled keys are small.
    """
    near = cuts.join(F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))), ["lang", part], "left")
    near = materialize(near, "cuts")
    far = near.where(F.col(name).isNull()).drop(name).join(parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    return near.where(F.col(name).isNotNull()).select(far.columns).unionAll(far), near


def _top(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of each language with their rank: first within 256 and 16 parts of it, so no task orders a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for parts in (256, 16, 1):
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
    return rows.drop("part")


def collocations(docs: DataFrame, min_count: int = 10, inside: int = 50, limit: int = 2000, sample: float = SAMPLE) -> DataFrame:
    """The first `limit` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    docs: doc_id, lang, text; further columns are not read. A null text counts as empty, a null lang as UNKNOWN,
    every row counts as often as it stands there. An empty table, or texts without a phrase that occurs min_count times, give
    no rows. A phrase is left out if a longer candidate holds it and has `inside` percent of its count or more.
    Counts up to 10**15 are exact (a * a * 1000000 fits 38 digits).
    """
    every, _ = counts(docs, min_count, sample)
    parts = every.where(F.col("size").between(1, WIDEST - 1))
    total = every.where(F.col("size") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = parts.where(F.col("n") * HOT > F.lit(total))
    candidates = every.where(F.col("size") > 1)
    word = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("left"), F.array_join(F.slice("words", k + 1, WIDEST), " ").alias("right"))
    cuts = candidates.select("lang", "phrase", "size", F.col("n").alias("a"), word.alias("words"))
    cuts = cuts.select("lang", "phrase", "size", "a", F.explode(F.when(F.col("size") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    cuts, first = _looked_up(cuts, parts, hot, "left", "l")
    cuts, second = _looked_up(cuts, parts, hot, "right", "r")
    score = F.expr("(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    lowest = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    longer = candidates.where(F.col("size") == 3).select("lang", F.explode(F.array(F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))).alias("phrase"), "n")
    longest = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = _top(kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score"), limit)
    words = every.where(F.col("size") == 0).select("lang", "n")
    out = materialize(best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(first, second, every)
    return out
