"""Language ID by prediction by partial matching (PPM).

Per language, byte contexts of order 0 to `order` are counted once over a training sample and
then frozen. A byte seen n times in a context of total t with d distinct followers costs
log2((t + d) / n) bits; an unseen one costs the escape log2((t + d) / d) and is coded in the
next shorter context (escape method C, without exclusion), down to 8 bits at order -1. A
context that a language never saw costs nothing and falls through. Costs are fixed-point
integers, so the sums do not depend on the order of rows or blocks.

Since statistics are frozen, the cost of every (context, byte) pair is worked out once for all
languages: scoring a byte is then one context look-up and one table row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import BLOCK_BYTES, blocks, map_arrow

#: Fixed point: cost units per bit.
UNIT = 4096
UNDETERMINED = "und"
_NOT_LETTERS, _NOT_ASCII_LETTERS = regex.compile(r"\P{L}+"), re.compile(r"[^a-z]+")


def normal(text: str | None) -> bytes:
    """Lower-case letters as UTF-8, every other run as one space; b"" without letters."""
    text = (text or "").lower()
    out = (_NOT_ASCII_LETTERS if text.isascii() else _NOT_LETTERS).sub(" ", text).strip()
    return out.encode() if out else b""


def _counts(train: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, n): how often each (k+1)-byte gram, read as a big-endian number, occurs within a text behind `order` spaces."""

    def grams(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(cols["lang"], cols["text"], strict=True):
                if data := normal(text):
                    by.setdefault(lang, []).append(b" " * order + data + b" ")
            for lang, texts in by.items():
                for part in blocks(texts, len):
                    data = np.frombuffer(b"".join(part), np.uint8).astype(np.int64)
                    sizes = np.fromiter(map(len, part), np.int64, len(part))
                    coded = np.ones(len(data), bool)  # a text's padding is context, never coded
                    coded[((np.cumsum(sizes) - sizes)[:, None] + np.arange(order)).ravel()] = False
                    at = np.flatnonzero(coded)
                    for k in range(order + 1):
                        code = np.zeros(len(at), np.int64)
                        for j in range(k + 1):
                            code = code << 8 | data[at - k + j]
                        gram, n = np.unique(code, return_counts=True)
                        yield {"lang": [lang] * len(gram), "k": [k] * len(gram), "gram": gram, "n": n}

    parts = map_arrow(train, ["lang", "text"], "lang string, k int, gram long, n long", grams)
    return parts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen cost tables: node of each context, byte classes, cost[node * classes + class, language]."""

    def __init__(self, langs: list[str], order: int, counts, max_nodes: int):
        self.langs, self.order, self.key = langs, order, uuid.uuid4().hex
        n_langs = len(langs)
        index = {x: i for i, x in enumerate(langs)}
        lang = np.array([index[x] for x in counts["lang"]], np.int64)
        k_of, gram, n = (np.asarray(counts[c], np.int64) for c in ("k", "gram", "n"))
        seen = np.unique(gram[k_of == 0])
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        self.width, self.codes, tables = width, [], []
        parent_codes = np.zeros(1, np.int64)
        for k in range(order + 1):
            pick = k_of == k
            context, byte = gram[pick] >> 8, self.classes[gram[pick] & 255]
            codes, totals = np.unique(context, return_inverse=True)
            if k and len(codes) > max_nodes:  # the model's size: only the most frequent contexts stay
                weight = np.bincount(totals, n[pick])
                codes = np.sort(codes[np.lexsort((codes, -weight))[:max_nodes]])
            keep = np.isin(context, codes)
            node = np.searchsorted(codes, context[keep])
            count = np.zeros((len(codes), width, n_langs))
            np.add.at(count, (node, byte[keep], lang[pick][keep]), n[pick][keep])
            total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            if k == 0:
                lower = np.full((len(codes), width, n_langs), 8.0)
            else:
                short = codes & ((1 << 8 * (k - 1)) - 1)
                at = np.minimum(np.searchsorted(parent_codes, short), len(parent_codes) - 1)
                # a kept context whose shorter form was pruned cannot occur: shorter forms are at least as frequent
                lower = tables[-1][at]
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log2((total + distinct) / count)
                escape = np.log2((total + distinct) / distinct) + lower
            tables.append(np.where(total == 0, lower, np.where(count > 0, own, escape)))
            self.codes.append(codes)
            parent_codes = codes
        self.cost = np.rint(np.concatenate([t.reshape(-1, n_langs) for t in tables]) * UNIT).astype(np.int32) if n_langs else None

    def nodes(self) -> np.ndarray:
        """For each value of the last three bytes, the longest known context's node."""
        out = np.zeros((256, 256, 256), np.int32)
        first = 0
        for k, codes in enumerate(self.codes):
            ids = np.arange(first, first + len(codes), dtype=np.int32)
            if k == 1:
                out[:, :, codes] = ids
            elif k == 2:
                out[:, codes >> 8, codes & 255] = ids
            elif k == 3:
                out[codes >> 16, codes >> 8 & 255, codes & 255] = ids
            first += len(codes)
        return out.reshape(-1)

    def score(self, texts: list[bytes], nodes: np.ndarray) -> np.ndarray:
        """Code lengths in units, one row a text and one column a language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        padded = [b"   " + t + b" " for t in texts]
        data = np.frombuffer(b"".join(padded), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))
        for at in range(3, len(data), BLOCK_BYTES):  # long texts go block by block too
            end = min(len(data), at + BLOCK_BYTES)
            part = data[at - 3 : end].astype(np.int32)
            row = nodes[part[:-3] << 16 | part[1:-2] << 8 | part[2:-1]] * self.width + self.classes[part[3:]]
            cost = self.cost[row]
            owner = np.searchsorted(ends, np.arange(at, end), side="right")
            for j in np.flatnonzero((ends > at - 3) & (ends <= end + 3)):  # the padding in front of a text is not its own
                cost[max(0, ends[j] - at) : max(0, ends[j] + 3 - at)] = 0
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            np.add.at(out, owner[cuts], np.add.reduceat(cost, cuts, axis=0, dtype=np.int64))
        return out


_nodes: dict[str, np.ndarray] = {}


def train(labelled: DataFrame, order: int = 3, sample_per_lang: int = 600, max_nodes: int = 12_000, seed: int = 7) -> Model:
    """Fit on rows (doc_id, text, lang) with a non-null lang and text.

    A language with more than `sample_per_lang` rows gives about that many, picked by a hash
    of doc_id: the documented bound of the fit. `max_nodes` bounds the contexts kept per order.
    order: at most 3, the bytes that the table of contexts is indexed by.
    """
    if not 0 <= order <= 3:
        raise ValueError("the order must be 0 to 3")
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(x for x in found if x)
    share = F.lit(0.0)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(sample_per_lang / found[x])).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    counts = _counts(rows.where(unit < share), order).toPandas() if langs else {"lang": [], "k": [], "gram": [], "n": []}
    with_grams = sorted(set(counts["lang"]))
    return Model(with_grams, order, counts, max_nodes)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """docs' `carry` columns (default doc_id), lang_pred, score and bits_per_byte.

    `und` with score 0 where the text is null or without letters, or no language was learned.
    score is the winner's share of 2 ** -(bits per byte) over the languages; equal code
    lengths go to the first language by name.
    """
    carry = carry or ["doc_id"]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        if m.langs and m.key not in _nodes:
            _nodes.clear()
            _nodes[m.key] = m.nodes()
        for cols in batches:
            texts = [normal(t) for t in cols.pop("__text")]
            langs, scores, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            have = [i for i, t in enumerate(texts) if t] if m.langs else []
            for part in blocks(have, lambda i: len(texts[i])):
                cost = m.score([texts[i] for i in part], _nodes[m.key])
                size = np.array([len(texts[i]) + 1 for i in part])
                best = cost.argmin(1)
                rate = cost / UNIT / size[:, None]
                score = 1 / np.exp2(rate.min(1, keepdims=True) - rate).sum(1)
                for i, b, s, r in zip(part, best.tolist(), score.tolist(), rate.min(1).tolist(), strict=True):
                    langs[i], scores[i], bits[i] = m.langs[b], round(s, 9), round(r, 6)
            yield cols | {"lang_pred": langs, "score": scores, "bits_per_byte": bits}

    source = docs.select(*carry, F.col("text").alias("__text"))
    return map_arrow(source, [*carry, "__text"], f"{fields}, lang_pred string, score double, bits_per_byte double", rows)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents outside fold 0 and predict every document (see predict)."""
    model = train(docs.where(fold(F.col("doc_id")) != 0))
    return predict(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte"
    )


def keep_identified(docs: DataFrame, min_score: float = 0.0, max_bits: float = 7.0, evidence: float = 100.0) -> DataFrame:
    """Rows of docs, columns unchanged, whose language was determined with at least `min_score`.

    A text that even the best language's model codes at more than `max_bits` a byte, by `evidence` bits or more over the
    whole text, is in none of the languages (unpredictable bytes cost 8): encoded data, gibberish, languages not
    learned. Short texts lack the evidence and stay. Where no row is labelled there is nothing to learn: every text with a letter stays.
    """
    model = train(docs.where(fold(F.col("doc_id")) != 0))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)], F.octet_length("text").alias("__bytes"), F.col("text"))
    scored = predict(out, model, carry=[*(f"__{i}" for i in range(len(docs.columns))), "__bytes"])
    foreign = (F.col("bits_per_byte") - max_bits) * F.col("__bytes") >= evidence
    return scored.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score) & ~foreign).select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)]
    )
