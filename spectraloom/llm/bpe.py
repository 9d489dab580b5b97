"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word holds one tree whose leaf i carries rank * size + i of the pair that starts at symbol
i. The minimum at the root is the leftmost lowest-rank merge; applying it changes three leaves,
and each change walks up log2(size) levels. Trees of all new words of a batch are rows of one
numpy matrix, so one step of the loop merges once in every word that still can.

The tokenizer file (public `tokenizers` JSON, BPE with an end-of-word suffix) is read on the
driver and broadcast: its size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from spectraloom.llm.common import blocks, map_arrow

NONE = np.int64(1) << 62
#: Words whose encoding a worker remembers before it starts afresh.
MEMO = 1 << 18
# Unicode's White_Space, as a character class.
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _byte_chars() -> list[str]:
    """Byte-level BPE's printable stand-in of each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def words(text: str) -> list[str]:
    """NFC, lower case by single characters, then the pre-tokenizer's words."""
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    return _WORDS.findall(text.replace("Σ", "σ").lower())  # a lone sigma map, without the final form


class Tokenizer:
    def __init__(self, source: bytes):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        suffix = spec["model"]["end_of_word_suffix"]
        chars = _byte_chars()
        self.base = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.strings = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.memo: dict[str, bytes] = {}

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i] * size + at, NONE)

    def _merge(self, batch: list[bytes], size: int) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of words of at most `size` bytes (a power of two)."""
        n, row = len(batch), np.arange(len(batch))
        length = np.fromiter(map(len, batch), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in batch), np.uint8).reshape(n, size)
        symbol = self.base[raw]
        symbol[row, length - 1] = self.last[raw[row, length - 1]]
        place = np.arange(size)
        alive = place < length[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * size), NONE)
        tree[:, size:-1] = np.where(alive[:, 1:], self._leaves(symbol[:, :-1], symbol[:, 1:], place[:-1], size), NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank, i = np.divmod(tree[live, 1], size)
            gone = after[live, i]
            follow = after[live, gone]
            prior = before[live, i]
            new = self.merged[rank]
            symbol[live, i] = new
            alive[live, gone] = False
            after[live, i] = follow
            more, less = follow < length[live], prior >= 0
            before[live[more], follow[more]] = i[more]
            tree[live, size + gone] = NONE
            tree[live, size + i] = np.where(more, self._leaves(new, symbol[live, np.minimum(follow, size - 1)], i, size), NONE)
            front = np.where(less, prior, gone)
            tree[live, size + front] = np.where(less, self._leaves(symbol[live, front], new, front, size), NONE)
            up = size + np.stack([gone, i, front])
            while up[0, 0] > 1:
                up >>= 1
                tree[live, up] = np.minimum(tree[live, 2 * up], tree[live, 2 * up + 1])
            live = live[tree[live, 1] < NONE]
        flat = symbol[alive].astype("<u4").tobytes()
        cut = np.concatenate([[0], np.cumsum(alive.sum(1))]) * 4
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def learn(self, new: list[str]) -> None:
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            data = w.encode()
            by.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((w, data))
        for size, pairs in by.items():
            for part in blocks(pairs, lambda _, size=size: size, 1 << 16):
                self.memo.update(zip((w for w, _ in part), self._merge([d for _, d in part], size), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        for t in texts:
            pieces = self.split.split(t) if self.split and "<|" in t else [t]
            parts.append([self.special[p].to_bytes(4, "little") if p in self.special else words(p) for p in pieces])
        wanted = {w for pieces in parts for p in pieces if isinstance(p, list) for w in p}
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.learn([w for w in wanted if w not in self.memo])
        get = self.memo.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in pieces) for pieces in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by spaces: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Tokenizer] = {}


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text.

    A null text counts as empty: no tokens, hashes of nothing. Repeated and null doc_ids are
    rows like any other; further columns of docs are not read.
    """
    with open(path, "rb") as f:
        source = f.read()
    spark, key = docs.sparkSession, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(source)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Tokenizer(shared.value)
        t = _loaded[key]
        for cols in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
            for part in blocks([x or "" for x in cols["text"]], len):
                for ids in t.encode(part):
                    text = t.decode(ids)
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append(np.frombuffer(ids, "<u4").tolist())
                        out["decoded"].append(text)
            yield {"doc_id": cols["doc_id"]} | out

    return map_arrow(docs, ["doc_id", "text"], schema + ", ids array<long>, decoded string" * with_ids, rows)
