"""Benchmark decontamination by pigeonhole edit matching.

An item of m normalised characters may be matched with e = floor(m * error_rate) edits. Cut
into e + 1 pieces, at least one of them occurs unchanged in any text that holds the item within
e edits. One Aho-Corasick pass finds the pieces; around each hit, Myers' bit-parallel recurrence
(one machine word as wide as the item) gives the least distance of the item to any substring.

Text and items are compared in lower case with white-space runs as one space. The items are the
stated query set: they are sent to the executors in blocks of bounded size, and every document
is held against every block, whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import map_arrow

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of items that one block may hold, on average: the bound of what is broadcast.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and the first end (exclusive) of such a substring."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # row 0 costs nothing: a match may start anywhere
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, at + 1
    return best, end


def pieces(item: str, error_rate: float) -> list[tuple[int, str]]:
    """floor(m * error_rate) + 1 pieces that cover the item, with their offsets."""
    n = int(len(item) * error_rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(k, t) for k, t in items if t]
        self.budget = [int(len(t) * error_rate) for _, t in self.items]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, error_rate):
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def find(self, text: str) -> dict[int, int]:
        """Items (by place in self.items) within their budget, with the least distance."""
        if self.empty or not text:
            return {}
        regions: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                k = self.budget[i]
                start = end + 1 - size - offset  # where the item would start without edits
                low, high = max(0, start - k), start + len(self.items[i][1]) + k
                spans = regions.setdefault(i, [])
                if spans and spans[-1][0] <= low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        found: dict[int, int] = {}
        for i, spans in regions.items():
            for low, high in spans:
                if found.get(i) == 0:
                    break
                window = text[low:high]
                distance = 0 if self.items[i][1] in window else myers(self.items[i][1], window)[0]
                if distance <= self.budget[i]:
                    found[i] = min(distance, found.get(i, distance))
        return found


def _blocks(items: DataFrame, error_rate: float) -> Iterator[Matcher]:
    """Matchers over all non-null items, in as many blocks as their characters need."""
    rows = items.select("item_id", "text").where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_CHARS
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield Matcher(sorted((r["item_id"], normal(r["text"])) for r in part.collect()), error_rate)


_matchers: dict = {}


def _load(shared, key: str) -> Matcher:
    """The automaton is rebuilt once a worker from the broadcast items."""
    if key not in _matchers:
        if len(_matchers) > 3:
            _matchers.clear()
        _matchers[key] = Matcher(*shared.value)
    return _matchers[key]


def _broadcast(docs: DataFrame, items: DataFrame, error_rate: float):
    import uuid

    for matcher in _blocks(items, error_rate):
        yield docs.sparkSession.sparkContext.broadcast((matcher.items, error_rate)), uuid.uuid4().hex


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget): every document that holds a whole item within its budget.

    Null texts hold nothing; null or empty items match nothing; items of fewer than
    1 / error_rate characters must occur exactly. One row for each document row and item.
    """
    out = None
    for shared, key in _broadcast(docs, items, error_rate):

        def rows(batches: Iterator[dict], shared=shared, key=key) -> Iterator[dict]:
            m = _load(shared, key)
            for cols in batches:
                hits = [(d, m.items[i][0], k, m.budget[i]) for d, t in zip(cols["doc_id"], cols["text"], strict=True) for i, k in sorted(m.find(normal(t)).items())]
                yield {n: [h[j] for h in hits] for j, n in enumerate(("doc_id", "item_id", "distance", "budget"))}

        part = map_arrow(docs, ["doc_id", "text"], "doc_id long, item_id long, distance long, budget long", rows)
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """Rows of docs, columns unchanged, that hold no item within its budget; one pass a block, no shuffle."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    out = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text").alias("__text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    for shared, key in _broadcast(docs, items, error_rate):

        def rows(batches: Iterator[dict], shared=shared, key=key) -> Iterator[dict]:
            m = _load(shared, key)
            for cols in batches:
                keep = [i for i, t in enumerate(cols["__text"]) if not m.find(normal(t))]
                yield {c: [v[i] for i in keep] for c, v in cols.items()}

        out = map_arrow(out, out.columns, fields, rows)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
