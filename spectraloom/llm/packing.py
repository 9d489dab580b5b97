"""Best-fit packing of whole documents into sequences by the sum of squares.

Pieces of one length are interchangeable, so the plan needs the lengths' counts alone: at most
`capacity` rows, whatever the corpus. The driver plans on those counts; the pieces themselves
are numbered within their length and look up their place in a distributed join.

The rule: a piece goes where the sum over all gaps of the squared number of open sequences with
that gap becomes smallest; equal sums take the smallest gap. Lengths with BASE**2 pieces or more move by
powers of BASE: BASE**j pieces take the same step at once, into as many equally filled sequences, with the largest j
that leaves BASE steps or more; what remains goes by the smaller powers. So a plan has at most
capacity * (BASE**2 + BASE * POWERS) steps, and small corpora go piece by piece.
"""

from __future__ import annotations

import json
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import arrow_schema, blocks, discard, materialize

CAPACITY = 4096
#: The id that closes a document.
END_ID = 1
BASE = 16
#: Powers of BASE that a count of pieces may need.
POWERS = 14
#: Above any difference of counts.
NEVER = 1 << 62
#: Chunks a worker remembers in each of two generations, and the longest it does (bytes).
MEMO, LONGEST = 1 << 19, 48
#: Bytes of new chunks that the library encodes at a time.
NEW_BYTES = 1 << 18
#: Bytes of text that are encoded together.
BLOCK = 1 << 23

#: Letters whose lower case is one letter and that no normalisation changes (RE2).
_PLAIN = r"^[a-zA-Z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
#: The steps before the model that the short way for words stands for.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_level() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary; a space stays one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    out[shown] = shown
    out[32] = 32
    return out


_SHOWN = _byte_level()


def _listed(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Ids:
    """Ids by the tokenizers library, with the ids of whitespace-free chunks remembered.

    No pre-token crosses white space and no normalisation does, so the ids of a text are those of its chunks one after
    another. Punctuation that ends a chunk of letters is one pre-token: letters and punctuation are looked up apart. New
    letters are lower-cased and shown byte by byte here, and go to the library's model as words of one call; a word's last token
    is known by the vocabulary's end-of-word suffix. Other chunks, and all of a vocabulary with other steps before its model, go to the library as they are.
    """

    def __init__(self, source: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        stated = json.loads(source)
        self.words = None
        # an added token with punctuation before a letter or digit is in no chunk of letters and then punctuation
        if suffix and all(stated.get(k) == v for k, v in _STEPS.items()) and all(re.search(r"[^\w\s]\w", t["content"]) for t in stated.get("added_tokens", ())):
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocab = self.library.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _alone(self, chunks: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        shown = _SHOWN[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        cut = [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
        assert len(cut) == len(words) + 1
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        plain = self._plain(pa.array(new, pa.binary()).cast(pa.string())).to_numpy(zero_copy_only=False)
        found: dict[bytes, bytes] = {}
        for work, chunks in ((self._words, compress(new, plain)), (self._alone, compress(new, ~plain))):
            for part in blocks(chunks, len, NEW_BYTES):
                found.update(zip(part, work(part), strict=True))
        return found

    def _plain(self, chunks: pa.Array) -> pa.Array:
        return pc.match_substring_regex(chunks, _PLAIN) if self.words else pa.repeat(False, len(chunks))

    def _known(self, keys: pa.Array) -> list[bytes]:
        """Ids of keys, each distinct one looked up once."""
        coded = keys.dictionary_encode()
        names = _listed(coded.dictionary)
        young = self.memo
        ids = list(map(young.get, names))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            found = {c: x for c in (names[i] for i in missing) if (x := self.old.get(c)) is not None}
            found |= self._learn([c for i in missing if (c := names[i]) not in found])
            for i in missing:
                ids[i] = found[names[i]]
            young.update((c, x) for c, x in found.items() if len(c) <= LONGEST)
            if len(young) > MEMO:
                self.memo, self.old = {}, young
        return list(map(ids.__getitem__, coded.indices.to_numpy().tolist()))

    def _of(self, chunks: pa.Array) -> list[bytes]:
        """Ids of distinct chunks."""
        bare = pc.ascii_rtrim(chunks, characters=string.punctuation)
        plain = self._plain(bare)
        ids = self._known(pc.if_else(plain, pc.utf8_lower(bare), chunks))
        ended = pc.and_(plain, pc.greater(pc.binary_length(chunks), pc.binary_length(bare)))
        at = np.flatnonzero(ended.to_numpy(zero_copy_only=False)).tolist()
        sizes = pc.binary_length(bare.filter(ended)).to_numpy().tolist()
        tails = [c[n:] for c, n in zip(_listed(chunks.filter(ended)), sizes, strict=True)]
        for i, tail in zip(at, self._known(pa.array(tails, pa.binary()).cast(pa.string())), strict=True):
            ids[i] += tail
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; texts are strings without nulls."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        held = self._of(coded.dictionary.cast(pa.string()))
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        ids, code = np.frombuffer(b"".join(held), "<u4"), coded.indices.to_numpy()
        count = size[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat((np.cumsum(size) - size)[code] - ends[:-1], count) + np.arange(ends[-1])
        raw, bounds = ids[at].tobytes(), (ends[np.asarray(split.offsets) - split.offsets[0].as_py()] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_loaded: dict[str, Ids] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of at most `capacity` ids: a document's ids and end_id, cut only if longer.

    A null or empty text is the one id end_id. Repeated and null doc_ids are documents like any other; further columns are not
    read. part and nth number the pieces of one length within a task: write the result before it is read twice.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    key, end, wide = uuid.uuid4().hex, end_id.to_bytes(4, "little"), capacity * 4
    shared = docs.sparkSession.sparkContext.broadcast(source)
    out = arrow_schema(docs.sparkSession, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Ids(shared.value)
        coder, part, nth = _loaded[key], TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            for rows in blocks(range(len(ids)), sizes.__getitem__, BLOCK):
                block = texts.slice(rows[0], len(rows))
                cols: list[list] = [[] for _ in out]
                for row, found in zip(rows, coder.encode(block), strict=True):
                    found += end
                    for k, at in enumerate(range(0, len(found), wide)):
                        size = min(wide, len(found) - at) // 4
                        for col, v in zip(cols, (ids[row], k, at // 4, size, zlib.crc32(found[at : at + wide]), part, nth[size]), strict=True):
                            col.append(v)
                        nth[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


#: A step puts BASE**power pieces of a length, the `step`-th so many, into sequences from `first` on.
STEP = ("length", "power", "step", "first", "offset")


def _steps(counts: dict[int, int], capacity: int, order: str, opens: bool) -> tuple[np.ndarray, int]:
    """Steps and the number of sequences.

    opens: an empty sequence counts among the places whenever its sum is the smallest, else only if
    no open sequence has room.
    """
    open_by_gap: list[list] = [[] for _ in range(capacity + 1)]
    many = [0] * (capacity + 1)
    # the same counts by the gap that a piece leaves and by the gap that it takes, which none takes without open sequences
    to, off, change = np.zeros(capacity + 1, np.int64), np.full(capacity + 1, -NEVER), np.empty(capacity, np.int64)
    steps, used = array("q"), 0
    for power in reversed(range(POWERS)):
        unit = BASE**power
        number = {s: c // unit % BASE if c >= unit * BASE**2 else c // unit for s, c in counts.items() if power == 0 or c >= unit * BASE}
        items = [(s, i) for s in sorted(number, reverse=True) for i in range(number[s])]
        if order == "mixed":  # all but the smallest tenth in a fixed random order
            head = len(items) - len(items) // 10
            items = [items[i] for i in np.random.default_rng(power).permutation(head)] + items[head:]
        for s, i in items:
            gap, fresh = capacity, True
            if s < capacity:
                # by the change of the sum, divided by 2 * unit, less `unit`
                found = np.subtract(to[: capacity - s], off[s:capacity], out=change[: capacity - s])
                if many[s]:
                    found[0] = unit // 2 - unit - many[s]
                at = int(found.argmin())
                if many[s + at] and not (opens and many[capacity - s] + unit // 2 - unit < found[at]):
                    gap, fresh = s + at, False
            if fresh:
                first, used = used, used + unit
            else:
                group = open_by_gap[gap][-1]
                first = group[0]
                group[0] += unit
                group[1] -= unit
                many[gap] -= unit
                to[gap] = many[gap]
                off[gap] = many[gap] or -NEVER
                if not group[1]:
                    open_by_gap[gap].pop()
            if gap > s:
                open_by_gap[gap - s].append([first, unit])
                many[gap - s] += unit
                to[gap - s] = off[gap - s] = many[gap - s]
            steps.extend((s, power, i, first, capacity - gap))
    return np.array(steps, np.int64).reshape(-1, len(STEP)), used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The steps with the fewest sequences of three runs of the rule: by falling length with new sequences only where none has room,
    and mixed with and without that; the first that reaches the total's lower bound ends the search."""
    least, best = -(-sum(s * c for s, c in counts.items()) // capacity), None
    for order, opens in (("falling", False), ("mixed", True), ("mixed", False)):
        found = _steps(counts, capacity, order, opens)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == least:
            break
    return best[0]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset there, from 0 without gaps.

    Sequences hold at most `capacity` ids. An empty table gives no rows. Null and repeated doc_ids, null and empty texts: see pieces().
    A count of pieces of one length must stay below BASE**(POWERS + 1).
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id), "pieces")
    by_task = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps = plan(totals, capacity)
    places = spark.createDataFrame(pa.table({n: pa.array(steps[:, i]) for i, n in enumerate(STEP)}))

    w = Window.partitionBy("length")
    before = by_task.select("part", "length", (F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), F.sum("n").over(w).alias("total"))
    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))
    unit = {j: F.lit(BASE**j) for j in range(POWERS)}
    ends = {j: F.col("total") - F.col("total") % unit[j] for j in range(POWERS)}  # ranks of power j end here and begin where those of j + 1 end
    takes = {j: F.col("total") >= F.lit(BASE ** (j + 1)) if j else F.lit(True) for j in range(POWERS)}
    power = F.coalesce(*(F.when(takes[j] & (F.col("rank") < ends[j]), F.lit(j)) for j in reversed(range(POWERS)))).cast("long")
    at = F.coalesce(*(F.when(F.col("power") == j, F.col("rank") - (F.when(takes[j + 1], ends[j + 1]).otherwise(0) if j + 1 < POWERS else F.lit(0))) for j in range(POWERS)))
    size = F.coalesce(*(F.when(F.col("power") == j, unit[j]) for j in range(POWERS)))
    placed = (
        ranked.withColumn("power", power)
        .withColumn("at", at)
        .withColumn("size", size)
        .withColumn("step", F.expr("at div size"))
        .join(places, ["length", "power", "step"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at") % F.col("size")).alias("sequence_id"), "offset")
    )
    out = materialize(placed, "packed")
    discard(cut, by_task)
    return out
