"""Secret scans in DataFrame functions only: base patterns and a character Markov model.

Base spans come from three patterns (see BASE). Besides them, every token of TOKEN's form is
scored by two first-order character Markov chains, one of random strings and one of ordinary
identifiers: sum over its character pairs of log p_random(b | a) - log p_ordinary(b | a). Both
chains are counted from labelled samples taken from the documents themselves: strings that a
base pattern reports are labelled random, plain words are labelled ordinary. The result is 128 x 128
integers (hundredths of a nat), a table of fixed size, put into the plan as one array literal.

Positions are code points. Spark has no function for match positions, so they are summed up
from the lengths of the pieces between matches (split) and of the matches (regexp_extract_all),
which alternate. Patterns run only where a cheaper test of the same text found something.
Arrays are gone through in blocks of BLOCK (see _scan), so a text of any length and number of spans costs about
its length: no step copies all that was found before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, reported group, least length of that group.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
#: What a row must show before a base pattern is run on it (each follows from the pattern and its least length).
BASE_TEST = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
MARKOV = "markov"
#: Tokens that the Markov model judges.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: A token is a secret if its mean log-likelihood ratio per character pair reaches this (hundredths of a nat).
MIN_MEAN = 60
_ONE = "struct<start:int,end:int,kind:int,text:string>"
_SPAN = f"array<{_ONE}>"
_SIZE = 128
#: Elements of an array that one inner fold goes through.
BLOCK = 64


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once a row: a lambda's argument is, what a lambda refers to is not."""
    return F.get(F.transform(F.array(value), f), 0)


def _scan(rows: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """The outputs, of type `kind`, of (state, output) = step(state, row) over an array; `last` makes one more of the final state.

    Outputs are put together in blocks and these joined at the end, so the work is linear up to some ten thousand rows.
    """
    none = F.array().cast(f"array<{kind}>")
    pack = lambda s, out: F.struct(s.alias("state"), out.alias("out"))

    def one(acc: Column, row: Column) -> Column:
        return _once(F.struct(*[c.alias(n) for c, n in zip(step(acc["state"], row), ("state", "out"), strict=True)]), lambda r: pack(r["state"], F.concat(acc["out"], F.array(r["out"]))))

    def whole(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
        block = lambda acc, part: F.aggregate(part, pack(acc["state"], none), one, lambda r: pack(r["state"], F.concat(acc["out"], F.array(r["out"]))))
        end = (lambda r: F.concat(F.flatten(r["out"]), F.array(last(r["state"])))) if last else lambda r: F.flatten(r["out"])
        return F.when(F.size(rows) > 0, F.aggregate(parts, pack(state, F.array().cast(f"array<array<{kind}>>")), block, end)).otherwise(none)

    return _once(rows, whole)


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, test: str) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose group has at least `least` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(whole, lambda m: F.length(m)).alias("n"), F.transform(F.slice(between, 1, F.size(whole)), lambda p: F.length(p)).alias("gap"), judged.alias("text"))

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        begin = at + row["gap"]
        end = begin + row["n"]
        return end, F.when(F.length(row["text"]) >= least, F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), row["text"].alias("text")))

    spans = F.filter(_scan(rows, F.lit(0), _ONE, step), lambda s: s.isNotNull())
    return F.when(text.rlike(test), spans).otherwise(F.array().cast(_SPAN))


def _pattern(kind: str, pattern: str) -> str:
    # hex: a match is a maximal run, so asking for its least length at once finds the same spans and skips short runs
    return r"[0-9a-f]{16,}" if kind == "hex" else pattern


def base_spans(text: Column) -> list[Column]:
    return [_matches(text, i, _pattern(kind, p), group, least, BASE_TEST[kind]) for i, (kind, p, group, least) in enumerate(BASE)]


def _codes(string: Column) -> Column:
    """Code points of a string's characters."""
    return F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _pairs(strings: Column) -> Column:
    """Codes a * 128 + b of all neighbouring characters of ASCII strings."""
    pair = lambda codes: F.transform(F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.get(codes, i) * _SIZE + F.get(codes, i + 1))
    return F.flatten(F.transform(F.filter(strings, lambda s: F.length(s) >= 2), lambda s: _once(_codes(s), pair)))


def train(docs: DataFrame, sample_docs: int = 4_000, seed: int = 11) -> list[int]:
    """128 x 128 log-likelihood ratios in hundredths of a nat, row by row.

    Labelled samples: about `sample_docs` documents picked by a hash of their text (all, where
    there are fewer; the documented bound of the fit) give the ordinary words, and about five times as
    many of the rows that a base pattern matches give the random strings. Without samples of a kind its chain is flat;
    without any, the ratio is 0 throughout and nothing is reported.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("text"))
    total = rows.count()
    unit = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) / 1e6
    share = sample_docs / max(1, total)
    ordinary = rows.where(unit < share).select(F.lit("ordinary").alias("label"), F.explode(_pairs(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]+"), F.lit(0)))).alias("pair"))
    found = F.concat(*base_spans(F.col("text")))
    strings = F.transform(found, lambda s: F.regexp_extract(s["text"], r"^[A-Za-z0-9+/_=-]+", 0))
    random = rows.where(unit < 5 * share).select(F.lit("random").alias("label"), F.explode(_pairs(strings)).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in ordinary.unionAll(random).where(f"pair between 0 and {_SIZE * _SIZE - 1}").groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    logs = {k: _log_chain([[counts.get((k, a * _SIZE + b), 0) for b in range(_SIZE)] for a in range(_SIZE)]) for k in ("random", "ordinary")}
    return [round(100 * (r - o)) for r, o in zip(logs["random"], logs["ordinary"], strict=True)]


def _log_chain(counts: list[list[int]], weight: float = 5.0) -> list[float]:
    """log p(b | a), row by row: pair counts backed by `weight` draws from the characters' own frequencies."""
    single = [sum(column) + 0.5 for column in zip(*counts, strict=True)]
    total = sum(single)
    return [math.log((n + weight * single[b] / total) / (sum(row) + weight)) for row in counts for b, n in enumerate(row)]


def _ratio(token: Column, model: Column) -> Column:
    """Sum of a token's log-likelihood ratios over its character pairs."""
    step = lambda acc, c: F.struct(c.alias("was"), (acc["sum"] + F.when(acc["was"] >= 0, F.get(model, acc["was"] * _SIZE + c)).otherwise(0)).alias("sum"))
    return F.aggregate(_codes(token), F.struct(F.lit(-1).alias("was"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"])


def _clear(tokens: Column, base: Column) -> Column:
    """Of sorted tokens that don't overlap each other, those that overlap no base span: one sweep over both by start.

    far: the furthest end of a base span so far; wait: the last token, which a base span may still meet.
    """
    none = F.lit(None).cast(_ONE)
    state = lambda far, wait: F.struct(far.alias("far"), wait.alias("wait"))

    def step(s: Column, e: Column) -> tuple[Column, Column]:
        is_token, met = e["kind"] == len(BASE), e["start"] < s["wait"]["end"]
        kept = F.when(is_token | ~F.coalesce(met, F.lit(False)), s["wait"])  # decided: clear unless this base span meets it
        wait = F.when(is_token & (s["far"] <= e["start"]), e).otherwise(none)
        return state(F.when(is_token, s["far"]).otherwise(F.greatest(s["far"], e["end"])), wait), kept

    both = F.array_sort(F.concat(base, tokens))
    swept = F.filter(_scan(both, state(F.lit(0), none), _ONE, step, lambda s: s["wait"]), lambda s: s.isNotNull())
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), swept).otherwise(tokens)


def scan(docs: DataFrame, model: list[int], carry: list[Column] | None = None) -> DataFrame:
    """Carried columns (default doc_id) and `base` and `extra`: spans (start, end, kind, text) sorted by start.

    `extra` are tokens that the model takes for random strings and that overlap no base span.
    A null text counts as empty: no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    rows = docs.select(*(carry or [F.col("doc_id")]), text.alias("__text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*base_spans(F.col("__text")))))
    rows = rows.withColumn("__token", _matches(F.col("__text"), len(BASE), TOKEN, 0, 20, r"[A-Za-z0-9+/_=-]{20}"))
    odd = lambda s: _ratio(s["text"], weights) >= MIN_MEAN * (F.length(s["text"]) - 1)
    return rows.withColumn("extra", _once(F.filter("__token", odd), lambda tokens: _clear(tokens, F.col("base")))).drop("__token")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """Per row of docs: counts of base spans by kind, their digest and the list of all spans."""
    found = scan(docs, model or train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    by_place = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], s["text"]))
    ordered = lambda c: F.array_sort(by_place(c))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(_listed(ordered(F.col("base"))), 256).alias("base_sha256"),
        _listed(ordered(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, model: list[int] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All rows of docs, columns unchanged, with every span of text replaced by `mark`; overlapping spans become one."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    found = scan(docs, model or train(docs), [F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text, spans = F.col("__text"), F.array_sort(F.concat("base", "extra"))
    gap = lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("low"), s["start"].alias("high"))))
    gaps = F.filter(_scan(spans, F.lit(0), "struct<low:int,high:int>", gap), lambda g: g.isNotNull())  # what stays in front of each mark

    def stretch(part: Column) -> Column:
        """A block of gaps cuts its stretch of the text out once and counts positions from there."""
        low = F.get(part, 0)["low"]
        whole = F.struct(low.alias("low"), F.substr(text, low + 1, F.get(part, F.size(part) - 1)["high"] - low).alias("text"))
        return _once(whole, lambda w: F.array_join(F.transform(part, lambda g: F.concat(F.substr(w["text"], g["low"] - w["low"] + 1, g["high"] - g["low"]), F.lit(mark))), ""))

    in_blocks = lambda gaps: F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / BLOCK).cast("int")), lambda b: F.slice(gaps, b * BLOCK + 1, F.lit(BLOCK)))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    clean = F.concat(_once(gaps, lambda gaps: F.array_join(F.transform(in_blocks(gaps), stretch), "")), F.substr(text, end + 1, F.length(text)))
    found = found.withColumn("__clean", F.when(F.size(spans) > 0, clean).otherwise(text))
    return found.select(*[(F.when(F.col(n).isNotNull(), F.col("__clean")) if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])
