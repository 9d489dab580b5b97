"""Media columns: interleaved sequences of text and media references, resolved by digest.

HTML parses into ordered items (pos, kind, text, ref, caption). Media live in a content-addressed store (digest,
media); a reference "sha256:<digest>" is resolved by a join on the digest. What is wanted of
a medium is computed on the store's side before the join, so payloads are never shuffled, and one row a digest
travels, however many documents refer to it.

Payloads are stored as binary greymaps (PGM, P5): 8-bit samples, 64 to a row, lossless.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import map_arrow, materialize

WIDTH = 64
ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "embed": "document", "object": "document"}
_BLOCK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "article", "section", "td", "tr", "table", "ul", "ol", "blockquote", "pre"}
_HEADER = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


class _Items(HTMLParser):
    """Text blocks and media references in document order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.hidden = 0

    def _end_text(self) -> None:
        text = " ".join(" ".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in _MEDIA:
            self._end_text()
            item = {"pos": len(self.items), "kind": _MEDIA[tag], "text": None, "ref": given.get("src") or given.get("data"), "caption": given.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _BLOCK:
            self._end_text()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join(" ".join(self.caption).split()), None
            for item in self.figure or []:
                item["caption"] = caption or item["caption"]
        elif tag in _BLOCK:
            self._end_text()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def done(self) -> list[dict]:
        self.close()
        self._end_text()
        return self.items


def sequence(html: str | None) -> list[dict]:
    """Ordered items of one document; none for null or empty HTML."""
    parser = _Items()
    parser.feed(html or "")
    return parser.done()


def parse(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items): each row's interleaved sequence."""
    kind = pages.schema[key].dataType.simpleString()
    rows = lambda batches: ({"k": c["k"], "items": [sequence(h) for h in c["h"]]} for c in batches)
    source = pages.select(F.col(key).alias("k"), F.col(html).alias("h"))
    return map_arrow(source, ["k", "h"], f"k {kind}, items {ITEMS}", rows).withColumnRenamed("k", key)


def payload(text: Column) -> tuple[Column, Column]:
    """UTF-8 bytes of a text (null: empty) padded with 0 to a positive multiple of WIDTH, and their number before."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    return F.rpad(data, (F.greatest(F.lit(1), F.ceil(size / WIDTH)) * WIDTH).cast("int"), F.unhex(F.lit("00"))), size.cast("long")


def encode(data: Column) -> Column:
    """A payload as a PGM file."""
    header = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(data) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(header.cast("binary"), data)


def decode(media: bytes) -> bytes:
    head = _HEADER.match(media)
    width, height = int(head[1]), int(head[2])
    data = media[head.end() :]
    if width != WIDTH or len(data) != width * height:
        raise ValueError("a stored greymap's size does not agree with its header")
    return data


def features(store: DataFrame) -> DataFrame:
    """One row a digest: sizes, digests and a feature of the stored bytes, read back.

    feature: height, mean and deviation of the samples, and the share of each of eight value ranges.
    """
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for digest, media in zip(cols["digest"], cols["media"], strict=True):
                data = decode(media)
                x = np.frombuffer(data, np.uint8)
                count = np.bincount(x, minlength=256).astype(np.float64)
                mean = float(count @ np.arange(256)) / len(x)
                spread = max(0.0, float(count @ np.arange(256) ** 2) / len(x) - mean * mean) ** 0.5
                shares = ",".join(f"{v:.4f}" for v in count.reshape(8, 32).sum(1) / len(x))
                values = (digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), f"h={len(x) // WIDTH};mean={mean:.4f};sd={spread:.4f};hist={shares}")
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
            yield out

    return map_arrow(store, ["digest", "media"], schema, rows).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """(key, n_items, pos, kind, caption, ref and facts' columns) of every media reference; facts stay null where the store lacks it."""
    media = F.filter("items", lambda i: i["kind"] != "text")  # texts are left where they are
    refs = sequences.select(key, F.size("items").alias("n_items"), F.explode(media).alias("i"))
    refs = refs.select(key, "n_items", "i.pos", "i.kind", "i.caption", "i.ref", F.regexp_extract("i.ref", "^sha256:([0-9a-f]{64})$", 1).alias("digest"))
    return refs.join(facts, "digest", "left")


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def document_page(name: Column, text: Column, digest: Column, n_bytes: Column) -> Column:
    """HTML of a document: a heading, its text as paragraphs (one a line), its payload as a figure with a caption, and a closing line."""
    paragraphs = F.concat(F.lit("<p>"), F.replace(_escaped(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    size = n_bytes.cast("string")
    return F.concat(F.lit("<h1>document "), name, F.lit("</h1>"), paragraphs, F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>document '), name, F.lit(", "), size, F.lit(" bytes</figcaption></figure><p>end of document "), name, F.lit("</p>"))


def document_media(docs: DataFrame) -> DataFrame:
    """Store every text of docs as a medium, lay the document out as a page of text and that medium, parse the page and resolve its references.

    A null text counts as empty; a text of any length is one medium. Besides the medium's facts: pos, its place among the page's
    n_items items, and its caption.
    """
    data, size = payload(F.col("text"))
    rows = docs.select("doc_id", "text", data.alias("data"), size.alias("n_bytes"))
    store = materialize(rows.select(F.sha2("data", 256).alias("digest"), encode(F.col("data")).alias("media")), "media")
    facts = materialize(features(store), "features")  # a written table: AQE can split the join for a digest that many rows share
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without id"))
    pages = rows.select(F.struct("doc_id", "n_bytes").alias("page"), document_page(name, F.col("text"), F.sha2("data", 256), F.col("n_bytes")).alias("html"))
    found = resolve(parse(pages, "page"), "page", facts)
    return found.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")
