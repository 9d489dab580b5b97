"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens it into one string with ordered
placeholders and a list of attachments, each with its reference and the tokens it expands to. The template marks turns;
control strings inside texts are escaped reversibly, so that a text can't open or close a turn.
Assistant texts are under the loss mask.

Formatting is by turn (map only). A conversation's digests need its turns in order: rows are
partitioned by conversation, sorted, and folded as a stream, so one conversation of any length holds
no more than a turn and its hash state in memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import map_arrow, materialize

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Side of the square patches an image is cut into, seconds of audio and characters of a document that make one token.
PATCH, AUDIO_SECONDS, DOCUMENT_CHARS = 14, 0.04, 4
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No "<|" is left; unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class Flattener:
    """Visits parts in order; `text` is the flattened content, `attachments` what its placeholders stand for."""

    def __init__(self):
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type', 'text')}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-int(part.get(k) or PATCH) // PATCH) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0) / AUDIO_SECONDS)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, -(-int(part.get("n_chars") or 0) // DOCUMENT_CHARS)))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}_{len(self.attachments)}|>")
        self.attachments.append({"n": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens

    @property
    def text(self) -> str:
        return "".join(self.out)


def parts_of(content: str | None, typed: bool) -> list[dict]:
    """Content as parts: a JSON list of them where `typed`, else one text."""
    if typed and content and content.lstrip().startswith("["):
        try:
            found = json.loads(content)
        except ValueError:
            found = None
        if isinstance(found, list) and all(isinstance(p, dict) for p in found):
            return found
    return [{"type": "text", "text": content or ""}]


SEGMENT = "conv_id long, turn long, role string, raw string, segment string, loss_from int, loss_to int, attachments array<struct<n:int,kind:string,ref:string,tokens:int>>, expanded_tokens long"


def format_turns(turns: DataFrame, typed: bool = False) -> DataFrame:
    """One row a turn with its segment of the output, the loss mask in it (code points, end exclusive) and its attachments.

    A null role or text counts as empty. role and raw stay for the order of rows that share conv_id and turn.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            out: dict[str, list] = {f.split(" ")[0]: [] for f in SEGMENT.split(", ")}
            for conv, turn, role, text in zip(cols["conv_id"], cols["turn"], cols["role"], cols["text"], strict=True):
                content = Flattener()
                for part in parts_of(text, typed):
                    content.visit(part)
                head = f"{START}{escape_role(role or '')}\n"
                body = content.text
                learn = role == "assistant"
                values = (conv, turn, role, None, f"{head}{body}{END}\n", len(head) if learn else None, len(head) + len(body) if learn else None, content.attachments, content.tokens)
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
            yield out

    return map_arrow(turns, ["conv_id", "turn", "role", "text"], SEGMENT, rows).drop("raw")


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, parsed from its formatted segments in order."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "segment"]
    ordered = segments.select(*keys, "loss_from", "loss_to", F.size("attachments").alias("attached"), "expanded_tokens").repartition(n, "conv_id").sortWithinPartitions(*keys)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        now, state = None, None

        def result() -> list:
            conv, count, all_text, loss_chars, loss, chars, attached, tokens = state
            return [conv, count, all_text.hexdigest(), loss_chars, loss.hexdigest(), chars, attached, tokens]

        for cols in batches:
            done: list[list] = []
            for conv, segment, low, high, attached, tokens in zip(*(cols[c] for c in ("conv_id", "segment", "loss_from", "loss_to", "attached", "expanded_tokens")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(result())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                turn = _TURN.fullmatch(segment)
                state[1] += 1
                state[2].update(f"{unescape_role(turn[1])}\n{unescape(turn[2])}\n".encode())
                if low is not None:
                    learned = unescape(segment[low:high])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
                state[6] += attached
                state[7] += tokens
            if done:
                yield {n: list(v) for n, v in zip(names, zip(*done, strict=True), strict=True)}
        if state is not None:
            yield {n: [v] for n, v in zip(names, result(), strict=True)}

    return map_arrow(ordered, ordered.columns, schema, rows)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format all turns, write the output, read it back; a row a conversation."""
    return read_back(materialize(format_turns(turns), "chat"))
