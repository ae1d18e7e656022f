"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: start mark, role, header mark, text, end mark for each turn. The marks are special
tokens, so no token lies across a mark. Inside roles and texts every ``<|`` (also with backslashes between) gets one
backslash more, which reading takes off again, so no text can forge a mark. The rendering is encoded once with
character offsets; the tokens of each turn's text are found by binary search of the sorted turn spans in the token
starts and ends, and those of assistant turns form the loss mask.

Defined cases: null texts and roles are empty; turns are ordered by number, ties by role and text, null numbers first;
repeated rows are turns of their own; rows without a conv_id form one conversation (null); an empty table gives an
empty result; other columns are ignored. A conversation is one row of the result, so it is held by one task.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, HEADER, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """(formatted text, spans of the turns' texts with whether they are the assistant's)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{HEADER}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body), role == "assistant"))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition(HEADER)
        out.append((unescape(role), unescape(rest[: rest.rindex(END)])))
    return out


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int, bool]]) -> tuple[list[int], list[tuple[int, int]]]:
    """(mask per token, character spans under it)."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, covered = [0] * len(offsets), []
    for a, b, assistant in spans:
        if not assistant or a == b:
            continue
        first, last = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        mask[first:last] = [1] * (last - first)
        if last > first:
            covered.append((max(a, starts[first]), min(b, ends[last - 1])))
    return mask, covered


def tokenizer_with_marks(path: str):
    from tokenizers import AddedToken, Tokenizer

    own = Tokenizer.from_file(path)
    own.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, HEADER, END)])
    return own


_loaded: dict = {}
OUT = "conv_id long, formatted string, ids array<int>, loss_mask array<byte>, loss_spans array<struct<start:int,end:int>>"


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, formatted, ids, loss_mask (0 or 1 per id), loss_spans (characters of `formatted` under the mask)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        if tokenizer not in _loaded:
            _loaded[tokenizer] = tokenizer_with_marks(tokenizer)
        own = _loaded[tokenizer]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shown = [render([(t["role"], t["text"]) for t in x]) for x in part.column("turns").to_pylist()]
                cols: list[list] = [[], [], []]
                for (_, spans), e in zip(shown, own.encode_batch([s for s, _ in shown], add_special_tokens=False), strict=True):
                    mask, covered = loss_mask(e.offsets, spans)
                    for c, v in zip(cols, (e.ids, mask, [{"start": a, "end": b} for a, b in covered]), strict=True):
                        c.append(v)
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([s for s, _ in shown], pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "formatted", "ids", "loss_mask", "loss_spans"])

    return whole.mapInArrow(run, OUT)


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
