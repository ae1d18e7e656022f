"""Benchmark decontamination with an Aho-Corasick automaton.

Benchmark texts are lower-cased (A-Z) and cut into words; every run of eight words of an item (a shorter item: all its
words) is one pattern. The automaton over all patterns reads each normalised document once; a hit's end is mapped to
word numbers, and word numbers to character offsets of the original text.

The automaton is the only thing sent to the executors. Its size is checked: items stream to the driver, and whenever
their patterns reach ``max_patterns`` or ``max_bytes`` an automaton is full. A benchmark of several automata is read in as many passes over the
documents, one after the other, each of which stores its hits before the next automaton is built; so what the driver and a task
hold is bounded and no pattern is left out.

Defined cases: null and wordless texts have no words and no hits; wordless items have no pattern; an item_id met twice
counts once; items without an id are patterns too and count together as one item, null, last in `items`; equal windows of several items count for each; repeated document rows are judged one by one; an empty
benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import as_bytes, forget, slices, stored

WINDOW = 8
#: Patterns of one automaton, and bytes of their texts.
MAX_PATTERNS, MAX_BYTES = 1_000_000, 100_000_000
#: Byte map: A-Z to a-z, other ASCII but 0-9 and a-z to a space; bytes from 0x80 up belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def in_order(items: set[str | None]) -> list[str | None]:
    """Sorted item ids, null last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def patterns(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[bytes, list[str | None]]:
    """Pattern (with a space at either end) -> sorted item ids."""
    found: dict[bytes, set[str | None]] = {}
    for item, text in items:
        words = normal_words(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[at : at + window]) + b" ", set()).add(item)
    return {k: in_order(v) for k, v in found.items()}


_built: dict = {}


def automaton(key: str, table: list[tuple[bytes, list[str]]]):
    """Built once in each Python worker."""
    if key not in _built:
        import ahocorasick

        _built.clear()
        found = ahocorasick.Automaton()
        for pattern, ids in table:
            found.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, ids))
        if table:
            found.make_automaton()
        _built[key] = found
    return _built[key]


def hits(machine, text: bytes) -> tuple[int, np.ndarray, set[str]]:
    """(number of words, numbers of the hit words, items) of one text."""
    words = normal_words(text)
    items: set[str | None] = set()
    if not words or not len(machine):
        return len(words), np.zeros(0, np.int64), items
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = list(machine.iter(line))
    if not found:
        return len(words), np.zeros(0, np.int64), items
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32).tolist()
    change = np.zeros(len(words) + 1, np.int64)
    for end, (count, ids) in found:
        last = bisect.bisect_left(gaps, end)  # the gap after word number last - 1
        change[last - count] += 1
        change[last] -= 1
        items.update(ids)
    return len(words), np.flatnonzero(np.cumsum(change[:-1]) > 0), items


def original_spans(text: str, numbers: np.ndarray) -> list[dict]:
    """Character spans of runs of hit words in the original text."""
    places = [m.span() for m in WORD.finditer(text)]
    runs = np.split(numbers, np.flatnonzero(np.diff(numbers) > 1) + 1)
    return [{"start": places[r[0]][0], "end": places[r[-1]][1]} for r in runs if len(r)]


def chunks(items: DataFrame, max_patterns: int, max_bytes: int) -> Iterator[tuple[list[tuple[bytes, list[str | None]]], bool]]:
    """(sorted patterns of one automaton, whether it is the last); whole items stay together, so no window is cut."""
    held: list[tuple[str | None, bytes]] = []
    count = size = 0
    for row in items.toLocalIterator(prefetchPartitions=True):
        text = row["t"].encode("utf-8", "surrogatepass")
        own = patterns([(row["i"], text)])
        more = sum(map(len, own))
        if held and (count + len(own) > max_patterns or size + more > max_bytes):
            yield sorted(patterns(held).items()), False
            held, count, size = [], 0, 0
        held.append((row["i"], text))
        count, size = count + len(own), size + more
    yield sorted(patterns(held).items()), True


def _scan(docs: DataFrame, table: list[tuple[bytes, list[str | None]]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(table)
    key = uuid.uuid4().hex

    def run(batches):
        machine = automaton(key, sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    n, numbers, items = hits(machine, text)
                    out.append((doc, n, len(numbers), in_order(items), original_spans(text.decode("utf-8", "surrogatepass"), numbers) if len(numbers) else []))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(run, SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_patterns: int = MAX_PATTERNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and spans (original character offsets of hit words), one row per input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    numbered, parts = None, []
    for table, last in chunks(items, max_patterns, max_bytes):
        if last and not parts:
            return _scan(docs, table)
        # Several automata: a pass each, then the hits of a row are united by its place in the stored input.
        if numbered is None:
            numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        parts.append(stored(_scan(numbered.select(F.col("row").alias("doc_id"), "text"), table), "hits"))
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    united = stored(both.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("all")), "hits")
    forget(*parts)
    # Spans of different passes may overlap or touch: count the words they cover on the text itself.
    joined = numbered.join(united, "row")

    def settle(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hit, spans = [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("all").to_pylist(), strict=True):
                    places = [m.span() for m in WORD.finditer(text or "")] if own else []
                    starts = [p[0] for p in places]
                    change = np.zeros(len(places) + 1, np.int64)
                    for s in own:
                        change[bisect.bisect_left(starts, s["start"])] += 1
                        change[bisect.bisect_left(starts, s["end"])] -= 1
                    numbers = np.flatnonzero(np.cumsum(change[:-1]) > 0) if places else np.zeros(0, np.int64)
                    hit.append(len(numbers))
                    spans.append(original_spans(text, numbers) if len(numbers) else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(hit, pa.int64()), part.column("items"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return joined.select("doc_id", "text", "n_words", "items", "all").mapInArrow(settle, SCHEMA)
