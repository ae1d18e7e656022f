"""Token ids as Arrow stream files of fixed-size lists.

Documents are range-partitioned and sorted by id; each task tokenizes its range and writes one file. A file is an Arrow
stream whose batches hold two fixed-size lists per row: ``ids`` (length L, unsigned, 16-bit where the vocabulary allows
it, otherwise 32-bit) and ``mask`` (length L, bits: true for ids, false for the padding of the file's last row). Rows have equal size, so sequence k of a batch is a slice of a
buffer, read without copying. Beside it stands an index file (doc_id, offset in the file, number of ids).

Files are written under an attempt's own name and renamed when they are whole, so a lost or repeated task leaves no
part of a file. The folder must be one that all executors share.

A byte-level tokenizer's own rule cuts before every space that a non-space follows, so a text's ids are those of its
space-led words in a row. Words are cut and numbered by Arrow; each distinct word of a slice is cut into its
pre-tokens, and a pre-token goes to the library's model once and is remembered up to a bound. Texts with other spacing (or another
rule), and texts that hold a control string, go to the library whole. Whether a control string inside a text becomes its own id, as
in the library's plain call, or is ordinary text, is the caller's choice (``control_ids``).

Rows are ranged by id, a hash of the text and their place in the source, so an id that many rows share (or rows
without one) spreads over the files as well.

Defined cases: null texts are empty; an empty text has the end id alone; repeated rows are documents of their own (ties in id by
the text's hash); null ids come first; an empty table, and a partition without rows, gives no files; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import scratch, slices, stored

LENGTH, END_ID, BATCH = 1024, 0, 512
#: Pre-tokens remembered, and the longest one that is; bytes of text whose words are numbered together.
REMEMBERED, LONGEST, SLICE = 250_000, 64, 16_000_000
#: A space that another space (of any kind) or the end follows: RE2 text.
LOOSE = r" ([\x09-\x0D\x1C-\x20\x{85}\p{Z}]|\z)"


#: Fixed by the tokenizer: its rule for pre-tokens (here for ASCII and Latin letters; texts with anything else go to the
#: library whole) and the letters that stand for bytes.
OTHER = r"[^\x{00}-\x{1B}\x{20}-\x{7F}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]"
LETTER = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-ſ"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = byte_letters()


class Tokens:
    """Encodes texts with one tokenizer; each distinct word of a call once."""

    def __init__(self, path: str, control_ids: bool = True):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = not control_ids
        added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.control = "|".join(f"\\Q{t}\\E" for t in added) if control_ids else ""
        state = self.own.pre_tokenizer.__getstate__() if self.own.pre_tokenizer else b""
        special = all(t.special for t in self.own.get_added_tokens_decoder().values())
        self.cuts = special and self.own.normalizer is None and b'"ByteLevel"' in state and b'"add_prefix_space":false' in state and b'"use_regex":true' in state
        self.kind = np.dtype("<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.met, self.older = self.own.model, {}, {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        offsets = np.append(0, ends * ids.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _each(self, words: pa.Array) -> pa.Array:
        own = self._whole(words.to_pylist())
        return self._binary(np.concatenate([np.zeros(0, self.kind), *own]), np.cumsum([len(x) for x in own], dtype=np.int64))

    def _spaced(self, words: pa.Array) -> pa.Array:
        """Ids of each word (not empty) with a space before it."""
        joined = " ".join(["", *words.to_pylist()])
        # A space is in no word, so each pre-token that begins with one begins a word.
        cut = SPLIT.findall(joined) if joined else []
        found, met, older = dict.fromkeys(cut), self.met, self.older
        tokenize, code, pack = self.model.tokenize, self.kind.char, struct.pack
        for x in found:
            ids = met.get(x)
            if ids is None:
                ids = older.get(x)
                if ids is None:
                    own = [t.id for t in tokenize(x.encode().decode("latin-1").translate(LETTERS))]
                    ids = pack(f"<{len(own)}{code}", *own)
                if len(x) <= LONGEST:
                    met[x] = ids
            found[x] = ids
        if len(self.met) > REMEMBERED:  # frequent ones come back from the older half
            self.older, self.met = self.met, {}
        parts = [found[x] for x in cut]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // self.kind.itemsize
        begins = np.fromiter((x[0] == " " for x in cut), bool, len(cut))
        last = np.append(np.flatnonzero(begins)[1:], len(cut)) - 1 if len(cut) else np.zeros(0, np.int64)
        return self._binary(np.frombuffer(b"".join(parts), self.kind), ends[last])

    def encode(self, texts) -> list[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        loose = pc.match_substring_regex(texts, f"{LOOSE}|{OTHER}" + (f"|{self.control}" if self.control else "")).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for k, ids in zip(np.flatnonzero(loose).tolist(), self._whole(texts.filter(pa.array(loose)).to_pylist()), strict=True):
            out[k] = ids
        if loose.all():
            return out
        words = pc.split_pattern(texts.filter(pa.array(~loose)), " ")
        starts = words.offsets.to_numpy()
        # A text's first word has no space before it: such words are numbered behind the others.
        first, rest = np.zeros(len(words.values), bool), words.values.dictionary_encode()
        first[starts[:-1]] = True
        heads = words.values.take(pa.array(starts[:-1])).dictionary_encode()
        place, used = rest.indices.to_numpy(), np.zeros(len(rest.dictionary), bool)
        used[place[~first]] = True
        place = (np.cumsum(used, dtype=np.int32) - 1)[place]
        place[first] = used.sum() + heads.indices.to_numpy()
        flat = pa.concat_arrays([self._spaced(rest.dictionary.filter(pa.array(used))), self._each(heads.dictionary)]).take(pa.array(place))
        ends = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4)[starts].tolist()
        raw = memoryview(flat.buffers()[2] or b"")
        for k, a, b in zip(np.flatnonzero(~loose).tolist(), ends, ends[1:], strict=False):
            out[k] = np.frombuffer(raw[a:b], self.kind)
        return out


_tokens: dict = {}


def tokens(path: str, control_ids: bool = True) -> Tokens:
    if (path, control_ids) not in _tokens:
        _tokens[path, control_ids] = Tokens(path, control_ids)
    return _tokens[path, control_ids]


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = uri if uri.startswith("file:") else f"file://{uri}"
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Fills rows of `length` ids and writes them batch by batch."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.length * BATCH:
            self._flush(self.size // self.length * self.length)

    def _flush(self, count: int) -> None:
        whole = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        now, rest = whole[:count], whole[count:]
        self.held, self.size = [rest], len(rest)
        if len(now):
            self._write(now, np.ones(len(now), bool))

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids.astype(self.kind), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        self._flush(self.size // self.length * self.length)
        if self.size:
            last = np.concatenate(self.held)
            pad = self.length - len(last)
            self._write(np.concatenate((last, np.zeros(pad, self.kind))), np.arange(self.length) < len(last))
        self.writer.close()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", control_ids: bool = True) -> tuple[str, DataFrame]:
    """Write the files; return (folder, one row per file: part, file, index, n_docs, n_ids), parts in order of id.

    Without a folder the files are scratch, which goes when the driver ends.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "hash", "place"]
    ranged = own.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        collecting = gc.isenabled()
        gc.disable()  # no cycles arise here, and the library's many small results would be traversed again and again
        try:
            yield from written(batches)
        finally:
            if collecting:
                gc.enable()

    def written(batches):
        store, root = _store(folder)
        coder, part, tag = tokens(tokenizer, control_ids), TaskContext.get().partitionId(), uuid.uuid4().hex
        ids, offsets, sizes, total = [], [], [], 0
        names = [f"{root}/part-{part:06d}.arrows", f"{root}/part-{part:06d}.index"]
        sink = writer = None
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{names[0]}.{tag}")
                    writer = FileWriter(sink, length, coder.kind)
                for found in coder.encode(piece.column("text")):
                    row = np.append(found, coder.kind.type(end_id))
                    writer.add(row)
                    offsets.append(total)
                    sizes.append(len(row))
                    total += len(row)
                ids += piece.column("doc_id").to_pylist()
        if writer is None:
            return
        writer.close()
        sink.close()
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with store.open_output_stream(f"{names[1]}.{tag}") as sink, pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        for n in names:
            store.move(f"{n}.{tag}", n)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [names[0]], "index": [names[1]], "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return folder, stored(ranged.mapInArrow(run, "part int, file string, index string, n_docs long, n_ids long"), "token-files-list")


class FileReader:
    """Random access to one file: local files are mapped, and a sequence is a view of the mapped buffer."""

    def __init__(self, folder: str, path: str):
        store, _ = _store(folder)
        from pyarrow import fs

        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = np.concatenate(([0], np.cumsum([b.num_rows for b in self.batches])))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1

    def sequence(self, k: int, column: str = "ids") -> np.ndarray:
        b = int(np.searchsorted(self.rows, k, side="right")) - 1
        own = self.batches[b].column(column).values.slice((k - self.rows[b]) * self.length, self.length)
        return own.to_numpy(zero_copy_only=column == "ids")  # a mask is unpacked from its bits

    def span(self, start: int, count: int) -> np.ndarray:
        """`count` ids from place `start` on; no copy if they lie in one batch."""
        out, cells = [], self.rows * self.length
        while count > 0:
            b = int(np.searchsorted(cells, start, side="right")) - 1
            n = min(count, int(cells[b + 1]) - start)
            out.append(self.batches[b].column("ids").values.to_numpy(zero_copy_only=True)[start - cells[b] : start - cells[b] + n])
            start, count = start + n, count - n
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_tokens(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    from pyspark.sql import Window

    # One row per file is ranked; its size follows the number of partitions.
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spread = based.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")

    def run(batches):
        for batch in batches:
            for file, index, base in zip(batch.column("file").to_pylist(), batch.column("index").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, _ = _store(folder)
                reader = FileReader(folder, file)
                with store.open_input_file(index) as source:
                    table = pa.ipc.open_stream(source).read_all()
                offset, size = table.column("offset").to_numpy(), table.column("n_tokens").to_numpy()
                crc = [zlib.crc32(reader.span(a, n).astype("<u4").tobytes()) for a, n in zip(offset.tolist(), size.tolist(), strict=True)]
                out = pa.table({"doc_id": table.column("doc_id"), "start": pa.array(offset + base), "n_tokens": pa.array(size), "ids_crc32": pa.array(crc, pa.int64())})
                yield from out.to_batches(max_chunksize=10_000)

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
