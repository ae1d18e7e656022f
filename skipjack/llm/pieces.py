"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The piece table is read from a model file by the sentencepiece library (only the table; segmentation is done here).
Where the file holds merge ranks instead of log probabilities (scores 0, -1, -2, ...), a piece of rank r gets the log
score -ln(r + 2) less the log of their sum (Zipf's law); the runs of markers, which have no rank, get the lowest score.
The best segmentation has the largest sum of log scores; ties go to the longer last piece. Characters without a piece
become their UTF-8 bytes' pieces, each at the lowest score less ten.

White space: one marker is put before the text and spaces become markers, nothing else is changed. A marker character
in the text itself is encoded by its bytes, so decoding gives back every text exactly.

Pieces hold markers only at their front, so the best segmentation of a text is that of its chunks (a run of
spaces and what follows up to the next space): distinct chunks are segmented together in NumPy, one trie step for all
of them at a time, and remembered up to a bound of characters. In a long chunk (text without spaces) the trie is walked from
all its places at once, and the best path is then found in one pass over the matches, so its cost grows with its length.

Defined cases: null and empty texts have no ids (null decodes to the empty text); repeated rows are encoded one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skipjack.llm.common import slices

MARKER = "▁"
#: Stands for a marker character of the text itself while it is segmented; UTF-8 texts cannot hold it.
OWN_MARKER = "\udfff"
CHUNK = re.compile(" +[^ ]*|[^ ]+")
#: Characters of the chunks a worker remembers, and code points of the chunks segmented at once.
REMEMBERED, AT_ONCE = 1_500_000, 400_000
#: A chunk this long is segmented alone; places of it whose matches are looked up at once.
LONG, PLACES = 256, 200_000


class DoubleArray:
    """Trie in two arrays: the child of state s by code c is base[s] + c if check of that place is s."""

    def __init__(self, keys: list[tuple[tuple[int, ...], int]]):
        """keys: (codes from 1 up, value from 0 up), distinct."""
        tree: dict = {}
        for codes, value in keys:
            node = tree
            for c in codes:
                node = node.setdefault(c, {})
            node[0] = value
        size = 1 << 16
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        free, top, queue = 1, 1, [(tree, 0)]
        for node, state in queue:
            self.value[state] = node.get(0, -1)
            codes = np.array(sorted(c for c in node if c), np.int64)
            if not len(codes):
                continue
            at, tries = max(1, free - int(codes[0])), 0
            while True:
                tries += 1
                if tries == 16:  # the crowded part is full: go behind all that is used
                    at = max(at, top)
                if at + int(codes[-1]) >= len(used):
                    grow = len(used)
                    used = np.concatenate((used, np.zeros(grow, bool)))
                    self.base = np.concatenate((self.base, np.zeros(grow, np.int32)))
                    self.check = np.concatenate((self.check, np.full(grow, -1, np.int32)))
                    self.value = np.concatenate((self.value, np.full(grow, -1, np.int32)))
                if not used[at + codes].any():
                    break
                at += 1
            self.base[state] = at
            used[at + codes] = True
            top = max(top, at + int(codes[-1]) + 1 - int(codes[0])) if len(codes) < 64 else top
            self.check[at + codes] = state
            while used[free]:
                free += 1
                if free >= len(used):
                    used = np.concatenate((used, np.zeros(len(used), bool)))
                    self.base = np.concatenate((self.base, np.zeros(len(self.base), np.int32)))
                    self.check = np.concatenate((self.check, np.full(len(self.check), -1, np.int32)))
                    self.value = np.concatenate((self.value, np.full(len(self.value), -1, np.int32)))
            queue += [(node[int(c)], at + int(c)) for c in codes]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none (code 0 has no child)."""
        to = np.minimum(self.base[state] + code, len(self.check) - 1)
        return np.where((code > 0) & (self.check[to] == state), to, -1)


class Pieces:
    """The piece table, its trie and the segmentation of chunks."""

    def __init__(self, table: list[tuple[str, float, str]]):
        """table: (piece, score, kind) in id order; kind is normal, byte or other."""
        self.table = table
        scores = np.array([s for _, s, _ in table])
        normal = np.array([k == "normal" and bool(p) for p, _, k in table])
        ranked = normal & (scores > -1e8)
        if ranked.any() and (scores[ranked] == np.round(scores[ranked])).all() and scores[ranked].min() < -100:
            z = np.log(2 - scores[ranked])
            scores = scores.copy()
            scores[ranked] = -z - np.log(np.exp(-z).sum())
            scores[normal & ~ranked] = scores[ranked].min()
        self.scores = scores
        letters = sorted({c for (p, _, _), n in zip(table, normal, strict=True) if n for c in p})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self.trie = DoubleArray([(tuple(self.codes(p).tolist()), i) for i, (p, _, _) in enumerate(table) if normal[i]])
        self.longest = max((len(p) for (p, _, _), n in zip(table, normal, strict=True) if n), default=1)
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(table):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
        self.fallback = (scores[normal].min() if normal.any() else 0.0) - 10
        if any(MARKER in p.lstrip(MARKER) for (p, _, _), n in zip(table, normal, strict=True) if n):
            raise ValueError("a piece holds a marker behind its front")
        self.decoded = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARKER, " ").encode() if k == "normal" else b"" for p, _, k in table]

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())])

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(len(points), np.int64)

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk (markers in place of spaces)."""
        out: list[np.ndarray] = [None] * len(chunks)  # type: ignore[list-item]
        sizes = np.array([len(c) for c in chunks])
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):  # chunks of like length together
            if sizes[order[at]] >= LONG:
                for k in order[at:].tolist():
                    out[k] = self._segment_long(chunks[k])
                break
            end, width = at, 0
            while end < len(order) and sizes[order[end]] < LONG and (end == at or (sizes[order[end]] * (end - at + 1) <= AT_ONCE and sizes[order[end]] <= 2 * sizes[order[at]] + 4)):
                width = sizes[order[end]]
                end += 1
            self._segment([chunks[k] for k in order[at:end]], int(width), order[at:end], out)
            at = end
        return out

    def _segment(self, chunks: list[str], width: int, numbers: np.ndarray, out: list) -> None:
        n = len(chunks)
        sizes = np.array([len(c) for c in chunks])
        grid = np.zeros((width + self.longest + 1, n), np.int64)
        inside = np.arange(width)[:, None] < sizes[None, :]
        flat = self.codes("".join(chunks))
        starts = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) - np.repeat(starts, sizes)
        cols = np.repeat(np.arange(n), sizes)
        grid[rows, cols] = flat
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        for i in range(width):
            live = np.flatnonzero(inside[i])
            # One character by its bytes; the number of bytes does not matter for which is best at equal text.
            byte = best[i, live] + self.fallback
            better = byte > best[i + 1, live]
            k = live[better]
            best[i + 1, k], back[i + 1, k], piece[i + 1, k] = byte[better], 1, -1
            state = np.zeros(len(live), np.int64)
            for j in range(1, self.longest + 1):
                state = self.trie.step(state, grid[i + j - 1, live])
                going = state >= 0
                if not going.any():
                    break
                live, state = live[going], state[going]
                value = self.trie.value[state]
                end = np.flatnonzero(value >= 0)
                if len(end):
                    k, v = live[end], value[end]
                    score = best[i, k] + self.scores[v]
                    better = score > best[i + j, k]
                    k = k[better]
                    best[i + j, k], back[i + j, k], piece[i + j, k] = score[better], j, v[better]
        # Walk back all chunks at once.
        place = sizes.copy()
        steps = []
        while (live := np.flatnonzero(place > 0)).size:
            p = piece[place[live], live]
            place[live] -= back[place[live], live]
            steps.append((live, p, place[live].copy()))
        found: list[list[int]] = [[] for _ in range(n)]
        owner = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
        ids = np.concatenate([s[1] for s in steps]) if steps else np.zeros(0, np.int32)
        where = np.concatenate([s[2] for s in steps]) if steps else np.zeros(0, np.int64)
        sort = np.lexsort((where, owner))
        owner, ids, where = owner[sort], ids[sort], where[sort]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        plain = np.ones(n, bool)
        plain[owner[ids < 0]] = False
        for k in range(n):
            a, b = bounds[k], bounds[k + 1]
            if plain[k]:
                out[numbers[k]] = ids[a:b]
                continue
            own: list[int] = found[k]
            for v, w in zip(ids[a:b].tolist(), where[a:b].tolist(), strict=True):
                if v >= 0:
                    own.append(v)
                else:
                    own += self._byte_ids(chunks[k][w])
            out[numbers[k]] = np.array(own, np.int32)

    def _segment_long(self, chunk: str) -> np.ndarray:
        """The same for one chunk: trie steps of many places together, then one pass over the matches."""
        n = len(chunk)
        codes = np.concatenate((self.codes(chunk), np.zeros(self.longest + 1, np.int64)))
        scores = self.scores.tolist()
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for low in range(0, n, PLACES):
            high = min(low + PLACES, n)
            live = np.arange(low, high)
            state, starts, ends, found = np.zeros(len(live), np.int64), [], [], []
            for j in range(self.longest):
                state = self.trie.step(state, codes[live + j])
                going = state >= 0
                if not going.any():
                    break
                live, state = live[going], state[going]
                value = self.trie.value[state]
                hit = value >= 0
                starts.append(live[hit])
                ends.append(live[hit] + j + 1)
                found.append(value[hit])
            start, end, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, found))
            order = np.lexsort((end, start))
            first = np.searchsorted(start[order], np.arange(low, high + 1)).tolist()
            end, value = end[order].tolist(), value[order].tolist()
            for i in range(low, high):
                here, k = best[i], i + 1
                # One character by its bytes.
                if here + self.fallback > best[k]:
                    best[k], back[k], piece[k] = here + self.fallback, 1, -1
                for m in range(first[i - low], first[i - low + 1]):
                    k, s = end[m], here + scores[value[m]]
                    if s > best[k]:
                        best[k], back[k], piece[k] = s, k - i, value[m]
        out, at = [], n
        while at:
            size = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += reversed(self._byte_ids(chunk[at - 1]))
            at -= size
        return np.array(out[::-1], np.int32)

    def _byte_ids(self, c: str) -> list[int]:
        raw = b" " if c == MARKER else (MARKER if c == OWN_MARKER else c).encode("utf-8", "surrogatepass")
        return self.byte_ids[list(raw)].tolist()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def decode_bytes(self, ids) -> bytes:
        whole = b"".join([self.decoded[i] for i in ids])
        return whole[1:]  # the marker before the text


class Encoder:
    """Encodes texts chunk by chunk; remembers chunks up to a bound of characters (beside those of the texts at hand)."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        self.pieces, self.remembered = pieces, remembered
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first: list[int] = []
        self.size: list[int] = []
        self.used = self.letters = 0
        self.spans: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        # One marker stands before the text.
        return (" " + text).split(" ")[1:] if "  " not in text and text[0] != " " and text[-1] != " " else [x[1:] for x in CHUNK.findall(" " + text)]

    def learn(self, new: list[str]) -> None:
        shown = [MARKER + (x.replace(MARKER, OWN_MARKER) if MARKER in x else x).replace(" ", MARKER) for x in new]
        spared = self.pieces.segment(shown)
        total = sum(map(len, spared))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.int32)))
        self.flat[self.used : self.used + total] = np.concatenate(spared) if spared else 0
        for x, ids in zip(new, spared, strict=True):
            self.number[x] = len(self.first)
            self.first.append(self.used)
            self.size.append(len(ids))
            self.used += len(ids)
            self.letters += len(x)
        self.spans = None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's)."""
        cut = [self.chunks(t) for t in texts]
        if self.letters > self.remembered:
            self.clear()
        new = set().union(*cut) - self.number.keys() if cut else set()
        if new:
            self.learn(sorted(new))
        if self.spans is None:
            self.spans = (np.array(self.first, np.int64), np.array(self.size, np.int64))
        first, size = self.spans
        number = self.number
        at = np.array([number[x] for c in cut for x in c], np.int64)
        sizes = size[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[at] - (ends - sizes), sizes) if len(at) else np.zeros(0, np.int64)
        per = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
        return self.flat[place], np.concatenate(([0], ends))[per]


_encoders: dict = {}


def encoder(model_file: str) -> Encoder:
    """Built once in each Python worker."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(Pieces.load(model_file))
    return _encoders[model_file]


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip (decoding gives the text), per row."""

    def run(batches):
        own = encoder(model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids, offsets = own.encode(texts)
                cuts = list(zip(offsets.tolist(), offsets.tolist()[1:], strict=False))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in cuts]
                back = [own.pieces.decode_bytes(ids[a:b].tolist()) == t.encode("utf-8", "surrogatepass") if verify else None for (a, b), t in zip(cuts, texts, strict=True)]
                arrays = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """The columns of encoded, with text decoded from the ids (null: empty)."""
    fields = [c for c in encoded.columns if c != "text"]
    own = encoded.select(*fields)

    def run(batches):
        pieces = encoder(model_file).pieces
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*fields, "text"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("text", T.StringType())]))
