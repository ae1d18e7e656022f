"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first five bytes of longer words, so inflected forms of a stem meet. Fit, on a bounded sample
of labelled rows (``examples`` per label, least hashes of the ids, ``example_bytes`` of text in all): every term of
every example is in the index. A term weighs (1 + ln tf) * idf * sqrt(chi), with the document frequency over the whole table
and chi the chi-square of its presence against the labels of the examples; the factor lets terms that tell the labels apart rule the
angle without leaving any other out. Vectors have length one. Score: a text's ``neighbours`` nearest examples vote with their
cosine, for or against; the mean vote is calibrated by a logistic curve fitted on leave-one-out votes
of the examples, weighted to the labels' true shares. The neighbours are returned as evidence.

Index: examples are ordered by their most widespread term (so those of one language lie together) and label, and cut in
blocks of 64. Terms of many examples (``dense``) hold, per block, the weights of its 64 examples and their maximum; rarer
terms have a posting list of examples. Texts are searched together: rare terms add up exactly, the block maxima bound what
the frequent ones can add to a block, and blocks are scored in falling order of bound until no bound reaches the k-th
best cosine so far, so the result is exact.

Only rows whose crc32(doc_id) mod 5 is not 0 are learnt from; no column but the text enters a score.

Defined cases: null, blank and unknown-word texts have no neighbours and get the calibrated score of a zero vote; ties in cosine go to
the lower example number (examples are numbered by doc_id within the order above); repeated rows are scored one by one; with no examples of one
label every score is the learnt share of label 1 (0 without labels); labelled texts that no longer fit in ``example_bytes`` are
not learnt from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import as_bytes, forget, slices, stored
from skipjack.llm.windows import Words

#: Bounds of the fit: examples of each label, bytes of their texts together.
EXAMPLES, EXAMPLE_BYTES = 2000, 200_000_000
#: Share of the examples from which a term is frequent.
NEIGHBOURS, BLOCK, DENSE = 15, 64, 0.025
#: Texts searched together; blocks that give the first k cosines.
TOGETHER, FIRST = 64, 3
#: Bytes of text whose words are numbered together.
PART_BYTES = 2_000_000
#: Bytes of the word beginnings that are terms beside the whole words.
BEGINNING = 5
FOLDS, HELD_OUT = 5, 0
#: ASCII but letters and digits separates words; A-Z is lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Cosines closer than this are not told apart by the bounds.
SLACK = 1e-5


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, number of each word, the distinct words)."""
    words = Words([t.translate(FOLD) for t in texts])
    letters = words.data[words.data != 32]
    ends = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    kind, width = (pa.binary(), np.int32) if len(letters) < 1 << 31 else (pa.large_binary(), np.int64)
    known = pa.Array.from_buffers(kind, len(words.starts), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(letters)]).dictionary_encode()
    return words.text_of, known.indices.to_numpy(), known.dictionary.cast(pa.binary())


def _counted(owner: np.ndarray, item: np.ndarray, items: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, item, sum of times), one row per pair, by owner and item."""
    key = owner.astype(np.int64) * items + item
    order = None if times is None else np.argsort(key, kind="stable")
    key = np.sort(key) if order is None else key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    n = np.diff(np.append(first, len(key))) if order is None else np.add.reduceat(times[order], first) if len(first) else first
    return key[first] // max(items, 1), key[first] % max(items, 1), n


@dataclass
class Vocabulary:
    """Terms: the words, then the beginnings."""

    words: pa.Array
    beginnings: pa.Array

    def __len__(self) -> int:
        return len(self.words) + len(self.beginnings)

    @classmethod
    def of(cls, texts: list[bytes]) -> Vocabulary:
        words: set[bytes] = set()
        for at in range(0, len(texts), 500):
            words.update(_words(texts[at : at + 500])[2].to_pylist())
        starts = {w[:BEGINNING] for w in words if len(w) > BEGINNING}
        return cls(pa.array(sorted(words), pa.binary()), pa.array(sorted(starts), pa.binary()))

    def bags(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of every known term of every text, by text."""
        owner, number, distinct = _words(texts)
        owner, number, n = _counted(owner, number, len(distinct))
        there = lambda a: a.fill_null(-1).to_numpy(zero_copy_only=False)
        word = there(pc.index_in(distinct, value_set=self.words))
        start = there(pc.index_in(pc.binary_slice(distinct, 0, BEGINNING), value_set=self.beginnings))
        start = np.where(pc.binary_length(distinct).to_numpy(zero_copy_only=False) > BEGINNING, start, -1)
        mine, own = word[number] >= 0, start[number]
        begun = _counted(owner[own >= 0], own[own >= 0], max(len(self.beginnings), 1), n[own >= 0])
        owner, term, n = (np.concatenate(x) for x in ((owner[mine], begun[0]), (word[number][mine], begun[1] + len(self.words)), (n[mine], begun[2])))
        order = np.argsort(owner, kind="stable")
        return owner[order], term[order].astype(np.int64), n[order]


@dataclass
class BlockMaxIndex:
    """Weights by term: posting lists (term after term, examples rising) and, for frequent terms, matrices per block."""

    begin: np.ndarray  # terms + 1: a term's postings
    example: np.ndarray
    weight: np.ndarray
    term_weight: np.ndarray  # idf times the label factor
    label: np.ndarray
    ids: np.ndarray
    terms: Vocabulary
    block: int = BLOCK
    dense: float = DENSE
    curve: tuple[float, float] = (0.0, 0.0)
    prior: float = 0.0
    made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "made": {}}

    def _matrices(self):
        """(column of each frequent term or -1, blocks x columns x 64 weights, columns x blocks maxima); built once in each process."""
        if "matrices" not in self.made:
            size = np.diff(self.begin)
            frequent = np.flatnonzero(size >= max(1.0, self.dense * len(self.label)))
            column = np.full(len(size), -1, np.int32)
            column[frequent] = np.arange(len(frequent))
            blocks = max(1, -(-len(self.label) // self.block))
            whole = np.zeros((blocks, len(frequent), self.block), np.float32)
            owner = np.repeat(column, size)
            there = owner >= 0
            example = self.example[there].astype(np.int64)
            whole[example // self.block, owner[there], example % self.block] = self.weight[there]
            self.made["matrices"] = column, whole, np.ascontiguousarray(whole.max(axis=2, initial=0).T)
        return self.made["matrices"]

    def weights(self, owner: np.ndarray, term: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        """Of each (text, term): its part of the text's vector of length one."""
        w = (1 + np.log(n)) * self.term_weight[term]
        return (w / np.sqrt(np.maximum(np.bincount(owner, weights=w * w, minlength=texts), 1e-30))[owner]).astype(np.float32)

    def nearest(self, texts: list[bytes], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text (example numbers, cosines) of the k best above zero."""
        owner, term, n = self.terms.bags(texts)
        return self.search(owner, term, self.weights(owner, term, n, len(texts)), len(texts), k)

    def search(self, owner: np.ndarray, term: np.ndarray, w: np.ndarray, texts: int, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best per text, given the weights by text; skip: an example to leave out per text."""
        out = []
        for at in range(0, texts, TOGETHER):
            n = min(TOGETHER, texts - at)
            a, z = np.searchsorted(owner, (at, at + n))
            out += self._search(owner[a:z] - at, term[a:z], w[a:z], n, k, None if skip is None else skip[at : at + n])
        return out

    def _search(self, owner, term, w, n, k, skip):
        if not len(self.label):
            return [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * n
        column, whole, top = self._matrices()
        blocks = len(whole)
        cells = blocks * self.block
        own = column[term]
        often = own >= 0
        frequent = np.zeros((n, whole.shape[1]), np.float32)
        frequent[owner[often], own[often]] = w[often]
        # Rare terms: their posting lists, added up.
        owner, term, w = owner[~often], term[~often], w[~often]
        size = self.begin[term + 1] - self.begin[term]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[term] - (ends - size), size)
        flat = np.repeat(owner * cells, size)
        flat += self.example[place]
        scores = np.bincount(flat, weights=np.repeat(w, size) * self.weight[place], minlength=n * cells).astype(np.float32).reshape(n, blocks, self.block)
        bound = frequent @ top + scores.max(axis=2)
        order = np.argsort(-bound, axis=1, kind="stable")
        done = np.zeros((n, blocks), bool)
        least = np.zeros(n, np.float32)
        for rank in (order[:, :FIRST], order[:, FIRST:]):
            # The blocks that may still hold one of a text's k best; the same block of several texts together.
            bounds = np.take_along_axis(bound, rank, 1)
            who, which = np.nonzero((bounds + SLACK >= least[:, None]) & (bounds > 0))
            which = rank[who, which]
            sort = np.argsort(which, kind="stable")
            edges = np.searchsorted(which[sort], np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                rows = who[sort[edges[b] : edges[b + 1]]]
                scores[rows, b] += frequent[rows] @ whole[b]
            done[who, which] = True
            if k <= rank.shape[1] * self.block:
                seen = np.where(done[np.arange(n)[:, None], rank][:, :, None], scores[np.arange(n)[:, None], rank], 0)
                if skip is not None:
                    seen[rank[:, :, None] * self.block + np.arange(self.block) == skip[:, None, None]] = 0
                seen = seen.reshape(n, -1)
                least = np.maximum(least, np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k])
        # Blocks that were not scored hold a part of their cosines: they do not count.
        scores[~done] = 0
        scores = scores.reshape(n, cells)
        if skip is not None:
            scores[np.arange(n), skip] = 0
        low = np.partition(scores, cells - k, axis=1)[:, cells - k] if k <= cells else np.zeros(n, np.float32)
        row, ids = np.nonzero((scores >= low[:, None]) & (scores > 0))
        got = scores[row, ids]
        sort = np.lexsort((ids, -got, row))
        row, ids, got = row[sort], ids[sort], got[sort]
        edges = np.searchsorted(row, np.arange(n + 1))
        return [(ids[a : min(z, a + k)], got[a : min(z, a + k)]) for a, z in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def vote(self, ids: np.ndarray, cosine: np.ndarray, neighbours: int = NEIGHBOURS) -> float:
        """Mean signed cosine, -1 to 1: far neighbours count little, missing ones nothing."""
        return float((cosine * (2 * self.label[ids] - 1)).sum() / neighbours)

    def score(self, vote: float) -> float:
        if not (self.label == 1).any() or not (self.label == 0).any():
            return self.prior
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * vote + b))))


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Weighted logistic regression on one input by damped Newton steps."""
    design = np.stack((x, np.ones_like(x)), axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta += np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(beta[0]), float(beta[1])


def label_factor(seen: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Root of each term's chi-square; seen: 2 x terms, examples of each label that hold the term."""
    n0, n1 = int((label == 0).sum()), int((label == 1).sum())
    if not n0 or not n1:
        return np.ones(seen.shape[1])
    b, a = seen.astype(float)
    cross = a * (n0 - b) - b * (n1 - a)
    return np.sqrt((n0 + n1) * cross * cross / np.maximum((a + b) * (n0 + n1 - a - b) * n1 * n0, 1e-9)) + 1e-3


def build_index(owner: np.ndarray, term: np.ndarray, n: np.ndarray, label: np.ndarray, ids: np.ndarray, terms: Vocabulary, df: np.ndarray, total: int, block: int = BLOCK, dense: float = DENSE) -> BlockMaxIndex:
    """(owner, term, n): terms of the examples, by example; df: documents with each term, of `total`."""
    seen = np.stack([np.bincount(term[label[owner] == y], minlength=len(terms)) for y in (0, 1)])
    weight = (np.log((1 + total) / (1 + df)) + 1) * label_factor(seen, label)
    # The most widespread term of each example.
    spread = seen.sum(axis=0)
    sort = np.lexsort((term, -spread[term], owner))
    first = np.concatenate(([True], owner[sort][1:] != owner[sort][:-1]))[: len(sort)]
    main = np.full(len(label), -1, np.int64)
    main[owner[sort][first]] = term[sort][first]
    order = np.lexsort((ids, label, main))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    index = BlockMaxIndex(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), weight, label[order], ids[order], terms, block, dense)
    w, example = index.weights(owner, term, n, len(label)), place[owner].astype(np.int32)
    sort = np.lexsort((example, term))
    index.begin, index.example, index.weight = np.searchsorted(term[sort], np.arange(len(terms) + 1)), example[sort], w[sort]
    return index


def document_frequencies(docs: DataFrame, terms: Vocabulary) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over the whole table; each task sends one row per term at most."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        own = known.value
        count, total = np.zeros(len(own), np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for part in slices(batch, "text", PART_BYTES):
                count += np.bincount(own.bags(as_bytes(part.column("text")))[1], minlength=len(own))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(count[at], total))], names=["word", "n"])

    out, total = np.zeros(len(terms), np.int64), 0
    # At most one row per term of the examples.
    found = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    known.destroy()
    at, n = found.column("word").to_numpy(), found.column("n").to_numpy()
    if len(at):
        out[at[at >= 0]] = n[at >= 0]
        total = int(n[at < 0].sum())
    return out, total


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, per_label: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = EXAMPLE_BYTES) -> tuple[list[tuple[int, bytes, int]], float]:
    """((doc_id, text, label) of at most per_label rows of each label, share of label 1 among all rows of the learning folds).

    Whole texts, at most most_bytes in all: the labels take turns in order of the ids' hashes, and a text that no
    longer fits is left out.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(fold != held_out)
    totals = own.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    chosen = None
    for y in (0, 1):
        # The top-k is kept per task before it is gathered; the bound is per_label rows.
        part = own.where(F.col("label") == y).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    # Repeated doc_ids: one text each, the least, so the sample keeps its bound.
    held = stored(picked.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "examples")
    sizes = sorted(held.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", F.octet_length("text").alias("size")).collect())
    turn, fits, room = Counter(), [], most_bytes
    for r in sorted(sizes, key=lambda r: (turn.update([r["label"]]) or turn[r["label"]], r["label"])):
        if r["size"] <= room:
            room -= r["size"]
            fits.append((r["doc_id"], r["label"]))
    wanted = held.sparkSession.createDataFrame(fits, "doc_id long, label int")
    rows = held.join(F.broadcast(wanted), ["doc_id", "label"]).select("doc_id", "label", "text").collect()
    forget(held)
    found = sorted((r["doc_id"], r["text"].encode("utf-8", "surrogatepass"), r["label"]) for r in rows)
    return found, n.get(1, 0) / max(sum(n.values()), 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", example_bytes: int = EXAMPLE_BYTES) -> BlockMaxIndex:
    rows, prior = training_rows(docs, labels, label_col, folds, held_out, examples, id_col, text_col, example_bytes)
    texts = [t for _, t, _ in rows]
    label = np.array([y for _, _, y in rows], np.int64)
    ids = np.array([d for d, _, _ in rows], np.int64)
    terms = Vocabulary.of(texts)
    owner, term, n = terms.bags(texts)
    df, total = document_frequencies(docs.select(F.col(text_col).cast("string").alias("text")), terms)
    index = build_index(owner, term, n, label, ids, terms, df, total)
    index.prior = prior
    if (label == 1).any() and (label == 0).any():
        # Every example against all others; examples are numbered anew in the index.
        number = {key: k for k, key in enumerate(zip(index.ids.tolist(), index.label.tolist(), strict=True))}
        own = np.array([number[(d, y)] for d, y in zip(ids.tolist(), label.tolist(), strict=True)])
        votes = np.array([index.vote(i, c, neighbours) for i, c in index.search(owner, term, index.weights(owner, term, n, len(label)), len(label), neighbours, own)])
        weight = np.where(label == 1, prior / (label == 1).mean(), (1 - prior) / (label == 0).mean())
        index.curve = logistic_curve(votes, label.astype(float), weight)
        index.made.clear()
    return index


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, neighbours: int = NEIGHBOURS, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, vote and evidence (the nearest examples' ids, labels and cosines), one row per input row."""
    # Bounded by the fit's limits: the terms of the examples and their postings.
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                scores, votes, shown = [], [], []
                for ids, cosine in own.nearest(as_bytes(part.column("text")), neighbours):
                    votes.append(own.vote(ids, cosine, neighbours))
                    scores.append(own.score(votes[-1]))
                    shown.append([{"doc_id": int(own.ids[i]), "label": int(own.label[i]), "cosine": float(c)} for i, c in zip(ids[:evidence], cosine[:evidence], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(votes, pa.float64()), pa.array(shown, kind)], names=["doc_id", "score", "vote", "evidence"])

    schema = "doc_id long, score double, vote double, evidence array<struct<doc_id:long,label:int,cosine:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
