"""Quality classifier on supervised subword embeddings.

Words and character n-grams are hashed to learnt vectors; a text is the mean of its vectors, a softmax layer gives its
label. Trained by stochastic gradient descent in NumPy on a bounded sample of labelled rows. Scoring folds the linear
layer into the vectors (the mean of v.w equals the mean of v, times w), so a text costs one table look-up per feature.

Features of the bytes of a text, as they are: each word; each run of 3 and 4 bytes inside a word with its edges; and a mark for a
word equal to the one before it. Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from; no other column
enters a score.

Defined cases: null and blank texts have no features: their score is the softmax of the bias; repeated rows are
scored one by one; labels of one kind only give that kind's smoothed share; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import as_bytes, slices
from skipjack.llm.toxicity import training_rows
from skipjack.llm.windows import IS_SPACE, Words, mixed

#: Bound of the fit: labelled rows of each label.
EXAMPLES = 2500
BITS, DIM, EPOCHS, RATE = 18, 8, 6, 0.5
GRAMS = (3, 4)
FOLDS, HELD_OUT = 3, 1
REPEATED = 0  # bucket of the repeated-word mark


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text number of each), in the order of the texts for each kind of feature."""
    # A space at either end: a text's edges are its own, whatever stands beside it.
    words = Words([b" " + t + b" " for t in texts])
    size = np.uint64(64 - bits)
    buckets, owners = [], []

    def add(h, owner):
        buckets.append((h >> size).astype(np.int64))
        owners.append(owner)

    h = words.hashes()
    if len(h):
        add(h, words.text_of)
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (words.text_of[1:] == words.text_of[:-1])))
        buckets.append(np.full(int(same.sum()), REPEATED, np.int64))
        owners.append(words.text_of[same])
        data = words.data.astype(np.uint64)
        data[IS_SPACE[words.data]] = 32
        inside = ~IS_SPACE[words.data]
        owner = np.searchsorted(words.firsts, np.arange(len(data)), side="right") - 1
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            code = np.zeros(m, np.uint64)
            for j in range(n):
                code = (code << np.uint64(8)) | data[j : j + m]
            # The n-gram may begin or end with the edge of its word, but holds no white space inside.
            fine = np.ones(m, bool)
            for j in range(1, n - 1):
                fine &= inside[j : j + m]
            add(mixed((code[fine] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)), owner[:m][fine])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class QualityModel:
    """Folded model: logit of label 1 over label 0 = mean of table[bucket] + bias."""

    table: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: list[bytes]) -> np.ndarray:
        bucket, owner = features(texts, self.bits)
        total = np.bincount(owner, weights=self.table[bucket], minlength=len(texts))
        count = np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -500, 500)))


def train(texts: list[bytes], label: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> QualityModel:
    """Softmax over averaged vectors by SGD, one text a step, falling rate; classes weigh the same."""
    n1 = int(label.sum())
    if not n1 or n1 == len(label):
        share = (n1 + 0.5) / (len(label) + 1)
        return QualityModel(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for t in texts:
        bucket, _ = features([t], bits)
        ids, count = np.unique(bucket, return_counts=True)
        bags.append((ids, (count / max(count.sum(), 1)).astype(np.float32)))
    weight = np.where(label == 1, len(label) / (2 * n1), len(label) / (2 * (len(label) - n1)))
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for k in rng.permutation(len(texts)).tolist():
            pace = rate * (1 - step / steps) * weight[k]
            step += 1
            ids, share = bags[k]
            own = vectors[ids]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[k]] -= 1
            back = out @ p
            out -= (pace * np.outer(mean, p)).astype(np.float32)
            bias -= (0.05 * pace * p).astype(np.float32)
            # Rates of averaged features are small: the vectors take a longer step.
            vectors[ids] = own - (20 * pace * share)[:, None] * back
    return QualityModel(np.ascontiguousarray(vectors @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", examples: int = EXAMPLES, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    rows, _ = training_rows(docs, labels, label_col, folds, held_out, examples, id_col, text_col)
    return train([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (share of label 1), one row per input row."""
    # The model's size is fixed by its parameters: 2 ** bits weights.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(as_bytes(part.column("text"))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
