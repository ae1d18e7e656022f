"""Uniform sharding by a hypergeometric communication matrix.

Every input partition p has n_p rows, every output block b (a slot range of one shard) takes a fixed number of rows.
How many rows go from p to b in a uniform random permutation follows a multivariate hypergeometric law. The matrix
is drawn exactly, but never held: a tree halves the range of partitions, each node splits its rows per block between its
halves, and a task walks down to its own row (log2 of the partitions draws per block, the same in every task and
attempt). Each task permutes its rows locally and deals them out by its row of the matrix; after the exchange each block is permuted again. The result is a uniform shuffle with
exact shard sizes (law ``rows``: counts at most one apart).

NumPy draws below 10^9 rows at a time; a node with more halves the range of blocks first, by a draw of its own for large
numbers, until the parts are small enough, so there is no largest table.

Shards are cut in blocks of about ``block_bytes``, so a task never holds a whole shard; blocks do not depend
on any key, so equal texts or a hot source cannot gather, and each block is dealt to the partition of its number. The source must give the same partitions when it is read
twice (files do); a task that meets another row count than the first pass saw stops the job instead of losing rows.

Defined cases: null texts are rows like any other; repeated rows each get their own slot; an empty table
gives an empty result; input columns of any name are carried along, those named shard or slot are replaced by the results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block, and its rows at most; partitions of the exchange at most (then several blocks, one after the other).
BLOCK_BYTES, BLOCK_ROWS, MOST_PARTITIONS = 32_000_000, 65_536, 100_000
#: Rows that NumPy's own law takes.
SMALL = 10**9 - 1


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def block_table(rows: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of every block."""
    out = []
    for shard, size in enumerate(shard_sizes(rows, shards).tolist()):
        parts = max(1, -(-size // block_rows))
        cuts = [size * k // parts for k in range(parts + 1)]
        out += [(shard, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def _log_factorial_rest(n: float) -> float:
    """ln n! less Stirling's n ln n - n + ln(2 pi n) / 2, for n of 1 or more."""
    if n < 16:
        return math.lgamma(n + 1) - (n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n))
    x = 1 / (n * n)
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x / 1188)))) / n


def _deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x, without the cancellation near x = m."""
    if x == 0:
        return m
    d = (x - m) / (x + m)
    if abs(d) > 0.1:
        return x * math.log(x / m) + m - x
    # ln(x / m) = 2 atanh d, and m - x = -d (x + m).
    total, power, k = (x - m) * d, 2 * x * d, 1
    while True:
        power *= d * d
        k += 2
        if total + power / k == total:
            return total
        total += power / k


def _log_binomial(x: int, n: int, p: float) -> float:
    """ln of the chance of x successes in n, by deviances: exact to rounding for any n."""
    if x == 0:
        return n * math.log1p(-p) if p < 0.1 else -_deviance(n, n * (1 - p)) - n * p
    if x == n:
        return n * math.log(p) if p < 0.9 else -_deviance(n, n * p) - n * (1 - p)
    rest = _log_factorial_rest(n) - _log_factorial_rest(x) - _log_factorial_rest(n - x)
    return rest - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_chance(x: int, good: int, bad: int, taken: int) -> float:
    """ln of the hypergeometric chance, up to a constant of (good, bad, taken)."""
    p = taken / (good + bad)
    return _log_binomial(x, good, p) + _log_binomial(taken - x, bad, p)


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Good ones among `taken` drawn without replacement, for any numbers: rejection by the ratio of uniforms."""
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    if good + bad <= SMALL:
        return int(rng.hypergeometric(good, bad, taken))
    total = good + bad
    mean = taken * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - taken) / max(total - 1, 1)))
    mode = min(max(int((taken + 1) * ((good + 1) / (total + 2))), low), high)
    peak = log_chance(mode, good, bad, taken)
    # For a log-concave law the ratio region fits a box about the mean, this wide (Stadlober's bound).
    half = math.sqrt(2 / math.e) * math.sqrt(spread * spread + 0.5) + 1.5 - math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        x = math.floor(mean + 0.5 + 2 * half * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_chance(x, good, bad, taken) - peak:
            return x


def split(held: np.ndarray, taken: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among `taken` drawn from held."""
    total = int(held.sum())
    if total <= SMALL:
        return rng.multivariate_hypergeometric(held, taken, method="marginals")
    if len(held) == 1:
        return np.array([taken], np.int64)
    half = len(held) // 2
    first = int(held[:half].sum())
    left = large_hypergeometric(rng, first, total - first, taken)
    return np.concatenate((split(held[:half], left, rng), split(held[half:], taken - left, rng)))


def matrix_row(sources: np.ndarray, targets: np.ndarray, seed: int, p: int) -> np.ndarray:
    """Rows from source p to each target; over all p the rows and columns have the given sums."""
    before = np.concatenate(([0], np.cumsum(sources)))
    low, high, held = 0, len(sources), np.asarray(targets, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(held, int(before[middle] - before[low]), np.random.default_rng([seed, low, high]))
        low, high, held = (low, middle, left) if p < middle else (middle, high, held - left)
    return held


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """The whole matrix, for inspection and tests."""
    return np.array([matrix_row(np.array(sources), np.array(targets), seed, p) for p in range(len(sources))])


def shard(docs: DataFrame, shards: int, seed: int = 20, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of docs, with shard int and slot long (gapless from 0 in each shard)."""
    names = [f for f in docs.schema.fieldNames() if f not in ("shard", "slot")]
    spark = docs.sparkSession
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # Columns of any name travel in one struct, apart from those made here.
    whole = docs.select(F.struct(F.lit(0).cast("byte").alias(""), *[column(c) for c in names]).alias("row"))

    def counted(batches):
        rows = size = 0
        for b in batches:
            rows += b.num_rows
            size += int(b.column("size").to_numpy().sum())
        yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([rows], pa.int64()), "size": pa.array([size], pa.int64())})

    # The first pass counts rows and bytes; the split into partitions depends on the files alone.
    wide = [c for c in names if isinstance(docs.schema[c].dataType, (T.StringType, T.BinaryType))]
    bytes_of = sum((F.coalesce(F.octet_length(column(c)), F.lit(0)).cast("long") for c in wide), F.lit(8 * len(names)).cast("long"))
    counts = {r["p"]: r for r in docs.select(bytes_of.alias("size")).mapInArrow(counted, "p int, n long, size long").collect()}
    rows, size = sum(r["n"] for r in counts.values()), sum(r["size"] for r in counts.values())
    block_rows = max(1, min(block_rows, int(block_bytes * rows / max(size, 1))))
    blocks = block_table(rows, shards, block_rows)
    order = {p: k for k, p in enumerate(sorted(counts))}
    sent = spark.sparkContext.broadcast((order, np.array([counts[p]["n"] for p in order], np.int64)))

    def deal(batches):
        p = TaskContext.get().partitionId()
        place, sizes = sent.value
        row = matrix_row(sizes, np.array([b[2] for b in block_table(rows, shards, block_rows)], np.int64), seed, place[p]) if p in place else np.zeros(0, np.int64)
        to = np.repeat(np.arange(len(row), dtype=np.int32), row)
        np.random.default_rng([seed, 1, p]).shuffle(to)
        keys = np.random.default_rng([seed, 2, p]).integers(-(2**63), 2**63, len(to), dtype=np.int64)
        at = 0
        for batch in batches:
            n = batch.num_rows
            if at + n > len(to):
                raise RuntimeError("the source gave other partitions on its second reading; store it first")
            extra = [pa.array(to[at : at + n]), pa.array(keys[at : at + n]), pa.array(np.full(n, p, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *extra], names=["row", "block", "key", "p", "at"])
            at += n
        if at != len(to):
            raise RuntimeError("the source gave other partitions on its second reading; store it first")

    schema = T.StructType([*whole.schema.fields, *(T.StructField(n, t) for n, t in (("block", T.IntegerType()), ("key", T.LongType()), ("p", T.IntegerType()), ("at", T.LongType())))])
    # One row per block: a few hundred kilobytes for a billion rows.
    table = spark.sparkContext.broadcast((np.array([b[0] for b in blocks], np.int32), np.array([b[1] for b in blocks], np.int64)))
    parts = max(1, min(len(blocks), MOST_PARTITIONS))
    dealt = whole.mapInArrow(deal, schema).repartitionById(parts, (F.col("block") % parts).cast("int")).sortWithinPartitions("block", "key", "p", "at")

    def number(batches):
        of, first = table.value
        last, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            new = np.concatenate(([block[0] != last], block[1:] != block[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(block)), -1))
            # Rows before the batch's first new block go on where the last batch ended.
            place = np.where(start >= 0, np.arange(len(block)) - start, np.arange(len(block)) + seen)
            last, seen = int(block[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(of[block]), pa.array(first[block] + place)], names=["row", "shard", "slot"])

    out = dealt.mapInArrow(number, T.StructType([*whole.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    return out.select(*[F.col("row")[c].alias(c) for c in names], "shard", "slot")
