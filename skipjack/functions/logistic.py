"""Block pruning for logistic regression over embeddings: interval and norm-ball bounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipjack.operators.blocks import small


def logit(t: float) -> float:
    if not 0 < t < 1:
        raise ValueError("a probability lies between 0 and 1")
    return math.log(t / (1 - t))


def dual(p: float) -> float:
    if p < 1:
        raise ValueError("an exponent is at least 1")
    return math.inf if p == 1 else 1.0 if math.isinf(p) else p / (p - 1)


def norm(v, p: float) -> float:
    return float(np.linalg.norm(np.asarray(v, float), ord=p)) if not math.isinf(p) else float(np.abs(v).max())


def slices(dims: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, dims)) for a in range(0, dims, size)]


def exponents(most: int) -> list[float]:
    """1 to most."""
    return [float(p) for p in range(1, most + 1)]


def block_vectors(df: DataFrame, size: int, vector: str = "embedding", row: str = "row_id") -> DataFrame:
    """block_id, row_id, v."""
    return df.select(F.floor(F.col(row) / size).cast("long").alias("block_id"), F.col(row).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))


def dimension_bounds(vectors: DataFrame, dims: int) -> DataFrame:
    """block_id, lo, hi, center: one array entry per dimension, aggregated by its place without unfolding the vectors."""
    each = lambda f, name: F.array(*[f(F.get("v", F.lit(i))) for i in range(dims)]).alias(name)
    return vectors.groupBy("block_id").agg(each(F.min, "lo"), each(F.max, "hi"), each(F.avg, "center"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _literal(w: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in w])


def interval_range(bounds: DataFrame, w: list[float], b: float) -> DataFrame:
    """block_id, lo, hi of the logit from the bounds of each dimension."""
    first = bounds.select(F.size("lo").alias("n")).first()
    if first and first["n"] != len(w):
        raise ValueError("as many weights as dimensions")
    end = lambda up, down: _total(F.zip_with(F.zip_with(_literal(w), up, lambda c, x: F.struct(c.alias("c"), x.alias("x"))), down, lambda s, x: F.when(s["c"] >= 0, s["c"] * s["x"]).otherwise(s["c"] * x)))
    return bounds.select("block_id", (end("lo", "hi") + b).alias("lo"), (end("hi", "lo") + b).alias("hi"))


def _norm(values: Column, q: float) -> Column:
    """q-norm of an array of distances."""
    if math.isinf(q):
        return F.array_max(values)
    return _total(values) if q == 1 else F.pow(_total(F.transform(values, lambda x: F.pow(x, F.lit(q)))), F.lit(1 / q))


def ball_metadata(vectors: DataFrame, bounds: DataFrame, exponents: list[float], dims: int, slice_size: int | None = None) -> DataFrame:
    """block_id, slice, p, radius: the largest dual norm of a row's distance to the block's mean, per weight norm p.

    A row's norms are taken in the row; only their maxima are exchanged. The means meet the rows without exchanging them while
    their checked number allows.
    """
    parts = slices(dims, slice_size or dims)
    gap = vectors.join(small(bounds.select("block_id", "center")), "block_id").select("block_id", F.zip_with("v", "center", lambda a, c: F.abs(a - c)).alias("d"))
    aggs = []
    for s, (a, z) in enumerate(parts):
        own = F.slice("d", a + 1, z - a)
        for i, p in enumerate(exponents):
            q = dual(p)
            aggs.append(F.max(_norm(own, q)).alias(f"r{s}_{i}"))
    rows = gap.groupBy("block_id").agg(*aggs)
    number = lambda p: "double('Infinity')" if math.isinf(p) else f"double({p})"
    entries = ", ".join(f"{s}, {number(p)}, r{s}_{i}" for s in range(len(parts)) for i, p in enumerate(exponents))
    return rows.selectExpr("block_id", f"stack({len(parts) * len(exponents)}, {entries}) AS (slice, p, radius)")


def ball_range(balls: DataFrame, bounds: DataFrame, w: list[float], b: float, exponents: list[float], slice_size: int | None = None) -> DataFrame:
    """block_id, p, lo, hi: centre logit plus and minus the sum over slices of |w| times radius."""
    mid = bounds.select("block_id", (_total(F.zip_with("center", _literal(w), lambda c, x: c * x)) + b).alias("mid"))
    parts = slices(len(w), slice_size or len(w))
    # One row per exponent and slice.
    norms = balls.sparkSession.createDataFrame([(float(p), s, norm(w[a:z], p)) for p in exponents for s, (a, z) in enumerate(parts)], "p double, slice int, wn double")
    reach = balls.join(F.broadcast(norms), ["p", "slice"]).groupBy("block_id", "p").agg(F.sum(F.col("wn") * F.col("radius")).alias("reach"))
    return reach.join(mid, "block_id").select("block_id", "p", (F.col("mid") - F.col("reach")).alias("lo"), (F.col("mid") + F.col("reach")).alias("hi"))


def tightest(ranges: DataFrame, op: str) -> DataFrame:
    """The p with the least upper (>=) or greatest lower (<) bound; the smaller p wins ties."""
    if op == ">=":
        best = F.min(F.struct(F.col("hi").alias("k"), "p", "lo", "hi"))
    elif op == "<":
        best = F.min(F.struct((-F.col("lo")).alias("k"), "p", "lo", "hi"))
    else:
        raise ValueError(op)
    return ranges.groupBy("block_id").agg(best.alias("s")).select("block_id", F.col("s.p").alias("p"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def decide(ranges: DataFrame, op: str, t: float) -> DataFrame:
    """Adds should_skip: no logit in the range satisfies it."""
    if op not in (">=", "<"):
        raise ValueError(op)
    possible = F.col("hi") >= logit(t) if op == ">=" else F.col("lo") < logit(t)
    return ranges.withColumn("should_skip", ~possible)
