"""A one-layer network as a table of linear cells, and reachability as a join.

A shallow ReLU net is affine where no hidden unit changes sign. The data box is cut along the units' hyperplanes; each
activation pattern that can occur becomes a row: the pattern's bounding box and its affine function. A block may reach a range if, for a
cell its box overlaps, the function over the common box meets the range: an outer bound, so no block is skipped wrongly.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipjack.functions.mlp import Mlp
from skipjack.operators.blocks import small


def _shrink(lo, hi, planes, rounds=4):
    """Tighten a box under w.x + b >= 0; None if it is empty."""
    lo, hi = lo.copy(), hi.copy()
    for _ in range(rounds):
        for w, b in planes:
            top = np.where(w >= 0, w * hi, w * lo)
            total = top.sum() + b
            if total < 0:
                return None
            for i in np.flatnonzero(w):
                rest = -(total - top[i]) / w[i]
                if w[i] > 0:
                    lo[i] = max(lo[i], min(rest, hi[i]))
                else:
                    hi[i] = min(hi[i], max(rest, lo[i]))
                top[i] = max(w[i] * hi[i], w[i] * lo[i])
                total = top.sum() + b
    return lo, hi


def build_cells(net: Mlp, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
    """(cell_id, lower bounds, upper bounds, coefficients, constant) of every pattern not proved empty in the box."""
    if len(net.layers) != 2 or net.classes:
        raise ValueError("cells need a regressor with one hidden layer")
    (w1, b1), (w2, b2) = net.layers
    found: list[tuple] = []

    def cut(k, a, z, planes, active):
        if k == len(b1):
            on = np.array(active, float)
            found.append((len(found), a.tolist(), z.tolist(), ((w2[0] * on) @ w1).tolist(), float((w2[0] * on) @ b1 + b2[0])))
            return
        for sign in (1.0, -1.0):
            more = [*planes, (sign * w1[k], sign * b1[k])]
            box = _shrink(a, z, more)
            if box is not None:
                cut(k + 1, *box, more, [*active, sign > 0])

    cut(0, np.asarray(lo, float), np.asarray(hi, float), [], [])
    return found


def cell_table(spark: SparkSession, cells: list[tuple], names: list[str]) -> DataFrame:
    rows = [(c[0], *c[1], *c[2], *c[3], c[4]) for c in cells]
    kinds = ["cell_id int", *[f"c_{n}_{s} double" for s in ("lo", "hi", "w") for n in names], "c_b double"]
    return spark.createDataFrame(rows, ", ".join(kinds))


def reachable(meta: DataFrame, cells: DataFrame, names: list[str], lo: float, hi: float, within: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """block_id, reachable: overlap join of block boxes with cells, then bool_or per block.

    within: the box for which the cells were built; a block that reaches beyond it (or to no cell) stays reachable. The cells are
    a model's and are sent around if their checked number allows.
    """
    meet = F.lit(True)
    for n in names:
        meet = meet & (F.col(f"{n}_hi") >= F.col(f"c_{n}_lo")) & (F.col(f"{n}_lo") <= F.col(f"c_{n}_hi"))
    low, high = F.col("c_b"), F.col("c_b")
    for n in names:
        a, z, w = F.greatest(f"{n}_lo", f"c_{n}_lo"), F.least(f"{n}_hi", f"c_{n}_hi"), F.col(f"c_{n}_w")
        low, high = low + F.least(w * a, w * z), high + F.greatest(w * a, w * z)
    hit = F.when(F.col("cell_id").isNotNull(), (high >= lo) & (low <= hi))
    out = F.lit(False)
    for n, a, z in zip(names, within[0], within[1], strict=True):
        out = out | (F.col(f"{n}_lo") < float(a)) | (F.col(f"{n}_hi") > float(z))
    return meta.join(small(cells), meet, "left").groupBy("block_id").agg((F.bool_or(out) | F.coalesce(F.bool_or(hit), F.lit(True))).alias("reachable"))


def corner_rows(net: Mlp) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, factors, constants): every point where the extremes of a one-layer net over a box can lie.

    Such a point fixes some inputs at an end of the box (high: which end) and the others by as many hinges (zero sets of hidden units):
    input i is constants[i] + factors[i] . ends, so one table serves every box.
    """
    if len(net.layers) != 2:
        raise ValueError("corners are for one hidden layer")
    w, b = net.layers[0]
    n = w.shape[1]
    high, factors, constants = [], [], []
    for k in range(min(n, len(b)) + 1):
        for free in combinations(range(n), k):
            fixed = [i for i in range(n) if i not in free]
            for units in combinations(range(len(b)), k):
                own = w[np.ix_(units, free)]
                if k and abs(np.linalg.det(own)) < 1e-12:
                    continue
                f, c = np.zeros((n, n)), np.zeros(n)
                f[fixed, fixed] = 1
                if k:
                    f[np.ix_(free, fixed)] = -np.linalg.solve(own, w[np.ix_(units, fixed)])
                    c[list(free)] = -np.linalg.solve(own, b[list(units)])
                for ends in product((False, True), repeat=len(fixed)):
                    at = np.zeros(n, bool)
                    at[fixed] = ends
                    high.append(at)
                    factors.append(f)
                    constants.append(c)
    return np.array(high), np.array(factors), np.array(constants)


def corner_ranges(meta: DataFrame, net: Mlp, names: list[str]) -> DataFrame:
    """block_id, lo, hi: exact range of a one-layer regressor of any number of inputs over each block's box, by its corners."""
    high, factors, constants = corner_rows(net)

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                lo, hi = (pdf[[f"{x}_{s}" for x in names]].to_numpy(float) for s in ("lo", "hi"))
                ends = np.where(high[None], hi[:, None], lo[:, None])
                x = constants + np.einsum("cij,bcj->bci", factors, ends)
                slack = 1e-12 * (1 + np.abs(x))
                inside = ((x >= lo[:, None] - slack) & (x <= hi[:, None] + slack)).all(axis=2)
                value = net.forward(x.reshape(-1, len(names)))[:, 0].reshape(inside.shape)
                yield pd.DataFrame({"block_id": pdf.block_id, "lo": np.where(inside, value, np.inf).min(1), "hi": np.where(inside, value, -np.inf).max(1)})

    return meta.mapInPandas(run, "block_id long, lo double, hi double")
