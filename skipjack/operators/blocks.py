"""Block metadata: bounds, hulls, occupancy grids, and their sizes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a side that may be sent to every task.
BROADCAST_ROWS = 200_000


def block_minmax(points: DataFrame, features: list[str]) -> DataFrame:
    """Bounds per block; aggregated before the shuffle, so a block sends one row per task."""
    return points.groupBy("block_id").agg(F.count("*").alias("n_rows"), *[g(f).alias(f"{f}_{s}") for f in features for g, s in ((F.min, "lo"), (F.max, "hi"))])


def small(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side marked for broadcast if it has at most `limit` rows."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def cell_index(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Cell along one axis; an axis without extent has the one cell 0."""
    return F.when(hi > lo, F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - lo) / (hi - lo) * n).cast("int")))).otherwise(F.lit(0))


def grid_cells(points: DataFrame, x: str, y: str, depth: int) -> DataFrame:
    """(block_id, cell): the occupied cells of a 2**depth grid over each block's bounds.

    Each axis is indexed on its own, so a constant feature does not hide the extent of the other. Points meet their block's
    bounds without being exchanged while the bounds' checked number allows; the distinct cells are folded before they are.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    n = 2**depth
    box = block_minmax(points, [x, y]).drop("n_rows")
    joined = points.join(small(box), "block_id")
    ix = cell_index(F.col(x), F.col(f"{x}_lo"), F.col(f"{x}_hi"), n)
    iy = cell_index(F.col(y), F.col(f"{y}_lo"), F.col(f"{y}_hi"), n)
    return joined.select("block_id", (iy * n + ix).cast("int").alias("cell")).distinct()


def cell_rectangle(cell: Column, lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, depth: int) -> list[Column]:
    """x_lo, x_hi, y_lo, y_hi of a cell; an axis without extent keeps its one value."""
    n = 2**depth
    ix, iy = cell % n, F.floor(cell / n)
    return [lo_x + ix * (hi_x - lo_x) / n, lo_x + (ix + 1) * (hi_x - lo_x) / n, lo_y + iy * (hi_y - lo_y) / n, lo_y + (iy + 1) * (hi_y - lo_y) / n]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise from the least point; collinear points dropped."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts.tolist()) + half(pts.tolist()[::-1]))


def half_spaces(hull: np.ndarray) -> list[tuple[float, float, float]]:
    """a x + b y <= c for each edge; fewer than three corners bound nothing."""
    if len(hull) < 3:
        return []
    out = []
    for (x, y), (u, v) in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        a, b = v - y, -(u - x)
        out.append((float(a), float(b), float(a * x + b * y)))
    return out


HULL = "array<struct<x:double,y:double>>"


def _corners(rows: list[np.ndarray]) -> list[list[dict]]:
    return [[{"x": float(a), "y": float(b)} for a, b in h] for h in rows]


def pair_hulls(points: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(block_id, pair, hull): hulls of every pair of features, in one pass.

    A task first takes the hulls of what it has of each block, since the rows of a block mostly lie together; only their
    corners are exchanged, and merged per block and pair.
    """
    def local(batches):
        for pdf in batches:
            out = []
            for block, rows in pdf.groupby("block_id", sort=False):
                for k, (x, y) in enumerate(pairs):
                    out += [(block, k, float(a), float(b)) for a, b in convex_hull(rows[[x, y]].to_numpy())]
            yield pd.DataFrame(out, columns=["block_id", "pair", "x", "y"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block_id": [pdf.block_id.iloc[0]], "pair": [pdf.pair.iloc[0]], "hull": _corners([convex_hull(pdf[["x", "y"]].to_numpy())])})

    names = sorted({n for p in pairs for n in p})
    corners = points.select("block_id", *names).mapInPandas(local, "block_id long, pair int, x double, y double")
    return corners.groupBy("block_id", "pair").applyInPandas(merge, f"block_id long, pair int, hull {HULL}")


def block_hulls(points: DataFrame, x: str, y: str) -> DataFrame:
    """(block_id, hull array<struct<x,y>>)."""
    return pair_hulls(points, [(x, y)]).drop("pair")


def bounded_hulls(points: DataFrame, x: str, y: str, depth: int) -> DataFrame:
    """Hull of the occupied cells' corners per block; at most 4 ** depth cells a block."""
    box = block_minmax(points, [x, y]).drop("n_rows")
    rect = cell_rectangle(F.col("cell"), F.col(f"{x}_lo"), F.col(f"{x}_hi"), F.col(f"{y}_lo"), F.col(f"{y}_hi"), depth)
    cells = grid_cells(points, x, y, depth).join(small(box), "block_id").select("block_id", *[c.alias(n) for c, n in zip(rect, ("x0", "x1", "y0", "y1"), strict=True)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = np.concatenate([pdf[[a, b]].to_numpy() for a in ("x0", "x1") for b in ("y0", "y1")])
        return pd.DataFrame({"block_id": [pdf.block_id.iloc[0]], "hull": [[{"x": float(a), "y": float(b)} for a, b in convex_hull(corners)]]})

    return cells.groupBy("block_id").applyInPandas(run, "block_id long, hull array<struct<x:double,y:double>>")


def feature_pairs(features: list[str]) -> list[tuple[str, str]]:
    return list(combinations(features, 2))


def storage_bytes(kind: str, n_features: int = 2, vertices: int = 0, depth: int = 4) -> int:
    """Numeric bytes of one block's metadata (of one pair for the geometric kinds)."""
    if kind == "minmax":
        return 16 * n_features
    if kind == "convex_hull":
        return 16 * vertices
    if kind == "grid":
        return -(-(4**depth) // 8) + 16 * n_features
    if kind == "bounded_convex_hull":
        return -(-(vertices * (2 * depth + 2)) // 8) + 16 * n_features
    raise ValueError(kind)
