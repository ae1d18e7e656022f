"""Block metadata of any number of features: bounds, and geometry of all pairs of features, as one nested row per block.

A row is (block_id, n_rows, bounds map<feature, struct<lo, hi>>, pairs array<struct<feature_x, feature_y, hull, grid_depth,
grid_cells, bounded_hull>>). Fewer than two features have bounds only, whatever the kind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipjack.operators import blocks as bl
from skipjack.plans.workload import FilterSpec
from skipjack.storage import stored

KINDS = ("minmax", "convex_hull", "grid", "bounded_convex_hull")
DEPTH = 4
PAIR = f"struct<feature_x:string,feature_y:string,hull:{bl.HULL},grid_depth:int,grid_cells:array<int>,bounded_hull:{bl.HULL}>"


def resolve_kind(kind: str | None, spec: FilterSpec | None = None) -> str:
    """What the caller says, else the filter's hint, else bounds."""
    found = kind or (spec.kind if spec else None) or "minmax"
    if found not in KINDS:
        raise ValueError(f"unknown metadata {found}; known: {', '.join(KINDS)}")
    return found


def resolve_depth(depth: int | None, spec: FilterSpec | None = None) -> int:
    """What the caller says, else the filter's hint, else 4."""
    found = depth if depth is not None else spec.grid_depth if spec and spec.grid_depth is not None else DEPTH
    if found < 0:
        raise ValueError("depth must not be negative")
    return found


def matrix_bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a block's feature matrix; nan for a block without rows."""
    if not len(rows):
        return np.full(rows.shape[1], np.nan), np.full(rows.shape[1], np.nan)
    return rows.min(axis=0), rows.max(axis=0)


def _cells(points: DataFrame, pairs: list[tuple[str, str]], depth: int) -> DataFrame:
    """(block_id, pair, cells): the occupied cells of every pair, in one pass over the points."""
    names = sorted({n for p in pairs for n in p})
    joined = points.join(bl.small(bl.block_minmax(points, names).drop("n_rows")), "block_id")
    n = 2**depth
    index = {f: bl.cell_index(F.col(f), F.col(f"{f}_lo"), F.col(f"{f}_hi"), n) for f in names}
    each = F.array(*[F.struct(F.lit(k).alias("pair"), (index[y] * n + index[x]).cast("int").alias("cell")) for k, (x, y) in enumerate(pairs)])
    flat = joined.select("block_id", F.explode(each).alias("c")).select("block_id", "c.pair", "c.cell")
    return flat.groupBy("block_id", "pair").agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def _bounded(cells: DataFrame, box: DataFrame, pairs: list[tuple[str, str]], depth: int) -> DataFrame:
    """(block_id, pair, hull) of the corners of the occupied cells; at most 4 ** depth cells a row."""
    n = 2**depth

    def run(batches):
        for pdf in batches:
            hulls = []
            for r in pdf.itertuples(index=False):
                x, y = pairs[r.pair]
                cell = np.array(r.cells, np.int64)
                lo_x, hi_x, lo_y, hi_y = (getattr(r, f"{f}_{s}") for f in (x, y) for s in ("lo", "hi"))
                ix, iy = cell % n, cell // n
                corners = [np.stack((lo_x + (ix + a) * (hi_x - lo_x) / n, lo_y + (iy + b) * (hi_y - lo_y) / n), 1) for a in (0, 1) for b in (0, 1)]
                hulls.append(bl.convex_hull(np.concatenate(corners)))
            yield pd.DataFrame({"block_id": pdf.block_id, "pair": pdf.pair, "hull": bl._corners(hulls)})

    return cells.join(bl.small(box), "block_id").mapInPandas(run, f"block_id long, pair int, hull {bl.HULL}")


def collect(points: DataFrame, features: list[str], kind: str = "minmax", depth: int = DEPTH, blocks: list[int] | None = None) -> DataFrame:
    """One nested row per block that has points; blocks: only these."""
    resolve_kind(kind)
    if blocks is not None:
        points = points.where(F.col("block_id").isin(blocks)) if blocks else points.limit(0)
    box = bl.block_minmax(points, features)
    bounds = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.struct(F.col(f"{f}_lo").alias("lo"), F.col(f"{f}_hi").alias("hi")) for f in features]))
    rows = box.select("block_id", "n_rows", bounds.alias("bounds"))
    pairs = bl.feature_pairs(features)
    if kind == "minmax" or not pairs:
        return rows.withColumn("pairs", F.array().cast(f"array<{PAIR}>"))
    none = {"hull": F.lit(None).cast(bl.HULL), "grid_depth": F.lit(None).cast("int"), "grid_cells": F.lit(None).cast("array<int>"), "bounded_hull": F.lit(None).cast(bl.HULL)}
    if kind == "convex_hull":
        found, own = bl.pair_hulls(points, pairs), {"hull": F.col("hull")}
    else:
        cells = _cells(points, pairs, depth)
        found, own = cells, {"grid_cells": F.col("cells"), "grid_depth": F.lit(depth)}
        if kind == "bounded_convex_hull":
            found, own = _bounded(cells, box.drop("n_rows"), pairs, depth), {"bounded_hull": F.col("hull"), "grid_depth": F.lit(depth)}
    name = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("pair") + 1)
    part = F.struct(F.col("pair").alias("k"), F.struct(name(0).alias("feature_x"), name(1).alias("feature_y"), *[(own | {}).get(c, v).alias(c) for c, v in none.items()]).alias("p"))
    grouped = found.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["p"]).cast(f"array<{PAIR}>").alias("pairs"))
    return rows.join(grouped, "block_id")


def size_bytes(meta: DataFrame, kind: str) -> Column:
    """Numeric bytes of a block's metadata: bounds (not counted for convex hulls), corners, cells."""
    each = F.aggregate(
        "pairs",
        F.lit(0).cast("long"),
        lambda total, p: total
        + 16 * F.coalesce(F.size(p["hull"]), F.lit(0))
        + F.when(p["grid_cells"].isNotNull(), F.ceil(F.pow(F.lit(4.0), p["grid_depth"]) / 8)).otherwise(0).cast("long")
        + F.when(p["bounded_hull"].isNotNull(), F.ceil(F.size(p["bounded_hull"]) * (2 * p["grid_depth"] + 2) / 8)).otherwise(0).cast("long"),
    )
    return each + (F.lit(0) if kind == "convex_hull" else 16 * F.size("bounds"))


def size_summary(meta: DataFrame, kind: str, ms: Column | None = None) -> DataFrame:
    """One row: blocks, bytes a block, milliseconds a block (ms: a column of meta), vertices a pair."""
    ms = F.lit(None).cast("double") if ms is None else ms
    sized = meta.select(size_bytes(meta, kind).alias("bytes"), ms.alias("ms"), "pairs")
    shape = "bounded_hull" if kind == "bounded_convex_hull" else "hull"
    whole = sized.agg(
        F.lit(kind).alias("kind"),
        F.count("*").alias("block_count"),
        F.avg("bytes").alias("avg_bytes"),
        F.median("bytes").alias("median_bytes"),
        F.max("bytes").alias("max_bytes"),
        F.sum("ms").alias("total_ms"),
        F.avg("ms").alias("avg_ms"),
        F.median("ms").alias("median_ms"),
        F.max("ms").alias("max_ms"),
    )
    n = sized.select(F.explode("pairs").alias("p")).select(F.size(f"p.{shape}").alias("n")).where("n >= 0")
    vertices = n.agg(F.avg("n").alias("avg_vertices"), F.median("n").alias("median_vertices"), F.max("n").alias("max_vertices"))
    return whole.crossJoin(vertices)  # one row each


def pair_count(meta: DataFrame) -> int:
    """Pairs of the first block."""
    first = meta.orderBy("block_id").select(F.size("pairs").alias("n")).first()
    return first["n"] if first else 0


def flat(meta: DataFrame, features: list[str]) -> DataFrame:
    """block_id, <feature>_lo and _hi, and the hull of the first pair if there is one: what the verifiers take."""
    cols = [F.col("bounds")[f][s].alias(f"{f}_{s}") for f in features for s in ("lo", "hi")]
    first = F.get("pairs", F.lit(0))
    return meta.select("block_id", *cols, F.coalesce(first["bounded_hull"], first["hull"]).alias("hull"))


class Bundle:
    """Metadata by (table, features, kind, depth), each collected once and stored."""

    def __init__(self):
        self.held: dict[tuple, DataFrame] = {}

    def get(self, key: str, points: DataFrame, features: list[str], kind: str = "minmax", depth: int = DEPTH) -> DataFrame:
        own = (key, tuple(features), kind, depth if kind in ("grid", "bounded_convex_hull") else None)
        if own not in self.held:
            self.held[own] = stored(collect(points, features, kind, depth), f"metadata-{kind}")
        return self.held[own]
