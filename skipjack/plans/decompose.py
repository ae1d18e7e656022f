"""Piecewise-linear functions on cylindrical cells, and ReLU networks compiled to tables of them.

Hyperplanes cut R^n in cells so that every cell lies above a cell of R^(n-1) between two neighbouring hyperplanes. Where
two hyperplanes cross, their order changes, so the crossings, projected, are the hyperplanes one dimension below; with all of them
the order is the same all over a cell, and one sample point of it tells the order. Only open cells are kept: they cover all but
a set without volume, on which a continuous function has the values of its neighbours. Outer cells have infinite ends.

A network is compiled layer by layer: the zero sets of a layer's units are linear in every cell that the layers before have
made, so they are added to the hyperplanes, and in the finer cells the layer is linear again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skipjack.functions.mlp import Mlp

#: Decimals to which hyperplanes and functions are told apart.
DIGITS = 9


def distinct_planes(planes: np.ndarray) -> np.ndarray:
    """Rows (a, c) of a . x + c = 0 scaled to length one with the first nonzero factor above zero, each once; rows without a factor go."""
    planes = np.asarray(planes, float)
    if not len(planes):
        return planes
    size = np.linalg.norm(planes[:, :-1], axis=1)
    planes = planes[size > 10.0**-DIGITS] / size[size > 10.0**-DIGITS][:, None]
    if not len(planes):
        return planes
    first = np.argmax(np.abs(planes[:, :-1]) > 10.0**-DIGITS, axis=1)
    planes = planes * np.sign(planes[np.arange(len(planes)), first])[:, None]
    _, keep = np.unique(np.round(planes, DIGITS) + 0.0, axis=0, return_index=True)
    return planes[np.sort(keep)]


def solved(planes: np.ndarray) -> np.ndarray:
    """Rows (b, d) with x_last = b . x + d of the planes that bound the last variable."""
    bound = np.abs(planes[:, -2]) > 10.0**-DIGITS
    own = planes[bound]
    return -np.concatenate((own[:, :-2], own[:, -1:]), axis=1) / own[:, -2:-1]


def projected(planes: np.ndarray) -> np.ndarray:
    """Hyperplanes one dimension below: crossings of each two, and those that do not bound the last variable."""
    upright = planes[np.abs(planes[:, -2]) <= 10.0**-DIGITS]
    low = [np.concatenate((upright[:, :-2], upright[:, -1:]), axis=1)]
    roots = solved(planes)
    for k in range(len(roots)):
        low.append(roots[k + 1 :] - roots[k])
    return distinct_planes(np.concatenate(low))


def levels(planes: np.ndarray, dims: int) -> list[np.ndarray]:
    """Hyperplanes of every dimension, 1 to dims."""
    out = [distinct_planes(planes) if len(planes) else np.zeros((0, dims + 1))]
    while len(out) < dims:
        out.append(projected(out[-1]) if len(out[-1]) else np.zeros((0, dims - len(out) + 1)))
    return out[::-1]


@dataclass
class Cell:
    """lower and upper: factors of the variables before, then the constant; None is infinite."""

    number: int
    parent: Cell | None
    lower: np.ndarray | None
    upper: np.ndarray | None
    sample: np.ndarray
    children: list[Cell] = field(default_factory=list)

    @property
    def dim(self) -> int:
        return len(self.sample)

    def parents(self) -> list[Cell]:
        return [] if self.parent is None or self.parent.dim == 0 else [*self.parent.parents(), self.parent]


def between(low: float, high: float) -> float:
    """A point inside the open interval."""
    if np.isinf(low) and np.isinf(high):
        return 0.0
    return high - 1.0 if np.isinf(low) else low + 1.0 if np.isinf(high) else (low + high) / 2


class Decomposition:
    """The cells of R^dims under the hyperplanes; cells[k] are those of dimension k + 1, in order."""

    def __init__(self, planes: np.ndarray, dims: int):
        self.dims = dims
        self.planes = levels(np.asarray(planes, float).reshape(-1, dims + 1), dims)
        self.root = Cell(0, None, None, None, np.zeros(0))
        self.cells: list[list[Cell]] = []
        above = [self.root]
        for k in range(dims):
            roots, now = solved(self.planes[k]), []
            for cell in above:
                now += self._lift(cell, roots, len(now))
            self.cells.append(now)
            above = now

    @staticmethod
    def _lift(cell: Cell, roots: np.ndarray, first: int) -> list[Cell]:
        at = roots[:, :-1] @ cell.sample + roots[:, -1] if len(roots) else np.zeros(0)
        order = np.argsort(at, kind="stable")
        order = [k for j, k in enumerate(order) if j == 0 or at[k] - at[order[j - 1]] > 10.0**-DIGITS]
        ends = [-np.inf, *at[order].tolist(), np.inf]
        for k, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
            lower, upper = (None if k == 0 else roots[order[k - 1]]), (None if k == len(order) else roots[order[k]])
            cell.children.append(Cell(first + k, cell, lower, upper, np.append(cell.sample, between(low, high))))
        return cell.children

    @property
    def leaves(self) -> list[Cell]:
        return self.cells[-1]

    def locate(self, x: np.ndarray) -> Cell:
        """The leaf of a point, by binary search at each dimension; a point on a bound belongs to the cell above it."""
        cell = self.root
        for k in range(self.dims):
            low, high = 0, len(cell.children) - 1
            while low < high:
                middle = (low + high + 1) // 2
                bound = cell.children[middle].lower
                if x[k] >= bound[:-1] @ x[:k] + bound[-1]:
                    low = middle
                else:
                    high = middle - 1
            cell = cell.children[low]
        return cell


class Piecewise:
    """A function that is linear on every leaf: value = w . x + b."""

    def __init__(self, cells: Decomposition, functions: np.ndarray):
        """functions: one row (w, b) per leaf."""
        self.cells, self.functions = cells, np.asarray(functions, float).reshape(len(cells.leaves), cells.dims + 1)

    @classmethod
    def linear(cls, dims: int, function: np.ndarray) -> Piecewise:
        return cls(Decomposition(np.zeros((0, dims + 1)), dims), [function])

    def value(self, x: np.ndarray) -> float:
        f = self.functions[self.cells.locate(x).number]
        return float(f[:-1] @ x + f[-1])

    def refined(self, planes: np.ndarray) -> Piecewise:
        """The same function on the cells that further hyperplanes cut."""
        finer = Decomposition(np.concatenate((self.cells.planes[-1], np.asarray(planes, float).reshape(-1, self.cells.dims + 1))), self.cells.dims)
        return Piecewise(finer, [self.functions[self.cells.locate(c.sample).number] for c in finer.leaves])

    def plus(self, other: Piecewise) -> Piecewise:
        """The sum, on the cells of both."""
        mine = self.refined(other.cells.planes[-1])
        theirs = [other.functions[other.cells.locate(c.sample).number] for c in mine.cells.leaves]
        return Piecewise(mine.cells, mine.functions + np.array(theirs))

    def scaled(self, factor: float) -> Piecewise:
        return Piecewise(self.cells, self.functions * factor)

    def shifted(self, bias: float) -> Piecewise:
        out = self.functions.copy()
        out[:, -1] += bias
        return Piecewise(self.cells, out)

    def zero_sets(self) -> np.ndarray:
        """Hyperplanes on which some leaf's function is zero."""
        return distinct_planes(self.functions)

    def relu(self) -> Piecewise:
        finer = self.refined(self.zero_sets())
        at = np.array([f[:-1] @ c.sample + f[-1] for f, c in zip(finer.functions, finer.cells.leaves, strict=True)])
        return Piecewise(finer.cells, np.where((at > 0)[:, None], finer.functions, 0.0))


def network_leaves(net: Mlp) -> tuple[Decomposition, np.ndarray]:
    """(cells, outputs x leaves x (inputs + 1) functions): every output of the network is linear on every leaf."""
    dims = net.layers[0][0].shape[1]
    cells = Decomposition(np.zeros((0, dims + 1)), dims)
    units = np.concatenate((np.eye(dims), np.zeros((dims, 1))), axis=1)[None]  # leaves x units x (dims + 1)
    for k, (w, b) in enumerate(net.layers):
        units = np.einsum("ou,lui->loi", w, units)
        units[:, :, -1] += b
        if k == len(net.layers) - 1:
            break
        finer = Decomposition(np.concatenate((cells.planes[-1], distinct_planes(units.reshape(-1, dims + 1)))), dims)
        units = units[[cells.locate(c.sample).number for c in finer.leaves]]
        samples = np.array([c.sample for c in finer.leaves])
        on = np.einsum("lui,li->lu", units[:, :, :-1], samples) + units[:, :, -1] > 0
        cells, units = finer, np.where(on[:, :, None], units, 0.0)
    return cells, units.transpose(1, 0, 2)


def compile_network(net: Mlp, output: int = 0) -> Piecewise:
    cells, functions = network_leaves(net)
    return Piecewise(cells, functions[output])


@dataclass
class Compiled:
    """Rows of the tables: dims[k] are (id, parent id, lower factors.., upper factors..), functions and which leaf has which."""

    dims: list[list[tuple]]
    functions: list[tuple]
    leaves: list[tuple[int, int]]


def compiled(pieces: Piecewise) -> Compiled:
    """Tables of the cells. Neighbouring leaves above one parent with the same function become one; equal functions are kept once."""
    dims = []
    flat = lambda bound, k, end: [0.0] * (k - 1) + [end] if bound is None else bound.tolist()
    for k, cells in enumerate(pieces.cells.cells[:-1], 1):
        dims.append([(c.number, c.parent.number, *flat(c.lower, k, -np.inf), *flat(c.upper, k, np.inf)) for c in cells])
    known: dict[tuple, int] = {}
    functions: list[tuple] = []
    merged: list[tuple[Cell, Cell, int]] = []
    for c in pieces.cells.leaves:
        number = known.setdefault(tuple((np.round(pieces.functions[c.number], DIGITS) + 0.0).tolist()), len(known))
        if number == len(functions):
            functions.append((number, *pieces.functions[c.number].tolist()))
        if merged and merged[-1][2] == number and merged[-1][0].parent is c.parent:
            merged[-1] = (merged[-1][0], c, number)
        else:
            merged.append((c, c, number))
    n = pieces.cells.dims
    dims.append([(k, a.parent.number, *flat(a.lower, n, -np.inf), *flat(z.upper, n, np.inf)) for k, (a, z, _) in enumerate(merged)])
    return Compiled(dims, functions, [(k, f) for k, (_, _, f) in enumerate(merged)])


def tables(spark: SparkSession, own: Compiled) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(cells of each dimension, component functions, function of each leaf)."""
    cells = []
    for k, rows in enumerate(own.dims, 1):
        bounds = [f"{s}{i} double" for s in ("l", "u") for i in range(k)]
        cells.append(spark.createDataFrame(rows, ", ".join([f"id{k} long", f"parent{k} long", *bounds])))
    n = len(own.dims)
    functions = spark.createDataFrame(own.functions, ", ".join(["function_id long", *[f"w{i} double" for i in range(n + 1)]]))
    leaves = spark.createDataFrame(own.leaves, f"id{n} long, function_id long")
    return cells, functions, leaves


def _bound(side: str, k: int, before: list[str]) -> Column:
    """Value of a cell's bound at the variables before; the factors of an infinite end are zero."""
    out = F.col(f"{side}{k - 1}")
    for i, x in enumerate(before):
        out = out + F.col(f"{side}{i}") * F.col(x)
    return out


def evaluate(points: DataFrame, names: list[str], own: Compiled, limit: int = 200_000) -> DataFrame:
    """points with function_id and value, found down the cell tree: a range join to the cells of the first dimension, then equi joins on the parent.

    The tables belong to a model and are sent around if their checked size allows.
    """
    cells, functions, leaves = tables(points.sparkSession, own)
    sent = lambda df, n: F.broadcast(df) if n <= limit else df
    out = points
    for k, (df, rows) in enumerate(zip(cells, own.dims, strict=True), 1):
        x = F.col(names[k - 1])
        inside = (x >= _bound("l", k, names[: k - 1])) & (x < _bound("u", k, names[: k - 1]))
        if k > 1:
            inside = (F.col(f"parent{k}") == F.col(f"id{k - 1}")) & inside
        out = out.join(sent(df, len(rows)), inside).drop(*[c for c in df.columns if c != f"id{k}"])
    out = out.join(sent(leaves, len(own.leaves)), f"id{len(cells)}").join(sent(functions, len(own.functions)), "function_id")
    value = F.col(f"w{len(names)}")
    for i, x in enumerate(names):
        value = value + F.col(f"w{i}") * F.col(x)
    return out.withColumn("value", value).drop(*[f"id{k}" for k in range(1, len(cells) + 1)], *[f"w{i}" for i in range(len(names) + 1)])


def box_leaves(meta: DataFrame, names: list[str], own: Compiled) -> DataFrame:
    """meta joined with the two-input cells its boxes meet: xa, xz (the common interval of the first input) and the cell's rows."""
    if len(names) != 2:
        raise ValueError("exact clipping is for two inputs")
    x, y = names
    (first, second), functions, leaves = tables(meta.sparkSession, own)
    d1 = first.select("id1", F.col("l0").alias("x_from"), F.col("u0").alias("x_to"))
    out = meta.join(F.broadcast(d1), (F.col(f"{x}_hi") >= F.col("x_from")) & (F.col(f"{x}_lo") <= F.col("x_to")))
    out = out.join(F.broadcast(second), F.col("parent2") == F.col("id1"))
    out = out.join(F.broadcast(leaves), "id2").join(F.broadcast(functions), "function_id")
    return out.withColumn("xa", F.greatest(f"{x}_lo", "x_from")).withColumn("xz", F.least(f"{x}_hi", "x_to"))


def box_ranges(meta: DataFrame, names: list[str], own: Compiled, per_cell: bool = False) -> DataFrame:
    """block_id, lo, hi: exact range of a two-input function over each block's box (per_cell: one row, with id2, for each cell it meets).

    Above a point of the first input a cell meets the box in an interval of the second. The function is linear, so its extremes over
    the common polygon lie at corners: at the ends of the common interval and where a bound of the cell crosses a side of the box.
    """
    x, y = names
    joined = box_leaves(meta, names, own)
    crossing = lambda s, v: F.when(F.col(f"{s}0") != 0, (v - F.col(f"{s}1")) / F.col(f"{s}0"))
    places = [F.col("xa"), F.col("xz"), *[crossing(s, F.col(f"{y}_{e}")) for s in ("l", "u") for e in ("lo", "hi")]]
    slack = lambda v: F.lit(1e-12) * (F.lit(1.0) + F.abs(v))

    def ends(at: Column) -> Column:
        low = F.greatest(F.col(f"{y}_lo"), F.col("l0") * at + F.col("l1"))
        high = F.least(F.col(f"{y}_hi"), F.col("u0") * at + F.col("u1"))
        value = lambda v: F.col("w0") * at + F.col("w1") * v + F.col("w2")
        there = at.isNotNull() & (at >= F.col("xa")) & (at <= F.col("xz")) & (low <= high + slack(high))
        return F.when(there, F.array(value(low), value(high))).otherwise(F.array().cast("array<double>"))

    values = joined.select("block_id", "id2", F.explode(F.flatten(F.array(*[ends(p) for p in places]))).alias("v"))
    return values.groupBy("block_id", *(["id2"] if per_cell else [])).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
