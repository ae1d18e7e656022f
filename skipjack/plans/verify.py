"""May a block hold a matching row? Every answer but a proof keeps the block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipjack.functions.mlp import COLUMN_WIDTH, Mlp

UNSAT, SAT, TIMEOUT, ERROR = "unsat", "sat", "timeout", "error"
#: Outward slack for inference in another precision or order of sums.
SLACK = 1e-5


def status_text(status: Column, detail: Column | None = None) -> Column:
    out = F.when(status == TIMEOUT, F.lit("TIMEOUT"))
    if detail is not None:
        out = out.when(status == ERROR, F.concat(F.lit("ERROR ("), detail, F.lit(")")))
    return out.otherwise(F.upper(status))


def interval_columns(net: Mlp, lo: list[Column], hi: list[Column]) -> list[tuple[Column, Column]]:
    """Bounds of every output as Columns (interval propagation), for narrow nets."""
    now = list(zip(lo, hi, strict=True))
    for k, (w, b) in enumerate(net.layers):
        out = []
        for row, bias in zip(w, b, strict=True):
            low, high = F.lit(float(bias)), F.lit(float(bias))
            for c, (a, z) in zip(row.tolist(), now, strict=True):
                if c:
                    low, high = low + F.lit(c) * (a if c > 0 else z), high + F.lit(c) * (z if c > 0 else a)
            out.append((F.greatest(F.lit(0.0), low), F.greatest(F.lit(0.0), high)) if k < len(net.layers) - 1 else (low, high))
        now = out
    return now


def interval_bounds(net: Mlp, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for k, (w, b) in enumerate(net.layers):
        p, n = np.maximum(w, 0), np.minimum(w, 0)
        lo, hi = lo @ p.T + hi @ n.T + b, hi @ p.T + lo @ n.T + b
        if k < len(net.layers) - 1:
            lo, hi = np.maximum(lo, 0), np.maximum(hi, 0)
    return lo, hi


def linear_form(net: Mlp, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, float]:
    """(c, d): c . x + d is at most goal . outputs everywhere in the box (backward linear relaxation of the ReLUs)."""
    bounds, a, z = [], lo, hi
    for w, b in net.layers[:-1]:
        p, n = np.maximum(w, 0), np.minimum(w, 0)
        a, z = p @ a + n @ z + b, p @ z + n @ a + b
        bounds.append((a, z))
        a, z = np.maximum(a, 0), np.maximum(z, 0)
    w, b = net.layers[-1]
    c, d = goal @ w, float(goal @ b)
    for (w, b), (a, z) in zip(reversed(net.layers[:-1]), reversed(bounds), strict=True):
        span = np.where(z > a, z - a, 1.0)
        up = np.where(a >= 0, 1.0, np.where(z <= 0, 0.0, z / span))
        shift = np.where((a < 0) & (z > 0), -a * up, 0.0)
        low = np.where(a >= 0, 1.0, np.where(z <= 0, 0.0, (z > -a).astype(float)))
        d += float((np.minimum(c, 0) * shift).sum())
        c = np.where(c >= 0, c * low, c * up)
        c, d = c @ w, d + float(c @ b)
    return c, d


def plain_bound(net: Mlp, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray) -> float:
    """Lower bound of goal . outputs by intervals; now and then the better one."""
    a, z = interval_bounds(net, lo, hi)
    return float(np.where(goal >= 0, goal * a, goal * z).sum())


def linear_bounds(net: Mlp, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray) -> float:
    """Lower bound of goal . outputs over a box."""
    c, d = linear_form(net, lo, hi, goal)
    return float(np.where(c >= 0, c * lo, c * hi).sum() + d)


def goals(net: Mlp, lo: float | None, hi: float | None, target: int | None) -> list[tuple[np.ndarray, float]]:
    """Pairs (g, t): if g . outputs > t over the whole region for one pair, no row can match."""
    n = len(net.layers[-1][1])
    if net.classes:
        out = []
        for j in range(n):
            if j != target:
                g = np.zeros(n)
                g[j], g[target] = 1.0, -1.0
                out.append((g, 0.0))
        return out
    one = np.ones(1)
    return [(one, float(hi)), (-one, -float(lo))]


class Region:
    """A box, cut by half-spaces a x + b y <= c over two of the inputs whose corners are known (none: the box alone)."""

    def __init__(self, half_spaces=(), pair: tuple[int, int] = (0, 1), corners: np.ndarray | None = None):
        self.planes, self.pair, self.corners = list(half_spaces), pair, corners

    def holds(self, x: np.ndarray) -> bool:
        i, j = self.pair
        return all(p * x[i] + q * x[j] <= c for p, q, c in self.planes)

    def apart(self, lo: np.ndarray, hi: np.ndarray) -> bool:
        """Whether a part of the box lies outside one of the half-spaces."""
        i, j = self.pair
        return any(min(p * lo[i], p * hi[i]) + min(q * lo[j], q * hi[j]) > c + SLACK * (1 + abs(c)) for p, q, c in self.planes)

    def least(self, c: np.ndarray, d: float, lo: np.ndarray, hi: np.ndarray) -> float:
        """Lower bound of c . x + d over the part: over its box, and over the corners for the pair."""
        each = np.where(c >= 0, c * lo, c * hi)
        out = float(each.sum() + d)
        if self.corners is not None and len(self.corners) > 2:
            i, j = self.pair
            out = max(out, out - float(each[i] + each[j]) + float((self.corners @ c[[i, j]]).min()))
        return out


def reaches(net: Mlp, lo: np.ndarray, hi: np.ndarray, goal: np.ndarray, least: float, region: Region, budget: int) -> bool | None:
    """Is there a point of the region where goal . outputs <= least? None: not decided within the budget of parts."""
    parts, used = [(lo.astype(float), hi.astype(float))], 0
    while parts:
        a, z = parts.pop()
        used += 1
        if region.apart(a, z):
            continue
        c, d = linear_form(net, a, z, goal)
        bound = max(region.least(c, d, a, z), plain_bound(net, a, z, goal))
        if bound > least + SLACK * (1 + abs(bound)):
            continue
        # Likely points: where the linear form is least, the middle, and the region's own corners.
        tried = [np.where(c >= 0, a, z), (a + z) / 2]
        if used == 1 and region.corners is not None and len(region.corners):
            i, j = region.pair
            for corner in region.corners:
                x = tried[0].copy()
                x[[i, j]] = corner
                tried.append(x)
        own = [k for k, x in enumerate(tried) if k > 1 or region.holds(x)]
        if own and (net.forward(np.array([tried[k] for k in own])) @ goal <= least).any():
            return True
        if used >= budget:
            return None
        width = (z - a) * np.maximum(np.abs(c), 1e-9)
        k = int(np.argmax(width))
        if z[k] <= a[k]:
            return True  # a point within the slack
        middle = (a[k] + z[k]) / 2
        left, right = z.copy(), a.copy()
        left[k] = right[k] = middle
        halves = [(a, left), (right, z)]
        parts += halves if c[k] < 0 else halves[::-1]  # the likelier half last, so first
    return False


def exact_status(net: Mlp, lo: np.ndarray, hi: np.ndarray, lo_out=None, hi_out=None, target=None, half_spaces=(), pair=(0, 1), budget: int = 400, corners: np.ndarray | None = None) -> str:
    """Does a point of the block's region satisfy the predicate? Beyond the budget: timeout (keeps the block).

    A regressor is continuous and the region is connected, so a value in [lo_out, hi_out] is taken exactly if some value is at most
    hi_out and some value is at least lo_out: two one-sided searches. A classifier's region is cut until every part is
    proved or a point is found.
    """
    if not np.isfinite(lo).all() or not np.isfinite(hi).all():
        return ERROR
    region = Region(half_spaces, pair, corners)
    if not net.classes:
        one = np.ones(1)
        below = reaches(net, lo, hi, one, float(hi_out), region, budget)
        above = False if below is False else reaches(net, lo, hi, -one, -float(lo_out), region, budget)
        return UNSAT if below is False or above is False else SAT if below and above else TIMEOUT
    pairs, parts, used = goals(net, lo_out, hi_out, target), [(lo.astype(float), hi.astype(float))], 0
    first = hi - lo
    while parts:
        a, z = parts.pop()
        used += 1
        if region.apart(a, z):
            continue
        bounds = [(max(region.least(*linear_form(net, a, z, g), a, z), plain_bound(net, a, z, g)), t) for g, t in pairs]
        if any(v > t + SLACK * (1 + abs(v)) for v, t in bounds):
            continue
        mid = (a + z) / 2
        if region.holds(mid) and net.forward(mid[None, :])[0].argmax() == target:
            return SAT
        if used >= budget:
            return TIMEOUT
        k = int(np.argmax((z - a) / np.where(first > 0, first, 1.0)))
        if z[k] <= a[k]:
            return SAT
        left, right = z.copy(), a.copy()
        left[k] = right[k] = mid[k]
        parts += [(a, left), (right, z)]
    return UNSAT


def is_flat(net: Mlp) -> bool:
    """Whether `flat_ranges` knows the network: a regressor of two inputs and one hidden layer."""
    return not net.classes and len(net.layers) == 2 and net.layers[0][0].shape[1] == 2


def flat_ranges(net: Mlp, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact ranges of a flat network over boxes (rows of lo and hi), without slack.

    The extremes of a piecewise linear function lie at corners of the box, where a hinge meets a side, or where two hinges
    meet. Products are summed in the order of Mlp.outputs_sql, so that a bound rounds as a row's prediction does.
    """
    (w, b), (v, c) = net.layers
    sides = lambda k: (lo[:, k], hi[:, k])
    spots = [(x, y) for x in sides(0) for y in sides(1)]
    for p, q, r in zip(*w.T.tolist(), b.tolist(), strict=True):
        spots += [(-(q * y + r) / p, y) for y in sides(1) if p]
        spots += [(x, -(p * x + r) / q) for x in sides(0) if q]
    for i in range(len(b)):
        for j in range(i + 1, len(b)):
            if w[i, 0] * w[j, 1] != w[i, 1] * w[j, 0]:
                at = np.linalg.solve(w[[i, j]], -b[[i, j]])
                spots.append((np.full(len(lo), at[0]), np.full(len(lo), at[1])))

    def linear(factors, inputs, bias):
        terms = [k * x for k, x in zip(factors.tolist(), inputs, strict=True) if k]
        return sum(terms[1:], terms[0]) + bias if terms else np.full(len(lo), bias)

    low, high = np.full(len(lo), np.inf), np.full(len(lo), -np.inf)
    for x, y in spots:
        inside = (x >= lo[:, 0] - 1e-12) & (x <= hi[:, 0] + 1e-12) & (y >= lo[:, 1] - 1e-12) & (y <= hi[:, 1] + 1e-12)
        value = linear(v[0], [np.maximum(0.0, linear(k, (x, y), float(r))) for k, r in zip(w, b, strict=True)], float(c[0]))
        low, high = np.where(inside, np.minimum(low, value), low), np.where(inside, np.maximum(high, value), high)
    return low, high


def verdicts(meta: DataFrame, net: Mlp, names: list[str], lo=None, hi=None, target=None, exact: bool = True, budget: int = 400) -> DataFrame:
    """meta(block_id, <name>_lo, <name>_hi[, hull of the first two]) -> block_id, status, should_skip.

    Exact, and a flat network: the boxes' ranges decide, without slack or budget; a hull is searched if its box stays. Not exact:
    one linear relaxation over the whole region decides.
    """
    hulls = "hull" in meta.columns
    flat = exact and is_flat(net)

    def run(batches):
        from skipjack.operators.blocks import half_spaces

        for pdf in batches:
            ends = [pdf[[f"{n}_{s}" for n in names]].to_numpy(float) for s in ("lo", "hi")]
            known = np.isfinite(ends[0]).all(axis=1) & np.isfinite(ends[1]).all(axis=1)
            gone = np.zeros(len(pdf), bool)
            if flat:
                with np.errstate(invalid="ignore", over="ignore"):
                    low, high = flat_ranges(net, *ends)
                gone = known & ((low > hi) | (high < lo))
            if flat and not hulls:
                yield pd.DataFrame({"block_id": pdf.block_id, "status": np.where(gone, UNSAT, np.where(known, SAT, ERROR)), "should_skip": gone})
                continue
            status = []
            for k, r in enumerate(pdf.itertuples(index=False)):
                corners = np.array([[p["x"], p["y"]] for p in r.hull]).reshape(-1, 2) if hulls and r.hull is not None else None
                planes = () if corners is None else half_spaces(corners)
                status.append(UNSAT if gone[k] else exact_status(net, ends[0][k], ends[1][k], lo, hi, target, planes, budget=budget if exact else 1, corners=corners if planes else None))
            yield pd.DataFrame({"block_id": pdf.block_id, "status": status, "should_skip": [s == UNSAT for s in status]})

    return meta.mapInPandas(run, "block_id long, status string, should_skip boolean")


def interval_verdicts(meta: DataFrame, net: Mlp, names: list[str], lo=None, hi=None, target=None) -> DataFrame:
    """block_id, should_skip by interval bounds: Columns for narrow nets, Arrow batches for wide ones (their text does not compile)."""
    if len(net.layers) > 1 and net.width > COLUMN_WIDTH:
        n = len(names)

        def judge(*ends: pd.Series) -> pd.Series:
            a, z = (np.column_stack([c.to_numpy(float) for c in part]) for part in (ends[:n], ends[n:]))
            low, high = interval_bounds(net, a, z)
            low, high = low - SLACK * (1 + np.abs(low)), high + SLACK * (1 + np.abs(high))
            if net.classes:
                rest = np.delete(low, target, axis=1)
                return pd.Series((rest > high[:, [target]]).any(axis=1))
            return pd.Series((low[:, 0] > hi) | (high[:, 0] < lo))

        skip = F.pandas_udf(judge, "boolean")(*[F.col(f"{x}_{s}").cast("double") for s in ("lo", "hi") for x in names])
        return meta.select("block_id", F.coalesce(skip, F.lit(False)).alias("should_skip"))
    out = interval_columns(net, [F.col(f"{n}_lo") for n in names], [F.col(f"{n}_hi") for n in names])
    slack = lambda c: F.lit(SLACK) * (F.lit(1.0) + F.abs(c))
    if net.classes:
        t, skip = out[target], F.lit(False)
        for j, o in enumerate(out):
            if j != target:
                skip = skip | (o[0] - slack(o[0]) > t[1] + slack(t[1]))
    else:
        skip = (out[0][0] - slack(out[0][0]) > F.lit(float(hi))) | (out[0][1] + slack(out[0][1]) < F.lit(float(lo)))
    return meta.select("block_id", F.coalesce(skip, F.lit(False)).alias("should_skip"))


def grid_verdicts(cells: DataFrame, box: DataFrame, net: Mlp, names: list[str], pair: tuple[str, str], depth: int, lo=None, hi=None, target=None) -> DataFrame:
    """A block goes if every occupied rectangle of the pair goes; the other features keep their bounds."""
    from skipjack.operators.blocks import cell_rectangle

    x, y = pair
    rect = cell_rectangle(F.col("cell"), F.col(f"{x}_lo"), F.col(f"{x}_hi"), F.col(f"{y}_lo"), F.col(f"{y}_hi"), depth)
    # One row per cell: its own key stands for the block's.
    whole = cells.join(box, "block_id")
    cut = whole.select(F.struct("block_id", "cell").alias("block_id"), *[c.alias(f"{n}_{s}") for n, s, c in zip((x, x, y, y), ("lo", "hi", "lo", "hi"), rect, strict=True)], *[f"{n}_{s}" for n in names if n not in pair for s in ("lo", "hi")])
    found = interval_verdicts(cut, net, names, lo, hi, target)
    return found.select(F.col("block_id.block_id").alias("block_id"), "should_skip").groupBy("block_id").agg(F.bool_and("should_skip").alias("should_skip"))


def range_status(meta: DataFrame, net: Mlp, names: list[str], lo=None, hi=None, target=None) -> DataFrame:
    found = interval_verdicts(meta, net, names, lo, hi, target)
    return found.select("block_id", F.when(F.col("should_skip"), UNSAT).otherwise(TIMEOUT).alias("status"), "should_skip")


#: Verifiers by name: (meta, net, names, lo, hi, target) -> block_id, status, should_skip. Only a proof skips.
VERIFIERS = {
    "interval": range_status,
    "linear": lambda *a, **k: verdicts(*a, exact=False, **k),
    "exact": verdicts,
}


def verify(kind: str, meta: DataFrame, net: Mlp, names: list[str], lo=None, hi=None, target=None) -> DataFrame:
    """The named verifier's verdicts; block_id, status text, should_skip."""
    if kind not in VERIFIERS:
        raise ValueError(f"unknown verifier {kind}; known: {', '.join(VERIFIERS)}")
    found = VERIFIERS[kind](meta, net, names, lo=lo, hi=hi, target=target)
    return found.select("block_id", status_text(F.col("status")).alias("status"), "should_skip")
