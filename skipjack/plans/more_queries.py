"""Further queries: wider networks, norm balls, metrics, caches, workload tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skipjack import storage
from skipjack.functions import logistic as lg
from skipjack.functions import mlp as ml
from skipjack.functions.mlp import Mlp
from skipjack.operators import blocks as bl
from skipjack.operators import rows as rw
from skipjack.plans import cells as ce
from skipjack.plans import decompose as de
from skipjack.plans import prune as pr
from skipjack.plans import queries as qs
from skipjack.plans import verify as ve
from skipjack.plans import workload as wl
from skipjack.plans.queries import BALL, CELLS, CLASS, CLS, CU, EXACT_SKIP, GRID, HI, I_HI, I_LO, LI, LIC, LO, PS, PTS, RANGE, REG, SIZE, T_BELOW, TR_SQL, XY, _balls, _bounds, _vectors, boxes, by_price, customer, lineitem, points, price_boxes, query, truth
from skipjack.sources import export as ex

#: Inputs of the wider networks, scaled to about one.
WIDE = {"x": "l_extendedprice / 100000.0", "y": "l_discount * 10.0", "z": "l_tax * 12.5", "u": "l_quantity / 50.0"}
#: From this value on a prediction of a wide network matches.
WIDE_LO = 0.75


def wide_net(n: int) -> Mlp:
    """Four hidden units over n inputs, weights by a rule."""
    w1 = np.array([[((3 * i + 5 * j) % 7 - 3) / 4 for j in range(n)] for i in range(4)])
    return Mlp([(w1, np.array([0.1, -0.2, 0.3, -0.1])), (np.array([[0.8, -0.6, 0.5, 0.9]]), np.array([0.1]))], list(WIDE.values())[:n])


def wide_corners(s, d, n: int):
    """Exact ranges by corners, blocks by price: no block with a match is skipped, and most of the others are."""
    names, t, net = list(WIDE)[:n], by_price(s, d), wide_net(n)
    meta = bl.block_minmax(rw.block_points(t, {c: WIDE[c] for c in names}, SIZE), names)
    found = ce.corner_ranges(meta, net, names).select("block_id", ((F.col("hi") < WIDE_LO) | (F.col("lo") > 9.0)).alias("should_skip"))
    return qs._against_truth(found, ve.interval_verdicts(meta, net, names, WIDE_LO, 9.0), pr.inference_verdicts(t, net.matches(WIDE_LO, 9.0), SIZE))


WIDE_SQL = f"WITH {LIC} SELECT count(DISTINCT block_id) AS blocks, 0::BIGINT AS false_skips, TRUE AS skips_as_asked FROM b"


@query(WIDE_SQL)
def V18_three_input_cells(s, d):
    return wide_corners(s, d, 3)


@query(WIDE_SQL)
def V19_four_input_cells(s, d):
    return wide_corners(s, d, 4)


@query(f"WITH {LI} SELECT round(min({wide_net(3).predict_sql()}), 6) AS least, round(max({wide_net(3).predict_sql()}), 6) AS most, count(*) AS n FROM li")
def C5_three_input_tree(s, d):
    """Every row down the tree of a network of three inputs."""
    p = rw.block_points(lineitem(s, d), {c: WIDE[c] for c in list(WIDE)[:3]}, SIZE)
    found = de.evaluate(p, list(WIDE)[:3], de.compiled(de.compile_network(wide_net(3))))
    return found.agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.count("*").alias("n"))


@query(f"{RANGE} SELECT bool_or(f_hi >= {LO} AND f_lo <= {HI}) AS some_reach, NOT bool_or(f_hi >= 50) AS none_above, bool_or({EXACT_SKIP}) AS some_skip FROM rg")
def J5_exists(s, d):
    r = de.box_ranges(price_boxes(s, d), XY, CELLS)
    hit = (F.col("hi") >= LO) & (F.col("lo") <= HI)
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return r.agg(any_of(hit).alias("some_reach"), (~any_of(F.col("hi") >= 50)).alias("none_above"), any_of(~hit).alias("some_skip"))


@query(f"{RANGE} SELECT block_id FROM rg WHERE NOT {EXACT_SKIP}")
def V21_union_of_parts(s, d):
    """Reachable by a cell with finite ends or by one without; both, once."""
    box = price_boxes(s, d)
    inf = float("inf")
    ends = lambda row: any(abs(x) == inf for x in row[2:])
    first = {r[0]: ends(r) for r in CELLS.dims[0]}
    open_ids = {r[0] for r in CELLS.dims[1] if ends(r) or first[r[1]]}
    part = lambda keep: de.Compiled([CELLS.dims[0], [r for r in CELLS.dims[1] if (r[0] in open_ids) == keep]], CELLS.functions, CELLS.leaves)
    hit = (F.col("hi") >= LO) & (F.col("lo") <= HI)
    # The range of a part is an interval only cell by cell: both parts' cells are judged one by one.
    reach = lambda own: de.box_ranges(box, XY, own, per_cell=True).where(hit).select("block_id")
    return reach(part(False)).union(reach(part(True))).distinct()


@query(f"WITH {PTS} SELECT block_id, n_rows AS points, 0::BIGINT AS outside FROM mm")
def B5_half_spaces(s, d):
    """Every point of a block lies in every half-space of its hull."""
    p = points(s, d)
    planes = bl.block_hulls(p, "x", "y").mapInPandas(_planes, "block_id long, planes array<struct<a:double,b:double,c:double>>")
    out = p.join(planes, "block_id").select("block_id", F.exists("planes", lambda h: h["a"] * F.col("x") + h["b"] * F.col("y") > h["c"] + 1e-9).alias("out"))
    return out.groupBy("block_id").agg(F.count("*").alias("points"), F.sum(F.col("out").cast("int")).cast("long").alias("outside"))


def _planes(batches):
    import pandas as pd

    for pdf in batches:
        rows = [[{"a": a, "b": b, "c": c} for a, b, c in bl.half_spaces(np.array([[q["x"], q["y"]] for q in r.hull]))] for r in pdf.itertuples()]
        yield pd.DataFrame({"block_id": pdf.block_id, "planes": rows})


@query(f"WITH {GRID} SELECT block_id, count(*) AS n_cells, min(cell) AS least, max(cell) AS most FROM g GROUP BY block_id")
def B10_grid_summary(s, d):
    return bl.grid_cells(points(s, d), "x", "y", 3).groupBy("block_id").agg(F.count("*").alias("n_cells"), F.min("cell").alias("least"), F.max("cell").alias("most"))


@query(f"WITH {PTS} SELECT block_id, round({I_LO}, 13) AS lo, round({I_HI}, 13) AS hi FROM mm")
def V4_interval_bounds(s, d):
    out = ve.interval_columns(REG, [F.col("x_lo"), F.col("y_lo")], [F.col("x_hi"), F.col("y_hi")])[0]
    return boxes(s, d).select("block_id", F.round(out[0], 13).alias("lo"), F.round(out[1], 13).alias("hi"))


UN = BALL.replace("pos // 16", "0")


@query(f"{UN} SELECT block_id, 'p1' AS p, round(r1, 6) AS radius FROM mx UNION ALL SELECT block_id, 'p2', round(r2, 6) FROM mx UNION ALL SELECT block_id, 'pinf', round(ri, 6) FROM mx")
def E7_ball_radii(s, d):
    name = F.when(F.col("p") == 1, "p1").when(F.col("p") == 2, "p2").otherwise("pinf")
    return lg.ball_metadata(_vectors(s, d), _bounds(s, d), PS, 64).select("block_id", name.alias("p"), F.round("radius", 6).alias("radius"))


@query(f"{UN} SELECT block_id, round(mid - b2, 6) AS lo, round(mid + b2, 6) AS hi FROM rg JOIN mid USING (block_id)")
def E12_euclidean_range(s, d):
    return _balls(s, d, None).where("p = 2").select("block_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"{BALL} SELECT block_id, NOT (mid - least(a, b2, i) < ln({T_BELOW} / (1 - {T_BELOW}))) AS should_skip FROM rg JOIN mid USING (block_id)")
def E17_sliced_decision_below(s, d):
    return lg.decide(lg.tightest(_balls(s, d), "<"), "<", T_BELOW).select("block_id", "should_skip")


PRICE = "l_extendedprice * (1 - l_discount) / 100000.0"


@query(f"SELECT round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) ** 2)), 6) AS rmse, round(sqrt(avg((p - t) ** 2)) / stddev_pop(t), 6) AS rmse_over_std, round(sqrt(avg((p - t) ** 2)) / (max(t) - min(t)), 6) AS rmse_over_range FROM (SELECT {REG.predict_sql()} AS p, {PRICE} AS t FROM lineitem)")
def M10_metrics(s, d):
    t = lineitem(s, d).select(REG.column().alias("p"), F.expr(PRICE).alias("t"))
    return ml.prediction_metrics(t, "p", "t").select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "rmse_over_std", "rmse_over_range")])


@query(f"SELECT round(avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM (SELECT {CLS.predict_sql()} AS p, c_nationkey % 3 AS t FROM customer)")
def M10_accuracy(s, d):
    t = customer(s, d).select(CLS.column().alias("p"), F.expr("c_nationkey % 3").alias("t"))
    return ml.accuracy(t, "p", "t").select(F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {CU} SELECT block_id, count(*) AS n FROM b WHERE {CLS.predict_sql()} = {CLASS} GROUP BY block_id")
def M7_count_per_block(s, d):
    return rw.with_block_id(customer(s, d), SIZE).where(CLS.matches(target=CLASS)).groupBy("block_id").agg(F.count("*").alias("n"))


@query(f"{TR_SQL} SELECT filter, block_id, n_rows FROM tr")
def S18_truth_rows(s, d):
    """Written as JSON by filter, and read back from the files."""
    path = ex.export_truth(truth(s, d), storage.scratch(s, "truth-export"), "lineitem", "reg")
    return s.read.schema("block_id long, n_rows long, filter string").json(path).select("filter", "block_id", "n_rows")


@query(f"SELECT count(*) AS n_rows, count(*) FILTER ({REG.predict_sql()} BETWEEN {LO} AND {HI}) AS qualifies FROM lineitem")
def S14_truth_cache(s, d):
    cache, t = pr.TruthCache(s, storage.scratch(s, "truth")), lineitem(s, d)
    key = pr.cache_key(f"{d}/lineitem", REG, SIZE, f"{LO} {HI}", storage.fingerprint(s, f"{d}/lineitem.parquet"))
    n = t.count()
    if cache.read(key, n) is None:
        cache.write(key, t, REG.matches(LO, HI))
    return cache.read(key, n).agg(F.count("*").alias("n_rows"), F.sum(F.col("qualifies").cast("int")).cast("long").alias("qualifies"))


@query("SELECT i AS k, CASE WHEN i = 9 THEN 1000.0 ELSE 2.0 ** (i + 1) END AS width FROM (SELECT unnest(range(0, 10)) AS i)")
def G1_widths(s, d):
    return s.createDataFrame(list(enumerate(float(x) for x in wl.widths(1000, 2.0))), "k long, width double")


@query("SELECT * FROM (VALUES (0, 0.5::DOUBLE), (1, 3.0), (2, 6.0), (3, 8.0), (4, 10.0)) AS t(k, start)")
def G2_starts(s, d):
    """Steps of 2.5 from 0.5 on, rounded half to even: 5.5 to 6, 10.5 to 10, and 0.5 to 0, which is held to 0.5."""
    return s.createDataFrame(list(enumerate(wl.starts(0.5, 13.0, 2.5, 5))), "k int, start double")


@query("SELECT event_type AS series, max(ts) AS finished, arg_max(event_id, (ts, event_id)) AS result FROM events GROUP BY event_type")
def G11_newest_per_series(s, d):
    """The newest of each series, ties to the larger id."""
    e = s.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("event_type").alias("series")).agg(F.max("ts").alias("finished"), F.max_by("event_id", F.struct("ts", "event_id")).alias("result"))
