"""The engine's queries over the star schema, each beside its DuckDB form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipjack.functions import logistic as lg
from skipjack.functions.mlp import Mlp, train
from skipjack.operators import blocks as bl
from skipjack.operators import layout as la
from skipjack.operators import metadata as md
from skipjack.operators import rows as rw
from skipjack.plans import decompose as de
from skipjack.plans import prune as pr
from skipjack.plans import verify as ve
from skipjack.plans import workload as wl

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIZE, DEPTH = 100, 3
FEATURES = {"x": "l_extendedprice / 100000.0", "y": "l_discount * 10.0"}
XY = ["x", "y"]
#: Hand-made networks, small enough to be written into SQL.
REG = Mlp([(np.array([[1.0, -0.5], [-0.75, 0.5], [0.5, 1.0], [1.25, -1.0]]), np.array([-0.2, 0.3, -0.6, 0.1])), (np.array([[0.9, -0.4, 0.3, 0.7]]), np.array([0.05]))], list(FEATURES.values()))
CLS = Mlp([(np.array([[1.0, 0.5], [-1.0, 0.75], [0.5, -1.0]]), np.array([-0.25, 0.4, 0.1])), (np.array([[1.0, -0.5, 0.2], [-0.3, 0.9, 0.1], [0.1, 0.2, 0.8]]), np.array([0.0, -0.1, 0.05]))], ["c_acctbal / 10000.0", "c_nationkey / 25.0"], classes=3)
LO, HI, CLASS = 1.0, 1.2, 1
W64 = [((i * 37) % 19 - 9) / 10 for i in range(64)]
#: Thresholds that some of the blocks' bounds reach and others do not.
BIAS, T, T_BELOW, T_INTERVAL = 0.1, 0.9915, 0.00376, 0.9995

LI = "li AS (SELECT *, row_number() OVER () - 1 AS row_id FROM lineitem), b AS (SELECT *, CAST(floor(row_id / 100.0) AS BIGINT) AS block_id FROM li)"
CU = "cu AS (SELECT *, row_number() OVER () - 1 AS row_id FROM customer), b AS (SELECT *, CAST(floor(row_id / 100.0) AS BIGINT) AS block_id FROM cu)"
PTS = f"{LI}, p AS (SELECT row_id, block_id, {FEATURES['x']} AS x, {FEATURES['y']} AS y FROM b), mm AS (SELECT block_id, count(*) AS n_rows, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM p GROUP BY block_id)"


#: The same in order of price (ties by place), as the verdict queries take it.
LIC = "l0 AS (SELECT *, row_number() OVER () - 1 AS source_row FROM lineitem), li AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice, source_row) - 1 AS row_id FROM l0), b AS (SELECT *, CAST(floor(row_id / 100.0) AS BIGINT) AS block_id FROM li)"
CUC = "c0 AS (SELECT *, row_number() OVER () - 1 AS source_row FROM customer), cu AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, source_row) - 1 AS row_id FROM c0), b AS (SELECT *, CAST(floor(row_id / 100.0) AS BIGINT) AS block_id FROM cu)"
PTC = PTS.replace(LI, LIC)


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rw.read_table(spark, f"{sf}/lineitem.parquet")


def customer(spark: SparkSession, sf: str) -> DataFrame:
    return rw.read_table(spark, f"{sf}/customer.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return rw.block_points(lineitem(spark, sf), FEATURES, SIZE)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return bl.block_minmax(points(spark, sf), XY)


def by_price(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem in order of price, laid out by block."""
    return la.kept_layout(spark, f"{sf}/lineitem.parquet", SIZE, ["l_extendedprice"])


def in_place(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem in its own order, laid out by block."""
    return la.kept_layout(spark, f"{sf}/lineitem.parquet", SIZE, [])


def price_points(spark: SparkSession, sf: str) -> DataFrame:
    return rw.block_points(by_price(spark, sf), FEATURES, SIZE)


def price_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return bl.block_minmax(price_points(spark, sf), XY)


def range_sql(net: Mlp, names: list[str]) -> str:
    """CTE rg(block_id, f_lo, f_hi) over mm: the exact range of a two-input network with one hidden layer over each box.

    The extremes of a piecewise linear function lie at corners of the box, where a hinge meets a side, or where two hinges meet.
    """
    x, y = names
    planes = [(*w, b) for w, b in zip(net.layers[0][0].tolist(), net.layers[0][1].tolist(), strict=True)]
    spots = [(f"{x}_{s}", f"{y}_{e}") for s in ("lo", "hi") for e in ("lo", "hi")]
    for a, b, c in planes:
        spots += [(f"(-({b!r} * {y}_{e} + {c!r}) / {a!r})", f"{y}_{e}") for e in ("lo", "hi") if a]
        spots += [(f"{x}_{e}", f"(-({a!r} * {x}_{e} + {c!r}) / {b!r})") for e in ("lo", "hi") if b]
    for i, p in enumerate(planes):
        for q in planes[i + 1 :]:
            if p[0] * q[1] != p[1] * q[0]:
                at = np.linalg.solve([p[:2], q[:2]], [-p[2], -q[2]])
                spots.append((f"{at[0]!r}", f"{at[1]!r}".replace("np.float64", "")))
    spots = [(str(u).replace("np.float64", ""), str(v)) for u, v in spots]
    union = " UNION ALL ".join(f"SELECT block_id, {u}::DOUBLE AS px, {v}::DOUBLE AS py, {x}_lo, {x}_hi, {y}_lo, {y}_hi FROM mm" for u, v in spots)
    value = Mlp(net.layers, ["px", "py"]).predict_sql()
    return f"cand AS ({union}), rg AS (SELECT block_id, min({value}) AS f_lo, max({value}) AS f_hi FROM cand WHERE px BETWEEN {x}_lo - 1e-12 AND {x}_hi + 1e-12 AND py BETWEEN {y}_lo - 1e-12 AND {y}_hi + 1e-12 GROUP BY block_id)"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


@query(f"WITH {LI} SELECT row_id, l_orderkey, l_linenumber FROM li")
def S3_row_ids(s, d):
    return lineitem(s, d).select("row_id", "l_orderkey", "l_linenumber")


@query(f"WITH {LI} SELECT min(row_id) = 0 AND max(row_id) = count(*) - 1 AS dense, count(*) AS n FROM li")
def S6_row_id_check(s, d):
    return lineitem(s, d).agg(((F.min("row_id") == 0) & (F.max("row_id") == F.count("*") - 1)).alias("dense"), F.count("*").alias("n"))


@query(f"WITH {LI} SELECT row_id, {FEATURES['x']} AS x, {FEATURES['y']} AS y, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS target FROM li ORDER BY row_id LIMIT 500")
def P1_training_set(s, d):
    return rw.training_set(lineitem(s, d), FEATURES, "l_extendedprice * (1 - l_discount)", 500)


@query(f"WITH {LI} SELECT row_id, {FEATURES['x']} AS x, {FEATURES['y']} AS y, CAST(l_quantity AS DOUBLE) AS target FROM b WHERE block_id IN (2, 5) ORDER BY block_id, row_id LIMIT 150")
def P2_training_set_blocks(s, d):
    return rw.training_set(lineitem(s, d), FEATURES, "l_quantity", 150, blocks=[2, 5], size=SIZE)


@query("SELECT count(*) AS n FROM customer WHERE isfinite(c_acctbal) AND c_nationkey BETWEEN 0 AND 19")
def P3_valid_rows(s, d):
    return customer(s, d).where(rw.valid(["c_acctbal"], "c_nationkey", 20)).agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT row_id, block_id FROM b")
def P4_block_id(s, d):
    return rw.with_block_id(lineitem(s, d), SIZE).select("row_id", "block_id")


@query(f"WITH {LI} SELECT row_id, l_quantity FROM b WHERE block_id = 7")
def P5_single_block(s, d):
    return la.read_blocks(in_place(s, d), [7]).select("row_id", "l_quantity")


@query(f"WITH {LI} SELECT row_id, l_quantity FROM b WHERE block_id IN (1, 4, 9)")
def P6_block_set(s, d):
    return la.read_blocks(in_place(s, d), [1, 4, 9]).select("row_id", "l_quantity")


@query("SELECT row_id FROM (SELECT 0 AS row_id) WHERE FALSE")
def P6_empty_block_set(s, d):
    return la.read_blocks(in_place(s, d), []).select("row_id")


@query('SELECT l_orderkey AS "a ""quoted"" name" FROM lineitem WHERE l_linenumber = 1')
def P7_quoted_name(s, d):
    named = lineitem(s, d).where("l_linenumber = 1").withColumnRenamed("l_orderkey", 'a "quoted" name')
    return named.selectExpr(rw.quoted('a "quoted" name'))


@query(f"WITH {PTS} SELECT row_id, x, y FROM p WHERE block_id = 3 ORDER BY row_id")
def P8_block_features(s, d):
    return points(s, d).where("block_id = 3").orderBy("row_id").select("row_id", "x", "y")


@query(f"WITH {PTS} SELECT block_id, row_id, x, y FROM p WHERE block_id IN (3, 8)")
def P9_features_of_blocks(s, d):
    return points(s, d).where(F.col("block_id").isin(3, 8)).select("block_id", "row_id", "x", "y")


@query(f"WITH {PTS} SELECT row_id, block_id, x, y FROM p WHERE isfinite(x) AND isfinite(y)")
def P10_block_points(s, d):
    return points(s, d)


@query(f"SELECT count(*) AS n FROM lineitem WHERE {REG.predict_sql()} BETWEEN {LO} AND {HI}")
def P11_regressor_predicate(s, d):
    return lineitem(s, d).where(REG.matches(LO, HI)).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM customer WHERE {CLS.predict_sql()} = {CLASS}")
def P12_classifier_predicate(s, d):
    return customer(s, d).where(CLS.matches(target=CLASS)).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM lineitem WHERE {wl.FilterSpec('f', 'lineitem', 'm', LO, HI).sql(REG.predict_sql())}")
def P13_predicate_text(s, d):
    return lineitem(s, d).where(wl.FilterSpec("f", "lineitem", "m", LO, HI).sql(REG.predict_sql())).agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT count(*) AS n FROM b WHERE block_id < 13")
def P14_row_budget(s, d):
    return rw.with_block_id(lineitem(s, d), SIZE).where(F.col("block_id") < rw.blocks_for_budget(1250, SIZE)).agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT block_id, count(*) AS n FROM b WHERE block_id >= 20 GROUP BY block_id")
def P15_without_training_prefix(s, d):
    return rw.with_block_id(lineitem(s, d), SIZE).where(F.col("block_id") >= rw.blocks_for_budget(2000, SIZE)).groupBy("block_id").agg(F.count("*").alias("n"))


#: The network as linear cells down to the axes' infinite ends.
CELLS = de.compiled(de.compile_network(REG))
RANGE = f"WITH {PTC}, {range_sql(REG, XY)}"
POINT_VALUES = f"SELECT row_id, round({REG.predict_sql()}, 12) AS value FROM li"


@query(f"WITH {LI} {POINT_VALUES}")
def J1_cell_tree(s, d):
    """Every row down the cell tree: a range join to the first dimension, an equi join to the cells above it."""
    return de.evaluate(points(s, d), XY, CELLS).select("row_id", F.round("value", 12).alias("value"))


@query(f"WITH {LI}, v AS ({POINT_VALUES}) SELECT count(*) AS n, round(sum(value), 3) AS total FROM v")
def J2_component_lookup(s, d):
    found = de.evaluate(points(s, d), XY, CELLS)
    _, functions, _ = de.tables(s, CELLS)
    # Both sides belong to one model: as many rows as it has functions.
    again = found.join(F.broadcast(functions), "function_id").select((F.col("w0") * F.col("x") + F.col("w1") * F.col("y") + F.col("w2")).alias("v"))
    return again.agg(F.count("*").alias("n"), F.round(F.sum(F.round("v", 6)), 3).alias("total"))


#: Two hidden layers.
DEEP = Mlp([(np.array([[1.0, -0.5], [-0.75, 0.5], [0.5, 1.0]]), np.array([-0.2, 0.3, -0.6])), (np.array([[0.7, -0.4, 0.9], [-0.6, 0.8, 0.5]]), np.array([0.1, -0.2])), (np.array([[0.9, -0.7]]), np.array([0.05]))], list(FEATURES.values()))


@query(f"WITH {LI} SELECT row_id, round({DEEP.predict_sql()}, 13) AS value FROM li")
def C18_deep_network_cells(s, d):
    return de.evaluate(points(s, d), XY, de.compiled(de.compile_network(DEEP))).select("row_id", F.round("value", 13).alias("value"))


@query(f"{RANGE} SELECT block_id, count(*) > 0 AS met, min(f_lo) <= max(f_hi) AS ordered FROM rg GROUP BY block_id")
def J3_overlapping_cells(s, d):
    met = de.box_leaves(price_boxes(s, d), XY, CELLS).groupBy("block_id").agg(F.count("*").alias("n"))
    joined = de.box_ranges(price_boxes(s, d), XY, CELLS).join(met, "block_id")
    return joined.select("block_id", (F.col("n") > 0).alias("met"), (F.col("lo") <= F.col("hi")).alias("ordered"))


@query(f"{RANGE} SELECT block_id, round(f_lo, 12) AS lo, round(f_hi, 12) AS hi FROM rg", "V17_exact_ranges")
def V17_exact_ranges(s, d):
    return de.box_ranges(price_boxes(s, d), XY, CELLS).select("block_id", F.round("lo", 12).alias("lo"), F.round("hi", 12).alias("hi"))


def reachable(s, d) -> DataFrame:
    """Blocks on the left, so a block that meets no cell is there too (and is not reachable)."""
    box = price_boxes(s, d)
    hit = (F.col("hi") >= LO) & (F.col("lo") <= HI)
    return box.select("block_id").join(de.box_ranges(box, XY, CELLS), "block_id", "left").select("block_id", F.coalesce(hit, F.lit(False)).alias("reachable"))


@query(f"{RANGE} SELECT block_id, f_hi >= {LO} AND f_lo <= {HI} AS reachable FROM rg", "V15_cell_reachability")
def V15_cell_reachability(s, d):
    return reachable(s, d)


@query(f"{RANGE} SELECT block_id, f_lo >= 0.0 AND f_hi <= 1.0 AS inside FROM rg")
def V20_inside_range(s, d):
    r = de.box_ranges(price_boxes(s, d), XY, CELLS)
    return r.select("block_id", ((F.col("lo") >= 0.0) & (F.col("hi") <= 1.0)).alias("inside"))


@query(f"WITH {LI} SELECT count(*) AS n FROM b WHERE block_id IN (SELECT DISTINCT block_id FROM b WHERE l_extendedprice > 104000)")
def J6_semi_join(s, d):
    t = in_place(s, d)
    kept = t.where("l_extendedprice > 104000").select("block_id").distinct()
    return la.read_blocks(t, kept).agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT * FROM mm")
def A1_block_minmax(s, d):
    return boxes(s, d)


@query(f"WITH {PTS} SELECT * FROM mm WHERE block_id = 5")
def A2_one_block_minmax(s, d):
    return bl.block_minmax(points(s, d).where("block_id = 5"), XY)


@query(f"WITH {LI} SELECT count(*) AS n FROM b WHERE block_id = 5 AND l_quantity > 25")
def A3_matching_rows_of_block(s, d):
    return la.read_blocks(in_place(s, d), [5]).where("l_quantity > 25").agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT count(*) AS n FROM b WHERE l_quantity > 25")
def A4_count_in_blocks(s, d):
    """No set of blocks is given here: all of them."""
    return lineitem(s, d).where("l_quantity > 25").agg(F.count("*").alias("n"))


A5_SQL = "SELECT count(*) AS n FROM b JOIN mm USING (block_id) WHERE NOT {T1} AND l_quantity > 25"


@query()
def A5_count_on_kept_blocks(s, d):
    """Rows of the blocks that the interval verdicts keep."""
    t = by_price(s, d)
    return la.read_blocks(t, V6_interval_verdicts(s, d).where("NOT should_skip")).where("l_quantity > 25").agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT count(DISTINCT block_id) AS n FROM b WHERE l_extendedprice > 104000")
def A6_matching_blocks(s, d):
    return rw.with_block_id(lineitem(s, d), SIZE).where("l_extendedprice > 104000").agg(F.countDistinct("block_id").alias("n"))


TARGET = "l_extendedprice * (1 - l_discount)"


@query(f"SELECT min({TARGET}) AS lo, max({TARGET}) AS hi FROM lineitem")
def A7_expression_range(s, d):
    e = F.expr(TARGET)
    return lineitem(s, d).agg(F.min(e).alias("lo"), F.max(e).alias("hi"))


@query(f"WITH {LI} SELECT DISTINCT block_id FROM b ORDER BY block_id")
def A8_block_list(s, d):
    return rw.with_block_id(lineitem(s, d), SIZE).select("block_id").distinct().orderBy("block_id")


@query(f"WITH {LI} SELECT count(*) AS n FROM b WHERE block_id IN (3, 4)")
def A9_rows_in_blocks(s, d):
    return la.read_blocks(in_place(s, d), [3, 4]).agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT r.i AS block_id, coalesce(n, 0) AS n_rows FROM (SELECT unnest(range(0, (SELECT max(block_id) + 1 FROM b))) AS i) r LEFT JOIN (SELECT block_id, count(*) AS n FROM b GROUP BY 1) c ON r.i = c.block_id")
def A10_rows_per_block(s, d):
    counts = rw.with_block_id(lineitem(s, d), SIZE).groupBy("block_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("block_id")).first()[0]
    return s.range((-1 if most is None else most) + 1).withColumnRenamed("id", "block_id").join(counts, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


@query("SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_nationkey IS NOT NULL ORDER BY 1")
def A11_target_classes(s, d):
    return customer(s, d).where("c_nationkey is not null").select(F.col("c_nationkey").alias("c")).distinct().orderBy("c")


TRUTH = {"wide": (0.5, 1.2), "narrow": (LO, HI), "none": (90.0, 91.0)}
TR_SQL = f"WITH {LI}, t AS (SELECT block_id, {REG.predict_sql()} AS m FROM b), tr AS (SELECT f AS filter, block_id, CAST(sum(CASE WHEN m BETWEEN lo AND hi THEN 1 ELSE 0 END) AS BIGINT) AS n_rows FROM t, (VALUES " + ", ".join(f"('{k}', {a}, {z})" for k, (a, z) in TRUTH.items()) + ") AS v(f, lo, hi) GROUP BY ALL)"


def truth(s, d):
    return pr.ground_truth(lineitem(s, d), {k: REG.matches(a, z) for k, (a, z) in TRUTH.items()}, SIZE)


@query(f"{TR_SQL} SELECT filter, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (n_rows > 0) AS n_blocks FROM tr GROUP BY filter")
def A15_ground_truth(s, d):
    return pr.truth_summary(truth(s, d))


@query(f"{TR_SQL} SELECT CAST(sum(n_rows) AS BIGINT) AS n FROM tr WHERE filter = 'wide'")
def A12_qualified_rows(s, d):
    return truth(s, d).where("filter = 'wide'").agg(F.sum("n_rows").alias("n"))


@query(f"{TR_SQL} SELECT count(DISTINCT block_id) AS n FROM tr WHERE filter = 'narrow' AND n_rows > 0")
def A13_qualifying_blocks(s, d):
    return truth(s, d).where("filter = 'narrow' AND n_rows > 0").agg(F.countDistinct("block_id").alias("n"))


@query(f"{TR_SQL} SELECT block_id, n_rows FROM tr WHERE filter = 'narrow'")
def A14_qualified_per_block(s, d):
    return truth(s, d).where("filter = 'narrow'").select("block_id", "n_rows")


GRID = f"{PTS}, g AS (SELECT DISTINCT p.block_id, CAST((CASE WHEN y_hi > y_lo THEN least(7, greatest(0, CAST(floor((y - y_lo) / (y_hi - y_lo) * 8) AS INT))) ELSE 0 END) * 8 + (CASE WHEN x_hi > x_lo THEN least(7, greatest(0, CAST(floor((x - x_lo) / (x_hi - x_lo) * 8) AS INT))) ELSE 0 END) AS INT) AS cell FROM p JOIN mm USING (block_id))"


@query(f"WITH {GRID} SELECT block_id, cell FROM g")
def B6_grid_cells(s, d):
    return bl.grid_cells(points(s, d), "x", "y", DEPTH)


@query(f"WITH {GRID} SELECT block_id, cell, round(x_lo + (cell % 8) * (x_hi - x_lo) / 8, 9) AS x0, round(x_lo + (cell % 8 + 1) * (x_hi - x_lo) / 8, 9) AS x1, round(y_lo + (cell // 8) * (y_hi - y_lo) / 8, 9) AS y0, round(y_lo + (cell // 8 + 1) * (y_hi - y_lo) / 8, 9) AS y1 FROM g JOIN mm USING (block_id)")
def B7_cell_rectangles(s, d):
    p = points(s, d)
    rect = bl.cell_rectangle(F.col("cell"), *[F.col(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")], DEPTH)
    return bl.grid_cells(p, "x", "y", DEPTH).join(bl.block_minmax(p, XY), "block_id").select("block_id", "cell", *[F.round(c, 9).alias(n) for c, n in zip(rect, ("x0", "x1", "y0", "y1"), strict=True)])


@query(f"WITH {PTS} SELECT block_id, 0::BIGINT AS foreign_corners, round(x_lo, 9) AS x_lo, round(x_hi, 9) AS x_hi, round(y_lo, 9) AS y_lo, round(y_hi, 9) AS y_hi FROM mm")
def B3_convex_hulls(s, d):
    """Hulls reach as far as the points do, and every corner is a point."""
    p = points(s, d)
    corners = bl.block_hulls(p, "x", "y").select("block_id", F.explode("hull").alias("c")).select("block_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    known = p.select("block_id", "x", "y").distinct().withColumn("point", F.lit(True))
    reach = [F.round(g(c), 9).alias(f"{c}_{e}") for c in XY for g, e in ((F.min, "lo"), (F.max, "hi"))]
    return corners.join(known, ["block_id", "x", "y"], "left").groupBy("block_id").agg(F.sum(F.when(F.col("point"), 0).otherwise(1)).cast("long").alias("foreign_corners"), *reach)


@query(f"WITH {GRID}, r AS (SELECT block_id, x_lo + (cell % 8) * (x_hi - x_lo) / 8 AS x0, x_lo + (cell % 8 + 1) * (x_hi - x_lo) / 8 AS x1, y_lo + (cell // 8) * (y_hi - y_lo) / 8 AS y0, y_lo + (cell // 8 + 1) * (y_hi - y_lo) / 8 AS y1 FROM g JOIN mm USING (block_id)) SELECT block_id, round(min(x0), 9) AS x_lo, round(max(x1), 9) AS x_hi, round(min(y0), 9) AS y_lo, round(max(y1), 9) AS y_hi FROM r GROUP BY block_id")
def B8_bounded_hulls(s, d):
    """Hulls of the occupied cells reach as far as the cells do."""
    corners = bl.bounded_hulls(points(s, d), "x", "y", DEPTH).select("block_id", F.explode("hull").alias("c"))
    return corners.groupBy("block_id").agg(*[F.round(g(f"c.{c}"), 9).alias(f"{c}_{e}") for c in XY for g, e in ((F.min, "lo"), (F.max, "hi"))])


@query("SELECT * FROM (VALUES ('minmax', 32), ('grid', 64), ('convex_hull', 80), ('bounded_convex_hull', 39)) AS t(kind, bytes)")
def B9_storage_bytes(s, d):
    return s.createDataFrame([(k, bl.storage_bytes(k, 2, 5, 4)) for k in ("minmax", "grid", "convex_hull", "bounded_convex_hull")], "kind string, bytes int")


#: Three features, so three pairs.
THREE = {**FEATURES, "z": "l_tax * 12.5"}
PT3 = f"{LI}, p AS (SELECT row_id, block_id, {', '.join(f'{e} AS {n}' for n, e in THREE.items())} FROM b), mm AS (SELECT block_id, count(*) AS n_rows, {', '.join(f'min({n}) AS {n}_lo, max({n}) AS {n}_hi' for n in THREE)} FROM p GROUP BY block_id)"


def _pair_sql() -> str:
    index = lambda f: f"CASE WHEN {f}_hi > {f}_lo THEN least(7, greatest(0, CAST(floor(({f} - {f}_lo) / ({f}_hi - {f}_lo) * 8) AS INT))) ELSE 0 END"
    parts = [f"SELECT DISTINCT p.block_id, '{x}' AS fx, '{y}' AS fy, CAST(({index(y)}) * 8 + ({index(x)}) AS INT) AS cell FROM p JOIN mm USING (block_id)" for x, y in bl.feature_pairs(list(THREE))]
    return " UNION ALL ".join(parts)


@query(f"WITH {PT3}, c AS ({_pair_sql()}) SELECT block_id, fx, fy, count(*) AS n_cells, CAST(sum(cell) AS BIGINT) AS total, 3 AS depth FROM c GROUP BY ALL")
def B2_metadata_of_all_pairs(s, d):
    meta = md.collect(rw.block_points(lineitem(s, d), THREE, SIZE), list(THREE), "grid", DEPTH)
    p = meta.select("block_id", F.explode("pairs").alias("p"))
    total = F.aggregate("p.grid_cells", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("block_id", F.col("p.feature_x").alias("fx"), F.col("p.feature_y").alias("fy"), F.size("p.grid_cells").cast("long").alias("n_cells"), total.alias("total"), F.col("p.grid_depth").alias("depth"))


@query(f"WITH {PT3} SELECT block_id, n_rows, round(x_lo, 9) AS x_lo, round(z_hi, 9) AS z_hi, 0 AS n_pairs FROM mm")
def B1_metadata_of_blocks(s, d):
    meta = md.collect(rw.block_points(lineitem(s, d), THREE, SIZE), list(THREE), "minmax")
    return meta.select("block_id", "n_rows", F.round(F.col("bounds")["x"]["lo"], 9).alias("x_lo"), F.round(F.col("bounds")["z"]["hi"], 9).alias("z_hi"), F.size("pairs").alias("n_pairs"))


@query("SELECT 'grid' AS kind, count(*) AS block_count, 72.0::DOUBLE AS avg_bytes, 72.0::DOUBLE AS median_bytes, 72::BIGINT AS max_bytes FROM (SELECT DISTINCT floor((row_number() OVER () - 1) / 100.0) AS block_id FROM lineitem)")
def A17_metadata_summary(s, d):
    """Three features and three grids of depth 3: 3 * 16 + 3 * 8 bytes a block."""
    meta = md.collect(rw.block_points(lineitem(s, d), THREE, SIZE), list(THREE), "grid", DEPTH)
    return md.size_summary(meta, "grid").select("kind", "block_count", "avg_bytes", "median_bytes", "max_bytes")


WIDTHS = [(0.2, 0.05), (0.4, 0.1), (0.9, 0.02), (1.0, 0.2), (1.2, 0.3), (1.5, 0.1), (1.7, 0.05), (1.79, 0.02), (9.0, 1.0)]


def _interval_sql(net: Mlp) -> tuple[str, str]:
    now = [("x_lo", "x_hi"), ("y_lo", "y_hi")]
    for k, (w, b) in enumerate(net.layers):
        out = []
        for row, bias in zip(w.tolist(), b.tolist(), strict=True):
            low = f"({bias!r}::DOUBLE" + "".join(f" + {c!r}::DOUBLE * {a if c > 0 else z}" for c, (a, z) in zip(row, now, strict=True)) + ")"
            high = f"({bias!r}::DOUBLE" + "".join(f" + {c!r}::DOUBLE * {z if c > 0 else a}" for c, (a, z) in zip(row, now, strict=True)) + ")"
            out.append((f"greatest(0.0, {low})", f"greatest(0.0, {high})") if k < len(net.layers) - 1 else (low, high))
        now = out
    return now[0]


I_LO, I_HI = _interval_sql(REG)
T1 = f"(({I_LO}) - 1e-5 * (1 + abs({I_LO})) > {HI} OR ({I_HI}) + 1e-5 * (1 + abs({I_HI})) < {LO})"


ORACLES["A5_count_on_kept_blocks"] = f"WITH {PTC} {A5_SQL.format(T1=T1)}"
#: Ranges of a workload: start, width.
WORKLOAD = {f"f{k}": (a, a + w) for k, (a, w) in enumerate(WIDTHS)}
WORK_SQL = "(VALUES " + ", ".join(f"('{k}', {a!r}::DOUBLE, {z!r}::DOUBLE)" for k, (a, z) in WORKLOAD.items()) + ") AS w(filter, lo, hi)"
BINS_SQL = "CASE WHEN s = 0 THEN '= 0' WHEN s < 1e-5 THEN '0-1e-05' WHEN s < 1e-4 THEN '1e-05-0.0001' WHEN s < 1e-3 THEN '0.0001-0.001' WHEN s < 1e-2 THEN '0.001-0.01' WHEN s < 0.1 THEN '0.01-0.1' WHEN s < 1 THEN '0.1-1' WHEN s < 10 THEN '1-10' ELSE '10-100' END"
SKIP_W = f"(({I_LO}) - 1e-5 * (1 + abs({I_LO})) > hi OR ({I_HI}) + 1e-5 * (1 + abs({I_HI})) < lo)"


@query(f"WITH {PTC}, t AS (SELECT block_id, {REG.predict_sql()} AS m FROM b), n AS (SELECT filter, block_id, count(*) FILTER (m BETWEEN lo AND hi) AS n, count(*) AS rows FROM t, {WORK_SQL} GROUP BY ALL), v AS (SELECT block_id, filter, {SKIP_W} AS skip FROM mm, {WORK_SQL}), r AS (SELECT filter, 100.0 * sum(n) / sum(rows) AS s, CASE WHEN count(*) FILTER (n = 0) = 0 THEN 100.0 ELSE 100.0 * count(*) FILTER (skip) / count(*) FILTER (n = 0) END AS p FROM n JOIN v USING (filter, block_id) GROUP BY filter) SELECT {BINS_SQL} AS bin, count(*) AS n, round(avg(p), 6) AS mean, round(median(p), 6) AS median FROM r GROUP BY 1")
def A18_selectivity_bins(s, d):
    """Selectivity and pruning of a workload's filters, each as measured."""
    t, box = by_price(s, d), price_boxes(s, d)
    truth_rows = pr.ground_truth(t, {k: REG.matches(a, z) for k, (a, z) in WORKLOAD.items()}, SIZE)
    out = ve.interval_columns(REG, [F.col("x_lo"), F.col("y_lo")], [F.col("x_hi"), F.col("y_hi")])[0]
    slack = lambda c: F.lit(ve.SLACK) * (F.lit(1.0) + F.abs(c))
    bounds = box.select("block_id", "n_rows", (out[0] - slack(out[0])).alias("low"), (out[1] + slack(out[1])).alias("high")).withColumnRenamed("n_rows", "rows")
    filters = s.createDataFrame([(k, a, z) for k, (a, z) in WORKLOAD.items()], "filter string, lo double, hi double")
    # One row per filter on the right.
    each = truth_rows.join(bl.small(bounds), "block_id").join(F.broadcast(filters), "filter")
    n = lambda c: F.sum(c.cast("int"))
    skip = (F.col("low") > F.col("hi")) | (F.col("high") < F.col("lo"))
    result = each.groupBy("filter").agg((100.0 * F.sum("n_rows") / F.sum("rows")).alias("selectivity"), n(skip).alias("skipped"), n(F.col("n_rows") == 0).alias("skippable"))
    return pr.selectivity_bins(result.select("selectivity", pr.effectiveness(F.col("skipped"), F.col("skippable")).cast("double").alias("pruning")))


@query(f"WITH {PTC} SELECT block_id, {T1} AS should_skip FROM mm")
def V6_interval_verdicts(s, d):
    return ve.interval_verdicts(price_boxes(s, d), REG, XY, LO, HI)


@query(f"WITH {GRID.replace(LI, LIC)}, r AS (SELECT block_id, x_lo + (cell % 8) * (x_hi - x_lo) / 8 AS x_lo, x_lo + (cell % 8 + 1) * (x_hi - x_lo) / 8 AS x_hi, y_lo + (cell // 8) * (y_hi - y_lo) / 8 AS y_lo, y_lo + (cell // 8 + 1) * (y_hi - y_lo) / 8 AS y_hi FROM g JOIN mm USING (block_id)) SELECT block_id, bool_and({T1}) AS should_skip FROM r GROUP BY block_id")
def V13_grid_verdicts(s, d):
    p = price_points(s, d)
    return ve.grid_verdicts(bl.grid_cells(p, "x", "y", DEPTH), bl.block_minmax(p, XY), REG, XY, ("x", "y"), DEPTH, LO, HI)


EXACT_SKIP = f"(f_lo > {HI} OR f_hi < {LO})"


@query(f"{RANGE} SELECT block_id, CASE WHEN {EXACT_SKIP} THEN 'unsat' ELSE 'sat' END AS status, {EXACT_SKIP} AS should_skip FROM rg")
def V3_exact_verdicts(s, d):
    return ve.verdicts(price_boxes(s, d), REG, XY, LO, HI)


@query(f"{RANGE} SELECT block_id, CASE WHEN {EXACT_SKIP} THEN 'UNSAT' ELSE 'SAT' END AS status FROM rg")
def V2_status_text(s, d):
    return ve.verify("exact", price_boxes(s, d), REG, XY, LO, HI).select("block_id", "status")


@query(f"{RANGE} SELECT 'interval' AS verifier, count(*) FILTER ({T1}) AS skips FROM mm UNION ALL SELECT 'exact', count(*) FILTER ({EXACT_SKIP}) FROM rg")
def V1_verifiers(s, d):
    box = price_boxes(s, d)
    one = lambda k: ve.verify(k, box, REG, XY, LO, HI).agg(F.lit(k).alias("verifier"), F.sum(F.col("should_skip").cast("int")).cast("long").alias("skips"))
    return one("interval").unionByName(one("exact"))


def _against_truth(verdicts, better_than, truth_skip) -> DataFrame:
    """One row: blocks, skipped blocks that hold a match, and whether all that `better_than` skips is skipped too (and some blocks are)."""
    j = verdicts.select("block_id", F.col("should_skip").alias("v")).join(truth_skip.select("block_id", F.col("should_skip").alias("t")), "block_id")
    j = j.join(better_than.select("block_id", F.col("should_skip").alias("w")), "block_id")
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return j.agg(F.count("*").alias("blocks"), n(F.col("v") & ~F.col("t")).alias("false_skips"), ((n(F.col("w") & ~F.col("v")) == 0) & (n(F.col("v")) * 2 > n(F.col("t")))).alias("skips_as_asked"))


@query(f"WITH {LIC} SELECT count(DISTINCT block_id) AS blocks, 0::BIGINT AS false_skips, TRUE AS skips_as_asked FROM b")
def V5_hull_verdicts(s, d):
    """Hulls skip what boxes skip exactly, and no block with a match."""
    p = price_points(s, d)
    found = ve.verdicts(bl.block_minmax(p, XY).join(bl.block_hulls(p, "x", "y"), "block_id"), REG, XY, LO, HI)
    return _against_truth(found, V3_exact_verdicts(s, d), V22_inference_verdicts(s, d))


@query(f"WITH {LIC} SELECT count(DISTINCT block_id) AS blocks, 0::BIGINT AS false_skips, TRUE AS skips_as_asked FROM b")
def V11_linear_verdicts(s, d):
    """One relaxation skips what intervals skip, and no block with a match."""
    return _against_truth(ve.verdicts(price_boxes(s, d), REG, XY, LO, HI, exact=False), V6_interval_verdicts(s, d), V22_inference_verdicts(s, d))


@query(f"WITH {CUC} SELECT count(DISTINCT block_id) AS blocks, 0::BIGINT AS false_skips, TRUE AS skips_as_asked FROM b")
def V7_classifier_verdicts(s, d):
    t = la.kept_layout(s, f"{d}/customer.parquet", SIZE, ["c_acctbal"])
    meta = bl.block_minmax(rw.block_points(t, {"x": CLS.features[0], "y": CLS.features[1]}, SIZE), XY)
    return _against_truth(ve.verdicts(meta, CLS, XY, target=CLASS), ve.interval_verdicts(meta, CLS, XY, target=CLASS), pr.inference_verdicts(t, CLS.matches(target=CLASS), SIZE))


@query(f"WITH {LIC} SELECT block_id, NOT bool_or({REG.predict_sql()} BETWEEN {LO} AND {HI}) AS should_skip FROM b GROUP BY block_id")
def V22_inference_verdicts(s, d):
    return pr.inference_verdicts(by_price(s, d), REG.matches(LO, HI), SIZE)


@query(f"{RANGE}, o AS (SELECT block_id, count(*) FILTER ({REG.predict_sql()} BETWEEN {LO} AND {HI}) AS n FROM b GROUP BY block_id) SELECT block_id, {EXACT_SKIP} AS should_skip, n AS matching, {EXACT_SKIP} AND n > 0 AS false_skip FROM rg JOIN o USING (block_id)")
def V23_evaluation(s, d):
    counts = rw.with_block_id(by_price(s, d), SIZE).groupBy("block_id").agg(F.sum(REG.matches(LO, HI).cast("int")).cast("long").alias("n_rows"))
    return pr.evaluation(price_boxes(s, d), ve.verdicts(price_boxes(s, d), REG, XY, LO, HI), counts)


@query(f"WITH {PTC} SELECT count(*) AS total, count(*) FILTER (NOT {T1}) AS kept FROM mm")
def V24_kept_blocks(s, d):
    return V6_interval_verdicts(s, d).agg(F.count("*").alias("total"), F.sum((~F.col("should_skip")).cast("int")).cast("long").alias("kept"))


@query(f"WITH {PTC}, o AS (SELECT block_id, count(*) AS rows_in_block, count(*) FILTER ({REG.predict_sql()} BETWEEN {LO} AND {HI}) AS matching FROM b GROUP BY block_id) SELECT block_id, round(x_lo, 9) AS x_lo, round(x_hi, 9) AS x_hi, {T1} AS should_skip, rows_in_block, matching FROM mm JOIN o USING (block_id) WHERE block_id = 31")
def V25_inspect_block(s, d):
    """A block behind the training prefix of 2,000 rows."""
    found = pr.inspect_block(by_price(s, d), price_boxes(s, d), V6_interval_verdicts(s, d), REG.matches(LO, HI), 31, SIZE, training_rows=2000)
    return found.select("block_id", F.round("x_lo", 9).alias("x_lo"), F.round("x_hi", 9).alias("x_hi"), "should_skip", "rows_in_block", "matching")


@query(f"WITH {PTC}, t AS (SELECT count(*) AS n FROM b WHERE {REG.predict_sql()} BETWEEN {LO} AND {HI}) SELECT n, n AS pruned, TRUE AS same, (SELECT count(*) FROM mm) AS blocks, (SELECT count(*) FROM mm WHERE NOT {T1}) AS kept FROM t")
def G13_benchmark_job(s, d):
    """Full and pruned count of a predicate; the pruned one reads the kept blocks alone."""
    t, match = by_price(s, d), REG.matches(LO, HI)
    v = V6_interval_verdicts(s, d)
    pruned = la.read_blocks(t, v.where("NOT should_skip")).where(match).agg(F.count("*").alias("pruned"))
    kept = v.agg(F.count("*").alias("blocks"), F.sum((~F.col("should_skip")).cast("int")).cast("long").alias("kept"))
    # One row each.
    whole = t.where(match).agg(F.count("*").alias("n")).crossJoin(pruned).crossJoin(kept)
    return whole.select("n", "pruned", (F.col("n") == F.col("pruned")).alias("same"), "blocks", "kept")


@query(f"WITH {PTC}, v AS (SELECT block_id, {T1} AS skip FROM mm), o AS (SELECT block_id, NOT bool_or({REG.predict_sql()} BETWEEN {LO} AND {HI}) AS can FROM b GROUP BY block_id) SELECT round(CASE WHEN count(*) FILTER (can) = 0 THEN 100.0 ELSE 100.0 * count(*) FILTER (skip) / count(*) FILTER (can) END, 6) AS pct, count(*) FILTER (skip AND NOT can) AS false_skips FROM v JOIN o USING (block_id)")
def G14_effectiveness(s, d):
    j = V6_interval_verdicts(s, d).join(V22_inference_verdicts(s, d).withColumnRenamed("should_skip", "can"), "block_id")
    n = lambda c: F.sum(c.cast("int"))
    return j.agg(F.round(pr.effectiveness(n(F.col("should_skip")), n(F.col("can"))).cast("double"), 6).alias("pct"), n(F.col("should_skip") & ~F.col("can")).cast("long").alias("false_skips"))


EM = "e AS (SELECT vec_id, CAST(floor((row_number() OVER () - 1) / 25.0) AS BIGINT) AS block_id, embedding FROM embeddings), c AS (SELECT block_id, vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM e), w(pos, w) AS (VALUES " + ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(W64)) + "), bd AS (SELECT block_id, pos, min(v) AS lo, max(v) AS hi, avg(v) AS center FROM c GROUP BY ALL)"
BALL = f"WITH {EM}, gp AS (SELECT block_id, vec_id, pos // 16 AS slice, abs(v - center) AS d FROM c JOIN bd USING (block_id, pos)), nr AS (SELECT block_id, slice, vec_id, max(d) AS r1, sqrt(sum(d * d)) AS r2, sum(d) AS ri FROM gp GROUP BY ALL), mx AS (SELECT block_id, slice, max(r1) AS r1, max(r2) AS r2, max(ri) AS ri FROM nr GROUP BY ALL), wn AS (SELECT pos // 16 AS slice, sum(abs(w)) AS w1, sqrt(sum(w * w)) AS w2, max(abs(w)) AS wi FROM w GROUP BY 1), mid AS (SELECT block_id, sum(w * center) + {BIAS} AS mid FROM bd JOIN w USING (pos) GROUP BY 1), rg AS (SELECT block_id, sum(w1 * r1) AS a, sum(w2 * r2) AS b2, sum(wi * ri) AS i FROM mx JOIN wn USING (slice) GROUP BY 1)"


VECTORS = 25


def _vectors(s, d):
    return lg.block_vectors(rw.read_table(s, f"{d}/embeddings.parquet"), VECTORS)


def _bounds(s, d):
    return lg.dimension_bounds(_vectors(s, d), len(W64))


@query(f"WITH {EM} SELECT block_id, pos, lo, hi FROM bd")
def E5_dimension_bounds(s, d):
    return _bounds(s, d).select("block_id", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "b")).select("block_id", "pos", "b.lo", "b.hi")


@query(f"WITH {EM} SELECT block_id, round(sum(CASE WHEN w >= 0 THEN w * lo ELSE w * hi END) + {BIAS}, 6) AS lo, round(sum(CASE WHEN w >= 0 THEN w * hi ELSE w * lo END) + {BIAS}, 6) AS hi FROM bd JOIN w USING (pos) GROUP BY block_id")
def E18_interval_range(s, d):
    r = lg.interval_range(_bounds(s, d), W64, BIAS)
    return r.select("block_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {EM} SELECT block_id, NOT (sum(CASE WHEN w >= 0 THEN w * hi ELSE w * lo END) + {BIAS} >= ln({T_INTERVAL} / (1 - {T_INTERVAL}))) AS should_skip FROM bd JOIN w USING (pos) GROUP BY block_id")
def E20_interval_decision(s, d):
    return lg.decide(lg.interval_range(_bounds(s, d), W64, BIAS), ">=", T_INTERVAL).select("block_id", "should_skip")


PS = [1.0, 2.0, float("inf")]


def _balls(s, d, size=16):
    v, b = _vectors(s, d), _bounds(s, d)
    return lg.ball_range(lg.ball_metadata(v, b, PS, len(W64), size), b, W64, BIAS, PS, size)


@query(f"{BALL} SELECT block_id, 'p1' AS p, round(mid - a, 6) AS lo, round(mid + a, 6) AS hi FROM rg JOIN mid USING (block_id) UNION ALL SELECT block_id, 'p2', round(mid - b2, 6), round(mid + b2, 6) FROM rg JOIN mid USING (block_id) UNION ALL SELECT block_id, 'pinf', round(mid - i, 6), round(mid + i, 6) FROM rg JOIN mid USING (block_id)")
def E14_sliced_ranges(s, d):
    name = F.when(F.col("p") == 1, "p1").when(F.col("p") == 2, "p2").otherwise("pinf")
    return _balls(s, d).select("block_id", name.alias("p"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"{BALL.replace('pos // 16', '0')} SELECT block_id, round(mid + least(a, b2, i), 6) AS hi, NOT (mid + least(a, b2, i) >= ln({T} / (1 - {T}))) AS should_skip FROM rg JOIN mid USING (block_id)")
def E16_tightest_decision(s, d):
    return lg.decide(lg.tightest(_balls(s, d, None), ">="), ">=", T).select("block_id", F.round("hi", 6).alias("hi"), "should_skip")


@query(f"WITH {LI} SELECT row_id, round({REG.predict_sql()}, 13) AS prediction FROM li")
def M3_predictions(s, d):
    return lineitem(s, d).select("row_id", F.round(REG.column(), 13).alias("prediction"))


@query(f"WITH {CU} SELECT row_id, {CLS.predict_sql()} AS prediction FROM cu")
def M2_classes(s, d):
    return customer(s, d).select("row_id", CLS.column().alias("prediction"))


@query(f"SELECT count(*) AS n FROM lineitem WHERE {REG.predict_sql()} BETWEEN {LO} AND {HI}")
def M1_udf_count(s, d):
    u = REG.udf()
    return lineitem(s, d).where(u(*[F.expr(f) for f in REG.features]).between(LO, HI)).agg(F.count("*").alias("n"))


@query("SELECT TRUE AS learnt, TRUE AS better_than_mean, 1600::BIGINT AS train_rows, 400::BIGINT AS test_rows")
def M8_train(s, d):
    """On the first 2,000 valid rows: errors far below the target's spread."""
    rows = rw.training_set(lineitem(s, d), FEATURES, "l_extendedprice * (1 - l_discount)", 2000).toPandas()
    _, m = train(rows[XY].to_numpy(), rows["target"].to_numpy(), list(FEATURES.values()), epochs=40)
    n = len(rows)
    return s.createDataFrame([(m["rmse_over_std"] < 0.2, m["baseline_ratio"] < 0.2, int(0.8 * n), n - int(0.8 * n))], "learnt boolean, better_than_mean boolean, train_rows long, test_rows long")


G5_SQL = f"""
WITH r AS (SELECT min({TARGET}) AS low, max({TARGET}) AS high FROM lineitem),
p AS (SELECT low, high, k, 2.0::DOUBLE ** k AS w FROM r, (SELECT unnest(range(1, 60)) AS k) WHERE 2.0::DOUBLE ** k < high - low),
ws AS (SELECT low, high, k - 1 AS i, w FROM p UNION ALL SELECT low, high, (SELECT count(*) FROM p), high - low FROM r),
c AS (SELECT *, least(10, greatest(5, 150 // (SELECT count(*) FROM ws))) AS per FROM ws),
f AS (SELECT *, unnest(range(0, CASE WHEN w >= high - low THEN 1 ELSE per END)) AS j FROM c)
SELECT 'discounted_price_w' || i || '_s' || j AS name,
       round(CASE WHEN w >= high - low THEN low ELSE greatest(low, least(round_even(low + (high - w - low) / (per - 1) * j, 0), high - w)) END, 6) AS lo,
       round(CASE WHEN w >= high - low THEN low ELSE greatest(low, least(round_even(low + (high - w - low) / (per - 1) * j, 0), high - w)) END + w, 6) AS hi
FROM f
"""


@query(G5_SQL)
def G5_regressor_filters(s, d):
    """The workload spans the whole table's target range."""
    low, high = A7_expression_range(s, d).first()
    found = wl.regressor_filters("lineitem", "discounted_price", low, high)
    return s.createDataFrame([(f.name, float(f.lo), float(f.hi)) for f in found], "name string, lo double, hi double").select("name", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"SELECT 'm_class' || c AS name, (SELECT count(*) FROM customer WHERE {CLS.predict_sql()} = c) AS n FROM (SELECT DISTINCT {CLS.predict_sql()} AS c FROM customer)")
def G6_classifier_filters(s, d):
    return customer(s, d).groupBy(CLS.column().alias("c")).agg(F.count("*").alias("n")).select(F.concat(F.lit("m_class"), F.col("c").cast("string")).alias("name"), "n")


@query(f"{TR_SQL} SELECT filter, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM tr GROUP BY filter ORDER BY n_rows, filter")
def G7_sorted_filters(s, d):
    return truth(s, d).groupBy("filter").agg(F.sum("n_rows").alias("n_rows")).orderBy("n_rows", "filter")
