"""Golden values and soundness properties of the engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skipjack.functions import logistic as lg
from skipjack.functions.mlp import Mlp, metrics, train
from skipjack.operators import blocks as bl
from skipjack.operators import rows as rw
from skipjack.plans import cells as ce
from skipjack.plans import prune as pr
from skipjack.plans import verify as ve
from skipjack.plans import workload as wl

SQUARE = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])


def net(rng, inputs, hidden=6, classes=0):
    return Mlp([(rng.normal(size=(hidden, inputs)), rng.normal(size=hidden)), (rng.normal(size=(classes or 1, hidden)), rng.normal(size=classes or 1))], [f"f{i}" for i in range(inputs)], classes)


def test_hull_and_half_spaces():
    hull = bl.convex_hull(SQUARE)
    assert hull.tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    planes = bl.half_spaces(hull)
    assert len(planes) == 4 and all(a * 0.5 + b * 0.5 <= c for a, b, c in planes)
    assert bl.half_spaces(bl.convex_hull(np.array([[0, 0], [1, 1], [2, 2]]))) == []
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(200, 2))
    assert all((a * pts[:, 0] + b * pts[:, 1] <= c + 1e-9).all() for a, b, c in bl.half_spaces(bl.convex_hull(pts)))


@pytest.mark.parametrize(("kind", "args", "want"), [("minmax", (2,), 32), ("convex_hull", (2, 5), 80), ("grid", (2, 0, 4), 64), ("bounded_convex_hull", (2, 3, 4), 36), ("bounded_convex_hull", (0, 5, 4), 7)])
def test_storage_bytes(kind, args, want):
    assert bl.storage_bytes(kind, *args) == want


def frame(spark, rows, names="x double, y double"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id long, {names}")


def test_grid_cells(spark):
    pts = rw.block_points(frame(spark, [(0.1, 0.1), (0.9, 0.9)]), {"x": "x", "y": "y"}, 10)
    assert sorted(r["cell"] for r in bl.grid_cells(pts, "x", "y", 1).collect()) == [0, 3]
    # A constant axis does not hide the other's extent.
    pts = rw.block_points(frame(spark, [(k / 10, 0.5) for k in range(11)]), {"x": "x", "y": "y"}, 100)
    assert sorted(r["cell"] for r in bl.grid_cells(pts, "x", "y", 2).collect()) == [0, 1, 2, 3]


def test_invalid_rows_never_match(spark):
    model = Mlp([(np.eye(2), np.zeros(2)), (np.ones((1, 2)), np.zeros(1))], ["x", "y"])
    df = frame(spark, [(1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)])
    assert df.where(model.matches(0, 100)).count() == 1
    assert rw.block_points(df, {"x": "x", "y": "y"}, 1).select("block_id").collect() == [(0,)]
    with pytest.raises(ValueError):
        model.matches(0)


@pytest.mark.parametrize("inputs", [2, 3, 4])
def test_no_skipped_block_matches(spark, inputs):
    rng = np.random.default_rng(inputs)
    names = [f"f{i}" for i in range(inputs)]
    for trial in range(2):
        model = net(rng, inputs)
        data = rng.normal(size=(300, inputs)).cumsum(axis=0) / 5
        df = frame(spark, data.tolist(), ", ".join(f"{n} double" for n in names))
        out = model.predict(data)
        lo, hi = np.quantile(out, [0.9, 0.97])
        pts = rw.block_points(df, {n: n for n in names}, 20)
        meta = bl.block_minmax(pts, names).cache()
        has = {b for b in range(15) if ((out[b * 20 : b * 20 + 20] >= lo) & (out[b * 20 : b * 20 + 20] <= hi)).any()}
        pair = (names[0], names[1])
        cells = ce.cell_table(spark, ce.build_cells(model, data.min(0), data.max(0)), names)
        found = {
            "interval": ve.interval_verdicts(meta, model, names, lo, hi).where("should_skip"),
            "exact": ve.verdicts(meta, model, names, lo, hi).where("should_skip"),
            "hull": ve.verdicts(meta.join(bl.block_hulls(pts, *pair), "block_id"), model, names, lo, hi).where("should_skip"),
            "grid": ve.grid_verdicts(bl.grid_cells(pts, *pair, 3), meta, model, names, pair, 3, lo, hi).where("should_skip"),
            "linear": ve.verify("linear", meta, model, names, lo, hi).where("should_skip"),
            "cells": ce.reachable(meta, cells, names, float(lo), float(hi), (data.min(0), data.max(0))).where("not reachable"),
            "corners": ce.corner_ranges(meta, model, names).where((F.col("hi") < float(lo)) | (F.col("lo") > float(hi))),
        }
        skipped = {k: {r["block_id"] for r in v.collect()} for k, v in found.items()}
        assert all(not (v & has) for v in skipped.values()), skipped
        assert skipped["interval"] <= skipped["exact"] <= skipped["hull"]
        assert skipped["exact"] <= skipped["corners"] and skipped["interval"] <= skipped["linear"]
        undecided = ve.verdicts(meta, model, names, lo, hi).where("status = 'timeout'").count()
        assert undecided == 0 and skipped["corners"] <= skipped["exact"]
        oracle = {r["block_id"] for r in pr.inference_verdicts(df, model.matches(float(lo), float(hi)), 20).where("should_skip").collect()}
        assert oracle == set(range(15)) - has


def test_classifier_verdicts_are_sound(spark):
    rng = np.random.default_rng(9)
    model = net(rng, 2, classes=3)
    data = rng.normal(size=(400, 2)).cumsum(axis=0) / 4
    df = frame(spark, data.tolist(), "f0 double, f1 double")
    pts = rw.block_points(df, {"f0": "f0", "f1": "f1"}, 20)
    for c in range(3):
        has = set((np.flatnonzero(model.predict(data) == c) // 20).tolist())
        got = {r["block_id"] for r in ve.verdicts(bl.block_minmax(pts, ["f0", "f1"]), model, ["f0", "f1"], target=c).where("should_skip").collect()}
        assert not got & has
    tied = Mlp([(np.eye(2), np.zeros(2)), (np.ones((2, 2)), np.zeros(2))], ["x", "y"], 2)
    assert ve.exact_status(tied, np.zeros(2), np.ones(2), target=0) == ve.SAT
    assert ve.exact_status(tied, np.array([np.nan, 0]), np.ones(2), target=0) == ve.ERROR


def test_slanted_cell_and_closed_bounds():
    # f = y - x with y <= 2x: the witness (0.5, 1) keeps the block.
    assert ve.exact_status(Mlp([(np.eye(1), np.zeros(1)), (np.ones((1, 1)), np.zeros(1))], ["x"]), np.zeros(1), np.ones(1), 2.0, 3.0) == ve.UNSAT
    model = Mlp([(np.array([[-1.0, 1.0], [1.0, -1.0]]), np.zeros(2)), (np.array([[1.0, -1.0]]), np.zeros(1))], ["x", "y"])
    assert ve.exact_status(model, np.array([0, -10.0]), np.array([2, 1.0]), 0.2, 1.0) != ve.UNSAT
    assert ve.exact_status(model, np.array([0, 0.0]), np.array([0, 1.0]), 1.0, 2.0) != ve.UNSAT
    assert ve.exact_status(model, np.array([0, 0.0]), np.array([1, 1.0]), 0.99, 2.0, budget=0) != ve.UNSAT


def test_workload():
    found = wl.regressor_filters("t", "m", 0, 1000, 2.0, 1000)
    by = {}
    for f in found:
        by.setdefault(f.name.split("_")[1], []).append(f)
    assert len(found) <= 150 and all(len(v) >= 5 for k, v in list(by.items())[:-1]) and len(list(by.values())[-1]) == 1
    assert len(wl.regressor_filters("t", "m", 5, 5)) == 1
    assert wl.starts(0, 10, 4, 3) == [0, 3, 6] and wl.starts(0.5, 13.0, 2.5, 5) == [0.5, 3, 6, 8, 10] and wl.starts(2.5, 9, 8, 4) == [2.5]
    assert wl.FilterSpec("a", "t", "m", 0.1, 2).sql("p") == "p BETWEEN 0.1 AND 2"
    with pytest.raises(ValueError):
        wl.widths(10, 1)


def test_selectivity_bins(spark):
    rows = spark.createDataFrame([(0.0, 10.0), (0.0, 30.0), (0.005, 50.0), (0.005, 50.0), (None, 99.0)], "selectivity double, pruning double")
    got = {r["bin"]: (r["n"], r["mean"]) for r in pr.selectivity_bins(rows).collect()}
    assert got == {"= 0": (2, 20.0), "0.001-0.01": (2, 50.0)}


def test_qualified_per_block_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (5, 1), (7, 0), (10, 1)], "row_id long, v int")
    cache = pr.TruthCache(spark, str(tmp_path))
    assert cache.read("a", 6) is None
    cache.write("a", df, F.col("v") == 1)
    assert cache.read("a", 7) is None
    got = {r["block_id"]: r["n_rows"] for r in pr.qualified_per_block(cache.read("a", 6), spark.range(4).withColumnRenamed("id", "block_id"), 5).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 0}
    rng = np.random.default_rng(0)
    a, b = net(rng, 2), net(rng, 2)
    assert pr.cache_key("t", a, 5, "p") != pr.cache_key("t", b, 5, "p") and Mlp.from_json(a.to_json()).to_json() == a.to_json()


def test_row_ids_over_files(spark, tmp_path):
    spark.range(57).repartition(4).write.parquet(str(tmp_path / "t"))
    df = rw.read_table(spark, str(tmp_path / "t"))
    assert rw.check_row_ids(df) and df.select("row_id").distinct().count() == 57
    assert rw.check_row_ids(df.limit(0)) and not rw.check_row_ids(df.where("row_id > 3"))
    assert rw.in_blocks(df, [], 10).count() == 0 and rw.in_blocks(df, [5], 10).count() == 7
    assert rw.in_blocks(df, list(range(300)), 10).count() == 57


def test_logistic(spark):
    assert lg.logit(0.5) == 0 and math.isclose(lg.logit(0.7), math.log(0.7 / 0.3))
    assert [lg.dual(p) for p in (1, math.inf, 2)] == [math.inf, 1, 2] and math.isclose(lg.dual(10), 10 / 9)
    assert lg.slices(10, 4) == [(0, 4), (4, 8), (8, 10)]
    for bad in (0, 1):
        with pytest.raises(ValueError):
            lg.logit(bad)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7))
    w = rng.normal(size=7).tolist()
    vectors = lg.block_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, embedding array<double>"), 15)
    bounds = lg.dimension_bounds(vectors, 7)
    first = bounds.where("block_id = 0").first()
    assert np.allclose(first["lo"], x[:15].min(0)) and np.allclose(first["hi"], x[:15].max(0)) and np.allclose(first["center"], x[:15].mean(0))
    logits = x @ np.array(w) + 0.3
    ranges = [lg.interval_range(bounds, w, 0.3)]
    ps = [1.0, 2.0, 3.0, math.inf]
    for size in (None, 3):
        ranges.append(lg.ball_range(lg.ball_metadata(vectors, bounds, ps, 7, size), bounds, w, 0.3, ps, size))
    for r in ranges:
        for row in r.collect():
            own = logits[row["block_id"] * 15 : row["block_id"] * 15 + 15]
            assert row["lo"] <= own.min() + 1e-9 and row["hi"] >= own.max() - 1e-9
    best = {r["block_id"]: r["hi"] for r in lg.tightest(ranges[1], ">=").collect()}
    assert all(best[r["block_id"]] <= r["hi"] for r in ranges[1].collect())
    radius = {(r["block_id"], r["p"]): r["radius"] for r in lg.ball_metadata(vectors, bounds, ps, 7).collect()}
    gap = np.abs(x[:15] - x[:15].mean(0))
    assert all(abs(radius[0, p] - max(lg.norm(g, lg.dual(p)) for g in gap)) < 1e-9 for p in ps)
    assert lg.exponents(3) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        lg.decide(bounds, "=", 0.5)
    with pytest.raises(ValueError):
        lg.interval_range(bounds, w[:3], 0.3)


def test_training():
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 100, (800, 2))
    model, m = train(x, x[:, 0] * 3 + x[:, 1], ["a", "b"], hidden=(16,), epochs=80)
    assert m["rmse_over_std"] < 0.2
    model, m = train(x, (x[:, 0] > 50).astype(int), ["a", "b"], classes=2, hidden=(8,), epochs=60)
    assert m["accuracy"] > 0.9 and model.predict(x[:3]).shape == (3,)
    assert metrics(np.array([1, 2]), np.array([1, 3]), 3) == {"accuracy": 0.5}


def test_column_and_udf_agree(spark):
    rng = np.random.default_rng(2)
    for classes in (0, 3):
        model = net(rng, 2, classes=classes)
        rows = [*rng.normal(size=(50, 2)).tolist(), (None, 1.0), (float("nan"), 0.0)]
        df = frame(spark, rows, "f0 double, f1 double")
        both = df.select(model.column().cast("double").alias("a"), model.udf()("f0", "f1").alias("b")).collect()
        assert all(abs(r["a"] - r["b"]) < 1e-9 for r in both[:50])


def test_laid_out_tables_prune(spark, tmp_path):
    from skipjack.operators import layout as la

    rng = np.random.default_rng(1)
    spark.createDataFrame([(float(v), int(k)) for k, v in enumerate(rng.normal(size=5000))], "v double, k long").coalesce(3).write.parquet(str(tmp_path / "t"))
    df = la.clustered(rw.read_table(spark, str(tmp_path / "t")), ["v"], str(tmp_path / "c"))
    table = la.lay_out(df, str(tmp_path / "l"), 50, group=10)
    rows = table.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(5000)) and [r["v"] for r in rows] == sorted(r["v"] for r in rows)
    assert all(r["block_id"] == r["row_id"] // 50 and r["block_group"] == r["block_id"] // 10 for r in rows)
    assert la.ranges([5, 1, 2, 2, 9]) == [(1, 2), (5, 5), (9, 9)]
    for kept in ([], [3], [3, 4, 50], list(range(0, 100, 2))):
        want = sorted(r["row_id"] for r in rows if r["block_id"] in kept)
        side = spark.createDataFrame([(b,) for b in kept], "block_id long")
        for how in (kept, side):
            assert sorted(r["row_id"] for r in la.read_blocks(table, how, 10).select("row_id").collect()) == want
    plan = la.read_blocks(table, [3, 4, 50], 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [block_group" in plan and "GreaterThanOrEqual(block_id,3)" in plan and "Join" not in plan


def test_many_kept_ranges_are_joined(spark, tmp_path, monkeypatch):
    from skipjack.operators import layout as la

    monkeypatch.setattr(la, "MAX_RANGES", 3)
    spark.range(4000).selectExpr("id AS v").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = la.lay_out(rw.read_table(spark, str(tmp_path / "t")), str(tmp_path / "l"), 50, group=10)
    kept = list(range(0, 80, 7))
    out = la.read_blocks(table, kept, 10)
    assert out.count() == 50 * len(kept) and "LeftSemi" in out._jdf.queryExecution().toString()


def test_metadata_of_all_pairs(spark):
    from skipjack.operators import metadata as md

    rng = np.random.default_rng(3)
    data = np.round(rng.normal(size=(120, 3)), 2)
    data[:40, 2] = 1.0
    pts = rw.block_points(frame(spark, data.tolist(), "a double, b double, c double"), {n: n for n in "abc"}, 40)
    names = ["a", "b", "c"]
    hulls = {r["block_id"]: r for r in md.collect(pts, names, "convex_hull").collect()}
    grids = {r["block_id"]: r for r in md.collect(pts, names, "grid", 2).collect()}
    bounded = md.collect(pts, names, "bounded_convex_hull", 2)
    assert sorted(hulls) == [0, 1, 2] and md.pair_count(bounded) == 3
    for b in range(3):
        own = data[b * 40 : b * 40 + 40]
        assert [(p["feature_x"], p["feature_y"]) for p in hulls[b]["pairs"]] == [("a", "b"), ("a", "c"), ("b", "c")]
        for p, q in zip(hulls[b]["pairs"], grids[b]["pairs"], strict=True):
            i, j = names.index(p["feature_x"]), names.index(p["feature_y"])
            assert [(c["x"], c["y"]) for c in p["hull"]] == [tuple(c) for c in bl.convex_hull(own[:, [i, j]]).tolist()]
            index = lambda v: np.zeros(len(v), int) if v.max() == v.min() else np.clip(((v - v.min()) / (v.max() - v.min()) * 4).astype(int), 0, 3)
            assert q["grid_cells"] == sorted(set((index(own[:, j]) * 4 + index(own[:, i])).tolist())) and q["grid_depth"] == 2 and q["hull"] is None
    assert all(p["bounded_hull"] is not None for r in bounded.collect() for p in r["pairs"])
    assert md.collect(pts, ["a"], "grid").select("pairs").first()[0] == [] and md.collect(pts, names, "grid", blocks=[1]).count() == 1
    assert md.collect(pts, names, blocks=[]).count() == 0
    total = md.size_summary(md.collect(pts, names, "grid", 4), "grid").first()
    assert (total["block_count"], total["avg_bytes"], total["max_bytes"]) == (3, 48 + 3 * 32, 48 + 3 * 32)
    corners = [len(p["hull"]) for r in hulls.values() for p in r["pairs"]]
    total = md.size_summary(md.collect(pts, names, "convex_hull"), "convex_hull").first()
    assert abs(total["avg_vertices"] - np.mean(corners)) < 1e-9 and total["max_vertices"] == max(corners)
    assert md.resolve_kind(None) == "minmax" and md.resolve_depth(None) == 4 and md.resolve_depth(None, wl.FilterSpec("f", "t", "m", grid_depth=2)) == 2
    with pytest.raises(ValueError):
        md.resolve_depth(-1)
    with pytest.raises(ValueError):
        ve.verify("oracle", pts, None, names)
    low, high = md.matrix_bounds(np.zeros((0, 2)))
    assert np.isnan(low).all() and np.isnan(high).all()
    bundle = md.Bundle()
    assert bundle.get("t", pts, names) is bundle.get("t", pts, names, depth=7)


#: Golden values of the sizes' summary: a block of 4 and one of 3 corners (fixed).
def test_size_summary_of_known_blocks(spark):
    from skipjack.operators import metadata as md

    corner = "array<struct<x:double,y:double>>"
    hull = lambda n: [(float(k), 0.0) for k in range(n)]
    rows = [(b, 1, {"x": (0.0, 1.0), "y": (0.0, 1.0)}, [("x", "y", None, 4, None, hull(n))], ms) for b, n, ms in ((0, 4, 12.5), (1, 3, 7.5))]
    meta = spark.createDataFrame(rows, f"block_id long, n_rows long, bounds map<string,struct<lo:double,hi:double>>, pairs array<{md.PAIR}>, ms double")
    assert corner in md.PAIR
    r = md.size_summary(meta, "bounded_convex_hull", F.col("ms")).first()
    assert (r["avg_bytes"], r["max_bytes"], r["total_ms"], r["avg_ms"]) == ((37 + 36) / 2, 37, 20.0, 10.0)
    assert (r["avg_vertices"], r["max_vertices"]) == (3.5, 4)


def test_cells_equal_the_network(spark):
    from skipjack.plans import decompose as de

    rng = np.random.default_rng(0)
    for dims, hidden in ((1, (5,)), (2, (4,)), (2, (3, 2)), (3, (3,))):
        sizes = [dims, *hidden, 1]
        model = Mlp([(rng.normal(size=(b, a)), rng.normal(size=b)) for a, b in zip(sizes, sizes[1:], strict=False)], [f"f{i}" for i in range(dims)])
        pieces = de.compile_network(model)
        x = rng.normal(size=(200, dims)) * 3
        assert np.allclose([pieces.value(p) for p in x], model.forward(x)[:, 0], atol=1e-9)
        own = de.compiled(pieces)
        assert len(own.leaves) <= len(pieces.cells.leaves) and len({f[1:] for f in own.functions}) == len(own.functions)
        names = model.features
        df = frame(spark, x.tolist(), ", ".join(f"{n} double" for n in names))
        got = {r["row_id"]: r["value"] for r in de.evaluate(df, names, own).collect()}
        assert len(got) == 200 and np.allclose([got[k] for k in range(200)], model.forward(x)[:, 0], atol=1e-9)
        for cell in pieces.cells.leaves:
            assert [c.dim for c in cell.parents()] == list(range(1, dims))


def test_sums_and_relus_of_pieces():
    from skipjack.plans import decompose as de

    a, b = (de.Piecewise.linear(2, f).relu() for f in ([1, -2, 0.5], [0.3, 1, -1]))
    total = a.scaled(2).plus(b).shifted(-1).relu()
    x = np.random.default_rng(1).normal(size=(300, 2)) * 2
    want = np.maximum(2 * np.maximum(x @ [1, -2] + 0.5, 0) + np.maximum(x @ [0.3, 1] - 1, 0) - 1, 0)
    assert np.allclose([total.value(p) for p in x], want, atol=1e-9)
    assert a.functions[0][-1] in (0, 0.5)  # copies: shifting and scaling left it alone
    assert len(de.distinct_planes(np.array([[1.0, 2, 3], [-2, -4, -6], [0, 0, 1], [0, 1, 1]]))) == 2
    flat = de.compiled(de.Piecewise.linear(2, [0, 0, 1.0]).refined(np.array([[0, 1.0, 0], [1.0, 0, 0]])))
    assert len(flat.leaves) == 2 and len(flat.functions) == 1  # neighbours above one parent merge


def test_exact_ranges_over_boxes(spark):
    from skipjack.plans import decompose as de

    rng = np.random.default_rng(5)
    model = net(rng, 2, hidden=4)
    boxes = np.sort(rng.normal(size=(40, 2, 2)) * 2, axis=2)
    boxes[0, 0] = 1.0  # no extent
    meta = spark.createDataFrame([(k, *map(float, b.ravel())) for k, b in enumerate(boxes)], "block_id long, f0_lo double, f0_hi double, f1_lo double, f1_hi double")
    cells = {r["block_id"]: (r["lo"], r["hi"]) for r in de.box_ranges(meta, ["f0", "f1"], de.compiled(de.compile_network(model))).collect()}
    corners = {r["block_id"]: (r["lo"], r["hi"]) for r in ce.corner_ranges(meta, model, ["f0", "f1"]).collect()}
    grid = np.linspace(0, 1, 60)
    for k, ((a, z), (c, e)) in enumerate(boxes):
        seen = model.forward(np.stack(np.meshgrid(a + grid * (z - a), c + grid * (e - c)), -1).reshape(-1, 2))[:, 0]
        assert np.allclose(cells[k], corners[k], atol=1e-9)
        assert cells[k][0] <= seen.min() + 1e-9 and cells[k][1] >= seen.max() - 1e-9 and np.ptp(cells[k]) <= np.ptp(seen) + 0.5


@pytest.mark.parametrize("name", ["V6_interval_verdicts", "V13_grid_verdicts", "V3_exact_verdicts", "V22_inference_verdicts", "E16_tightest_decision", "E17_sliced_decision_below", "E20_interval_decision"])
def test_verdict_queries_decide_both_ways(spark, name):
    """Between a tenth and nine tenths of the blocks are skipped: an engine that always says no fails."""
    from skipjack import registry

    rows = [r["should_skip"] for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
    assert 0.1 <= np.mean(rows) <= 0.9


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Blocks of one price each, whose predictions lie a hair outside, at, or inside the predicate's ends."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from skipjack.plans import queries as qs

    def price(value):
        low, high = 0.3, 3.0
        for _ in range(200):
            x = (low + high) / 2
            low, high = (x, high) if qs.REG.forward(np.array([[x, 0.0]]))[0, 0] < value else (low, x)
        return low * 1e5

    near = [price(v) for v in (qs.LO - 5e-6, qs.LO - 1e-9, qs.LO + 5e-6, 1.1, qs.HI - 5e-6, qs.HI + 1e-9, qs.HI + 5e-6, 3.0)]
    n = len(near) * qs.SIZE
    path = tmp_path_factory.mktemp("edges")
    columns = {"l_orderkey": np.arange(n), "l_linenumber": np.ones(n, int), "l_extendedprice": np.repeat(near, qs.SIZE), "l_discount": np.zeros(n)}
    pq.write_table(pa.table(columns), path / "lineitem.parquet")
    return str(path)


def against_sql(spark, name, path):
    import duckdb

    from skipjack import registry

    base = duckdb.connect()
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet'")
    want = base.execute(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, path).select(*[c[0] for c in want.description])
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["V3_exact_verdicts", "V5_hull_verdicts", "V1_verifiers", "V23_evaluation", "V2_status_text"])
def test_exact_verdicts_at_the_ends(spark, edges, name):
    got, want = against_sql(spark, name, edges)
    assert got == want


def test_truth_cache_key_follows_the_content(spark, tmp_path):
    from skipjack.storage import fingerprint

    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    before = fingerprint(spark, path)
    spark.range(10).selectExpr("id + 1 AS id").write.mode("overwrite").parquet(path)
    model = net(np.random.default_rng(0), 2)
    keys = {pr.cache_key("t", model, 5, "p", v, b) for v in (before, fingerprint(spark, path)) for b in (None, [1], [1, 2])}
    assert len(keys) == 6 and pr.cache_key("t", model, 5, "p", "", [2, 1]) == pr.cache_key("t", model, 5, "p", "", [1, 2])


def test_jobs(spark, tmp_path):
    from skipjack.operators import layout as la
    from skipjack.operators import metadata as md
    from skipjack.plans import jobs
    from skipjack.sources.catalog import STAR_FUNCTIONS

    table = rw.read_table(spark, "/root/testdata/sf0.001/lineitem.parquet")
    model, own = jobs.train_model(spark, table, STAR_FUNCTIONS[0], str(tmp_path / "m"), rows=600, epochs=30)
    again, same = jobs.train_model(spark, table, STAR_FUNCTIONS[0], str(tmp_path / "m"), rows=600, epochs=30)
    assert again.to_json() == model.to_json() and same == own and own["metrics"]["baseline_ratio"] < 0.5 and own["parameters"] == 32 * 3 + 33
    assert jobs.train_model(spark, table, STAR_FUNCTIONS[0], str(tmp_path / "m"), rows=500, epochs=5)[1]["rows"] == 500
    laid = la.lay_out(la.clustered(table, ["l_extendedprice"], str(tmp_path / "c")), str(tmp_path / "l"), 100)
    specs = [wl.FilterSpec(f"f{k}", "lineitem", "m", 20_000.0 * k, 20_000.0 * k + 9000) for k in range(2)]
    bundle = md.Bundle()
    found = jobs.run_jobs([lambda f=f, k=k: jobs.benchmark(laid, model, ["x", "y"], f, 100, bundle, "t", k, "exact") for f in specs for k in ("minmax", "grid", "convex_hull")], workers=2)
    assert all(r["equal"] and r["kept"] < r["blocks"] == 60 for r in found) and [r["filter"] for r in found] == ["f0"] * 3 + ["f1"] * 3
    with pytest.raises(ValueError):
        pr.inspect_block(laid, None, None, None, 3, 100, training_rows=2000)
    assert wl.one_per_template([*specs, *specs]) == specs[:1] and list(wl.grouped(specs)) == [("lineitem", "m")]
    assert wl.sorted_filters(specs, {"f0": 9, "f1": 2}) == specs[::-1]


def test_rows_per_block_lists_every_block(spark, tmp_path):
    from skipjack.plans import queries as qs

    spark.range(0, 120_050, 1, 3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["block_id"]: r["n_rows"] for r in qs.A10_rows_per_block(spark, str(tmp_path)).collect()}
    assert got == {k: 100 for k in range(1200)} | {1200: 50}
