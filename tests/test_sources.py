import numpy as np
import pytest

from skipjack.functions.mlp import Mlp
from skipjack.operators import rows as rw
from skipjack.plans import workload as wl
from skipjack.plans.decompose import compile_network, compiled
from skipjack.sources import catalog as ca
from skipjack.sources import export as ex
from skipjack.sources.onnx import read_onnx


def test_catalogs(tmp_path):
    ca.save_functions(ca.STAR_FUNCTIONS, tmp_path / "f.json")
    assert ca.load_functions(tmp_path / "f.json") == ca.STAR_FUNCTIONS
    assert [f.name for f in ca.load_functions(tmp_path, ["charge"])] == ["charge"]
    with pytest.raises(ValueError, match="nothing"):
        ca.load_functions(tmp_path, ["nothing"])
    filters = wl.classifier_filters("t", "m", [2, 0]) + wl.regressor_filters("t", "r", 0, 4)
    ca.save_filters(filters, tmp_path / "x" / "g.json")
    assert ca.load_filters(tmp_path / "x") == filters


def test_dialect(spark):
    out = spark.createDataFrame([("1970-01-02", 2.0), ("1970-01-01", float("nan"))], "d string, v double")
    rows = out.selectExpr(ca.to_spark("epoch(CAST(d AS DATE)) + 1") + " AS e", ca.to_spark("isfinite(v + abs(v))") + " AS f").collect()
    assert [tuple(r) for r in rows] == [(86401, True), (1, False)]


def test_star_functions_run(spark):
    for f in ca.STAR_FUNCTIONS:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{f.table}.parquet")
        assert df.selectExpr(*f.spark_features().values(), f"{ca.to_spark(f.target)} AS t").where("t is not null").count() == df.count()


def test_exports(spark, tmp_path):
    for when, n in (("1", 5), ("2", 6)):
        ex.write_result({"backend": "interval", "metadata": "minmax", "finished": when, "kept": n}, tmp_path / "r", "a")
    ex.write_result({"backend": "exact", "metadata": "minmax", "finished": "0", "kept": 1}, tmp_path / "r", "b")
    got = {r["backend"]: r["kept"] for r in ex.newest_results(spark, str(tmp_path / "r")).collect()}
    assert got == {"interval": 6, "exact": 1}
    for h in ("x", "y"):
        (tmp_path / f"s-{h}.json").write_text("[]")
    assert [p.name for p in ex.drop_stale(tmp_path, "s", "y")] == ["s-x.json"]
    truth = spark.createDataFrame([(0, "f", 3)], "block_id long, filter string, n_rows long")
    assert spark.read.json(ex.export_truth(truth, str(tmp_path), "t", "m")).first()["n_rows"] == 3
    with pytest.raises(FileNotFoundError):
        ex.read_compiled(spark, str(tmp_path / "none"))
    model = Mlp([(np.array([[1.0, -0.5], [0.5, 1.0]]), np.array([-0.2, 0.3])), (np.array([[0.9, -0.4]]), np.array([0.05]))], ["x", "y"])
    sizes = ex.write_compiled(spark, model, str(tmp_path / "c"))
    own = ex.read_compiled(spark, str(tmp_path / "c"))
    assert own == compiled(compile_network(model)) and sizes["cells"] == [len(d) for d in own.dims]
    meta = spark.createDataFrame([(1, 0.5)], "block_id long, x_lo double")
    assert spark.read.json(ex.export_metadata(meta, str(tmp_path), "t", "m", "minmax")).first()["x_lo"] == 0.5


def test_setups_and_tables(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"name": "star", "tables": ["nation"], "path": "/root/testdata/sf0.001"}')
    setup = ca.load_setup(tmp_path / "s.json")
    assert setup.training_blocks(1500) == 2
    ca.check_tables(spark, setup.path, setup.tables)
    with pytest.raises(FileNotFoundError, match="dates"):
        ca.check_tables(spark, setup.path, ["nation", "dates"])
    assert not ca.table_exists(spark, "no_such_table")
    for k in range(2):
        (tmp_path / f"p{k}.csv").write_text("a,b\n" + "\n".join(f"{k}{i},x" for i in range(3)))
    table = rw.load_csv(spark, [str(tmp_path / "p0.csv"), str(tmp_path / "p1.csv")], str(tmp_path / "out"))
    assert rw.check_row_ids(table) and table.count() == 6
    assert rw.check_row_ids(rw.ensure_row_ids(table.where("row_id > 1"), str(tmp_path / "again")))
    assert rw.quoted("a`b") == "`a``b`"


def _message(*parts):
    out = b""
    for number, kind, value in parts:
        if kind == 0:
            out += bytes([number << 3, value])
        else:
            size, head = len(value), b""
            while size > 127:
                head, size = head + bytes([size & 127 | 128]), size >> 7
            out += bytes([number << 3 | 2]) + head + bytes([size]) + value
    return out


def test_onnx_files(spark):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(5, 2)), rng.normal(size=5)), (rng.normal(size=(1, 5)), rng.normal(size=1))]
    graph = b""
    for k, (w, b) in enumerate(layers):
        turned = k == 0  # once as outputs x inputs, once as inputs x outputs
        stored = np.ascontiguousarray(w if turned else w.T)
        attribute = _message((1, 2, b"transB"), (3, 0, 1)) if turned else _message((1, 2, b"alpha"), (3, 0, 1))
        graph += _message((1, 2, _message((1, 2, b"x"), (1, 2, f"w{k}".encode()), (1, 2, f"b{k}".encode()), (2, 2, b"y"), (4, 2, b"Gemm"), (5, 2, attribute))))
        graph += _message((1, 2, _message((1, 2, b"y"), (2, 2, b"z"), (4, 2, b"Relu"))))
        graph += _message((5, 2, _message((1, 0, stored.shape[0]), (1, 0, stored.shape[1]), (2, 0, 1), (8, 2, f"w{k}".encode()), (9, 2, stored.astype("<f4").tobytes()))))
        graph += _message((5, 2, _message((1, 0, len(b)), (2, 0, 11), (8, 2, f"b{k}".encode()), (10, 2, b.astype("<f8").tobytes()))))
    model = read_onnx(_message((1, 0, 8), (7, 2, graph)), ["a", "b"])
    x = rng.normal(size=(20, 2))
    assert np.allclose(model.forward(x), Mlp(layers, ["a", "b"]).forward(x), atol=1e-5)
    with pytest.raises(ValueError, match="Conv"):
        read_onnx(_message((7, 2, _message((1, 2, _message((4, 2, b"Conv")))))), ["a"])
    state = {"0.weight": layers[0][0], "0.bias": layers[0][1], "2.weight": layers[1][0], "2.bias": layers[1][1]}
    assert np.allclose(Mlp.from_state(state, ["a", "b"]).forward(x), Mlp(layers, ["a", "b"]).forward(x))
