"""Whole runs: training with reuse, and benchmark jobs over a laid-out table with separate times."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipjack.functions.mlp import Mlp, train
from skipjack.operators import layout as la
from skipjack.operators import metadata as md
from skipjack.operators import rows as rw
from skipjack.plans import verify as ve
from skipjack.plans.workload import FilterSpec
from skipjack.sources.catalog import FunctionSpec
from skipjack.storage import exists, read_text, write_text

HIDDEN = {"shallow": (32,), "deep": (32, 32)}


def run_jobs(jobs: list[Callable], workers: int = 1) -> list:
    """Results in the order of the jobs; several actions of one session share its executors."""
    if workers <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda job: job(), jobs))


@lru_cache(maxsize=32)
def load_model(text: str) -> Mlp:
    """A network from its JSON, parsed once."""
    return Mlp.from_json(text)


def train_model(spark: SparkSession, table: DataFrame, spec: FunctionSpec, root: str, kind: str = "shallow", rows: int = 2000, epochs: int = 120, force: bool = False) -> tuple[Mlp, dict]:
    """Network and metadata of a function, from root if the same was trained before, otherwise trained and written there.

    The metadata holds the training's size, its metrics and the observed ranges of the features. The driver holds `rows` rows.
    """
    path = f"{root}/{spec.table}/{spec.name}-{kind}.json"
    if not force and exists(spark, path):
        own = json.loads(read_text(spark, path))
        same = (own["rows"], own["epochs"], own["kind"], own["target"]) == (rows, epochs, kind, spec.target)
        if same and all(v is not None and np.isfinite(v) for v in own["metrics"].values()):
            return load_model(own["model"]), own
    features = spec.spark_features()
    data = rw.training_set(table, features, spec.target, rows, spec.num_classes or None).toPandas()
    x, y = data[list(features)].to_numpy(float), data["target"].to_numpy()
    net, metrics = train(x, y, list(features.values()), classes=spec.num_classes, hidden=HIDDEN[kind], epochs=epochs)
    own = {
        "function": spec.name,
        "task": spec.task,
        "target": spec.target,
        "features": features,
        "rows": rows,
        "epochs": epochs,
        "kind": kind,
        "metrics": metrics,
        "parameters": int(sum(w.size + b.size for w, b in net.layers)),
        "hidden": list(HIDDEN[kind]),
        "ranges": {n: [float(x[:, i].min()), float(x[:, i].max())] for i, n in enumerate(features)},
        "model": net.to_json(),
    }
    write_text(spark, path, json.dumps(own))
    return net, own


def benchmark(table: DataFrame, net: Mlp, names: list[str], spec: FilterSpec, size: int, bundle: md.Bundle, key: str, kind: str | None = None, verifier: str = "interval", depth: int | None = None) -> dict:
    """One filter over a laid-out table: metadata, verdicts and counts with their times, and whether the pruned count is the full one."""
    kind, depth = md.resolve_kind(kind, spec), md.resolve_depth(depth, spec)
    match = net.matches(spec.lo, spec.hi, spec.target)
    took = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    points = rw.block_points(table, dict(zip(names, net.features, strict=True)), size)
    blocks = timed("metadata_s", lambda: bundle.get(key, points, names, kind, depth).count())
    meta = bundle.get(key, points, names, kind, depth)

    def judge():
        if kind == "grid":
            pair = (names[0], names[1])
            boxes = md.flat(meta, names).drop("hull")
            cells = meta.select("block_id", F.explode(F.element_at("pairs", 1)["grid_cells"]).alias("cell"))
            found = ve.grid_verdicts(cells, boxes, net, names, pair, depth, spec.lo, spec.hi, spec.target)
        else:
            found = ve.verify(verifier, md.flat(meta, names), net, names, spec.lo, spec.hi, spec.target)
        return [r["block_id"] for r in found.where("NOT should_skip").select("block_id").collect()] if blocks <= 100_000 else found.where("NOT should_skip")

    kept = timed("verify_s", judge)
    pruned = timed("pruned_s", lambda: la.read_blocks(table, kept).where(match).count())
    full = timed("full_s", lambda: table.where(match).count())
    n_kept = len(kept) if isinstance(kept, list) else kept.count()
    return {"filter": spec.name, "metadata": kind, "verifier": verifier, "blocks": blocks, "kept": n_kept, "full": full, "pruned": pruned, "equal": full == pruned, **took}
