"""Exports: metadata, ground truth and results as JSON; compiled cells as Parquet; newest result per series."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skipjack import storage
from skipjack.functions.mlp import Mlp
from skipjack.plans.decompose import Compiled, compile_network, compiled, tables


def export_metadata(meta: DataFrame, root: str, table: str, model: str, kind: str) -> str:
    path = f"{root}/{table}/{model}/{kind}-metadata"
    meta.write.mode("overwrite").json(path)
    return path


def export_truth(truth: DataFrame, root: str, table: str, model: str) -> str:
    """Per filter and block the matching rows, one folder per filter."""
    path = f"{root}/{table}/{model}/filters"
    truth.write.mode("overwrite").partitionBy("filter").json(path)
    return path


def write_result(result: dict, root: str | Path, label: str) -> Path:
    """One result file, named by its label and a digest of its content."""
    text = json.dumps(result, sort_keys=True)
    path = Path(root) / f"{label}-{hashlib.sha1(text.encode()).hexdigest()[:12]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def newest_results(spark: SparkSession, root: str) -> DataFrame:
    """The latest result of each (backend, metadata) series."""
    rows = spark.read.json(root).withColumn("_file", F.input_file_name())
    order = Window.partitionBy("backend", "metadata").orderBy(F.col("finished").desc(), F.col("_file").desc())
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_file")


def drop_stale(folder: str | Path, stem: str, keep: str) -> list[Path]:
    """Remove generated files of the same stem with another digest."""
    gone = [p for p in sorted(Path(folder).glob(f"{stem}-*.json")) if p.name != f"{stem}-{keep}.json"]
    for p in gone:
        p.unlink()
    return gone


def write_compiled(spark: SparkSession, net: Mlp, path: str) -> dict:
    """Compile a network and write its tables (a folder per dimension, functions, leaves) and the times and sizes; returns the latter."""
    began = time.perf_counter()
    pieces = compile_network(net)
    own = compiled(pieces)
    done = time.perf_counter()
    cells, functions, leaves = tables(spark, own)
    for k, df in enumerate(cells, 1):
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/cell_dim{k}")
    functions.coalesce(1).write.mode("overwrite").parquet(f"{path}/component_function")
    leaves.coalesce(1).write.mode("overwrite").parquet(f"{path}/leaf_function")
    sizes = {"dims": len(cells), "cells": [len(d) for d in own.dims], "functions": len(own.functions), "compile_ms": round(1000 * (done - began), 3), "write_ms": round(1000 * (time.perf_counter() - done), 3)}
    storage.write_text(spark, f"{path}/metrics.json", json.dumps(sizes))
    return sizes


def read_compiled(spark: SparkSession, path: str) -> Compiled:
    """The tables of a compiled network; they are a model's and fit the driver."""
    if not storage.exists(spark, f"{path}/metrics.json"):
        raise FileNotFoundError(f"no compiled model at {path}")
    n = json.loads(storage.read_text(spark, f"{path}/metrics.json"))["dims"]
    rows = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{path}/{name}").orderBy(key).collect()]
    return Compiled([rows(f"cell_dim{k}", f"id{k}") for k in range(1, n + 1)], rows("component_function", "function_id"), rows("leaf_function", f"id{n}"))
