"""Pruned counts, ground truth, inspection and effectiveness."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipjack.functions.mlp import Mlp
from skipjack.operators.rows import ROW_ID, in_blocks, with_block_id


def pruned_count(table: DataFrame, kept: DataFrame | list[int], match: Column, size: int) -> DataFrame:
    """COUNT(*) of matching rows on the kept blocks."""
    return in_blocks(table, kept, size).where(match).agg(F.count("*").alias("n"))


def ground_truth(table: DataFrame, matches: dict[str, Column], size: int) -> DataFrame:
    """One scan, many predicates: per filter the qualified rows and the blocks that hold one."""
    block = with_block_id(table, size)
    per = block.groupBy("block_id").agg(*[F.sum(F.when(m, 1).otherwise(0)).cast("long").alias(n) for n, m in matches.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in matches)
    return per.selectExpr("block_id", f"stack({len(matches)}, {stack}) AS (filter, n_rows)")


def truth_summary(truth: DataFrame) -> DataFrame:
    return truth.groupBy("filter").agg(F.sum("n_rows").alias("n_rows"), F.sum((F.col("n_rows") > 0).cast("int")).cast("long").alias("n_blocks"))


def cache_key(table: str, net: Mlp, size: int, predicate: str, version: str = "", blocks: list[int] | None = None) -> str:
    """Content hash: another model, table content (version: storage.fingerprint) or set of blocks has another key."""
    return hashlib.sha1(json.dumps([table, version, net.to_json(), size, predicate, None if blocks is None else sorted(blocks)]).encode()).hexdigest()[:24]


class TruthCache:
    """Qualifications by key as Parquet; an entry counts only if its row count is the table's."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def write(self, key: str, table: DataFrame, match: Column) -> None:
        table.select(ROW_ID, F.coalesce(match, F.lit(False)).alias("qualifies")).write.mode("overwrite").parquet(f"{self.path}/cache_key={key}")

    def read(self, key: str, rows: int) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.parquet(f"{self.path}/cache_key={key}")
        except AnalysisException:
            return None
        return found if found.count() == rows else None


def qualified_per_block(cached: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Qualified rows of each listed block, zero where there are none."""
    n = with_block_id(cached.where("qualifies"), size).groupBy("block_id").agg(F.count("*").alias("n"))
    return blocks.select("block_id").join(n, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


def inspect_block(table: DataFrame, meta: DataFrame, verdicts: DataFrame, match: Column, block: int, size: int, training_rows: int = 0) -> DataFrame:
    """One block's metadata and verdict beside its own count; blocks of the training prefix are refused."""
    if block * size < training_rows:
        raise ValueError(f"block {block} holds training rows")
    n = with_block_id(table, size).where(F.col("block_id") == block).groupBy("block_id").agg(F.count("*").alias("rows_in_block"), F.sum(match.cast("int")).cast("long").alias("matching"))
    return meta.where(F.col("block_id") == block).join(verdicts, "block_id").join(n, "block_id")


def evaluation(meta: DataFrame, verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per block: verdict, matching rows (truth: block_id, n_rows), whether the verdict was right to skip."""
    joined = meta.select("block_id").join(verdicts, "block_id").join(truth, "block_id", "left")
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return joined.select("block_id", "should_skip", n.alias("matching"), (F.col("should_skip") & (n > 0)).alias("false_skip"))


def effectiveness(skipped: Column, skippable: Column) -> Column:
    """Per cent of the skippable blocks that were skipped; nothing to skip counts as 100."""
    return F.when(skippable == 0, F.lit(100.0)).otherwise(100.0 * skipped / skippable)


def inference_verdicts(table: DataFrame, match: Column, size: int) -> DataFrame:
    """The exact oracle: a block is skipped if none of its rows qualifies."""
    return with_block_id(table, size).groupBy("block_id").agg((~F.coalesce(F.bool_or(match), F.lit(False))).alias("should_skip"))


#: Edges of the selectivity bins in per cent; zero has a bin of its own.
EDGES = (0.0, 1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0)


def selectivity_bins(results: DataFrame) -> DataFrame:
    """results(selectivity, pruning) -> bin, n, mean and exact median of pruning; rows without either are left out."""
    s = F.col("selectivity")
    label = F.when(s == 0, F.lit("= 0"))
    for a, b in zip(EDGES, EDGES[1:], strict=False):
        last = b == EDGES[-1]
        label = label.when((s >= a) & ((s <= b) if last else (s < b)), F.lit(f"{a:g}-{b:g}"))
    return results.where("selectivity is not null and pruning is not null").groupBy(label.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("pruning"), 6).alias("mean"), F.round(F.median("pruning"), 6).alias("median"))
