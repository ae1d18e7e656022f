"""Tables laid out by block, so that kept blocks become filters that reach the Parquet scan.

Rows are written in order of their block id. Three levels prune, each by what Spark and Parquet do on their own:
folders by ``block_group`` (partition pruning, static or dynamic), row groups by the statistics of ``block_id``, and pages, which are held to the
rows of one block, by the column index. A table may be clustered first: sorted by the columns that predicates go by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skipjack.operators.rows import ROW_ID, block_of, read_table
from skipjack.storage import exists, fingerprint, remove, scratch, stored

#: Blocks of a folder; ranges of block ids listed in one filter, beyond which the kept blocks are joined.
GROUP, MAX_RANGES = 1000, 400


def clustered(df: DataFrame, by: list[str], path: str) -> DataFrame:
    """df in order of the columns `by` (ties by row_id), with dense new row ids; stored at path."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*by, "source_row"]
    moved = df.withColumnRenamed(ROW_ID, "source_row")
    moved.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(path)
    return read_table(df.sparkSession, path)


def lay_out(df: DataFrame, path: str, size: int, group: int = GROUP) -> DataFrame:
    """Write df (with row_id) by block; returns the table as read back."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = df.withColumn("block_id", block_of(size)).withColumn("block_group", F.floor(F.col("block_id") / group).cast("int"))
    ordered = numbered.repartitionByRange(n, "block_id").sortWithinPartitions("block_group", "block_id", ROW_ID)
    ordered.write.option("parquet.page.row.count.limit", size).partitionBy("block_group").parquet(path)
    return spark.read.parquet(path)


def ranges(blocks: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive ids."""
    out: list[tuple[int, int]] = []
    for b in sorted(set(blocks)):
        if out and b == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return out


def block_filter(blocks: list[int], group: int = GROUP) -> Column:
    """Folders and block ids of the kept blocks; none matches nothing."""
    if not blocks:
        return F.lit(False)
    spans = reduce(lambda a, b: a | b, [F.col("block_id").between(a, z) for a, z in ranges(blocks)])
    return F.col("block_group").isin(sorted({b // group for b in blocks})) & spans


def read_blocks(table: DataFrame, kept: DataFrame | list[int], group: int = GROUP) -> DataFrame:
    """The rows of a laid-out table's kept blocks. kept: ids, or a frame with block_id.

    Up to MAX_RANGES runs of ids become a filter that the scan pushes down; more are stored and joined by folder and block, where
    the folders are pruned while the query runs.
    """
    if not isinstance(kept, list):
        # At most MAX_RANGES runs come to the driver.
        starts = kept.select("block_id").distinct().withColumn("run", F.col("block_id") - F.row_number().over(_by_group(group)))
        runs = starts.groupBy(F.floor(F.col("block_id") / group).alias("g"), "run").agg(F.min("block_id").alias("a"), F.max("block_id").alias("z"))
        found = runs.select("a", "z").limit(MAX_RANGES + 1).collect()
        if len(found) > MAX_RANGES:
            side = stored(kept.select("block_id", F.floor(F.col("block_id") / group).cast("int").alias("block_group")).distinct(), "kept-blocks")
            return table.join(side, ["block_group", "block_id"], "left_semi")
        kept = [b for r in found for b in range(r["a"], r["z"] + 1)]
    if len(ranges(kept)) > MAX_RANGES:
        return read_blocks(table, table.sparkSession.createDataFrame([(b,) for b in kept], "block_id long"), group)
    return table.where(block_filter(kept, group))


def _by_group(group: int):
    from pyspark.sql import Window

    return Window.partitionBy(F.floor(F.col("block_id") / group)).orderBy("block_id")


_made: dict[tuple, str] = {}


def kept_layout(spark: SparkSession, source: str, size: int, by: list[str]) -> DataFrame:
    """The table at `source`, clustered and laid out; made once per application and content of the source."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, source), size, tuple(by))
    if key not in _made or not exists(spark, _made[key]):
        first, path = scratch(spark, "clustered"), scratch(spark, "laid-out")
        lay_out(clustered(read_table(spark, source), by, first), path, size)
        remove(spark, first)
        _made[key] = path
    return spark.read.parquet(_made[key])
