"""Row ids, fixed-size blocks and block predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "row_id"
#: Above this many ids a block set is joined instead of listed.
MAX_LISTED = 200


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Load a table with a dense 0-based row_id.

    One file: the file's own row position. Several files: positions are offset by the files' row counts in path order, a small table
    with one row per file.
    """
    source = spark.read.format(fmt).options(**options).load(path)
    plain = source.select("*", F.col("_metadata.row_index").alias(ROW_ID), F.col("_metadata.file_path").alias("_file")) if fmt == "parquet" else None
    if plain is None:
        raise ValueError("row positions need Parquet; convert other formats with to_parquet first")
    if len(source.inputFiles()) == 1:
        return plain.drop("_file")
    from pyspark.sql import Window

    sizes = plain.groupBy("_file").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return plain.join(first.select("_file", "_first"), "_file").withColumn(ROW_ID, F.col(ROW_ID) + F.col("_first")).drop("_file", "_first")


def to_parquet(spark: SparkSession, csv: str | list[str], out: str, schema=None) -> None:
    """CSV with a header to Parquet, once."""
    reader = spark.read.option("header", True)
    (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(csv).write.mode("overwrite").parquet(out)


def load_csv(spark: SparkSession, csv: str | list[str], out: str, schema=None) -> DataFrame:
    """CSV files (one or many parts) as a table with row ids: converted once, rows in order of the parts."""
    to_parquet(spark, csv, out, schema)
    return read_table(spark, out)


def ensure_row_ids(df: DataFrame, path: str) -> DataFrame:
    """df if its row ids are dense from 0; otherwise the table stored at path with new ones, in the order of the old."""
    if check_row_ids(df):
        return df
    df.withColumnRenamed(ROW_ID, "old_row_id").sort("old_row_id").drop("old_row_id").write.parquet(path)
    return read_table(df.sparkSession, path)


def check_row_ids(df: DataFrame) -> bool:
    """Ids start at 0 and are dense (an empty table passes)."""
    low, high, n = df.agg(F.min(ROW_ID), F.max(ROW_ID), F.count("*")).first()
    return n == 0 or (low == 0 and high == n - 1)


def quoted(name: str) -> str:
    """A column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def block_of(size: int) -> Column:
    return F.floor(F.col(ROW_ID) / size).cast("long")


def with_block_id(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("block_id", block_of(size))


def block_range(block: int, size: int) -> Column:
    return F.col(ROW_ID).between(block * size, (block + 1) * size - 1)


def block_set(blocks, size: int) -> Column:
    """Rows of a listed set of blocks; an empty set matches nothing."""
    return block_of(size).isin(list(blocks)) if blocks else F.lit(False)


def in_blocks(df: DataFrame, kept: DataFrame | list[int], size: int) -> DataFrame:
    """Restrict to blocks: a list up to MAX_LISTED as a predicate, otherwise a semi join."""
    if isinstance(kept, list):
        if len(kept) <= MAX_LISTED:
            return df.where(block_set(kept, size))
        kept = df.sparkSession.createDataFrame([(b,) for b in kept], "block_id long")
    return with_block_id(df, size).join(kept.select("block_id"), "block_id", "left_semi")


def blocks_for_budget(rows: int, size: int) -> int:
    """Blocks that a row budget pays for."""
    return math.ceil(rows / size)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid(features: list[str], target: str | None = None, num_classes: int | None = None) -> Column:
    """Rows a model can be applied to (and learnt from)."""
    out = F.lit(True)
    for c in [*features, *([target] if target else [])]:
        out = out & finite(F.expr(c).cast("double"))
    if target and num_classes:
        out = out & (F.expr(target) >= 0) & (F.expr(target) < num_classes)
    return out


def training_set(df: DataFrame, features: dict[str, str], target: str, limit: int, num_classes: int | None = None, blocks: list[int] | None = None, size: int = 1000) -> DataFrame:
    """Feature and target columns of the first valid rows by row_id."""
    rows = df if blocks is None else df.where(block_set(blocks, size))
    kind = F.round(F.expr(target)).cast("int") if num_classes else F.expr(target).cast("double")
    return rows.where(valid(list(features.values()), target, num_classes)).orderBy(ROW_ID).limit(limit).select(ROW_ID, *[F.expr(e).cast("double").alias(n) for n, e in features.items()], kind.alias("target"))


def block_points(df: DataFrame, features: dict[str, str], size: int) -> DataFrame:
    """row_id, block_id and the features of valid rows."""
    return with_block_id(df, size).where(valid(list(features.values()))).select(ROW_ID, "block_id", *[F.expr(e).cast("double").alias(n) for n, e in features.items()])
