"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text an Arrow batch is cut into before Python works on it.
SLICE_BYTES = 1_000_000
#: Rows of keys (and numbers) that may be sent to every task; a key with more rows than HEAVY_ROWS is hot.
BROADCAST_ROWS, HEAVY_ROWS = 250_000, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what the context was given.

    Where neither is set, a local session gets a folder of this machine; on a cluster that is an error, as no
    machine's own folder can be read by the others.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and given.isDefined():
        found = given.get().rsplit("/", 1)[0]
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/skipjack-checkpoints"
    if given.isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder of this application that goes when its driver ends."""
    home = f"{shared_dir(spark).rstrip('/')}/skipjack-{spark.sparkContext.applicationId}"
    where, store = _at(spark, home)
    if not store.exists(where):
        store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished phases whose results are already stored."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared store."""
    where, store = _at(spark, path)
    store.delete(where, True)


def write_version(spark: SparkSession, stem: str, version: int, text: str) -> None:
    """The small file stem-version.json, there whole or not at all (written beside and renamed); then older versions go."""
    where, store = _at(spark, f"{stem}-{version:06d}.json")
    beside, _ = _at(spark, f"{stem}.{uuid.uuid4().hex}")
    out = store.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    store.rename(beside, where)
    for k in range(version):
        store.delete(_at(spark, f"{stem}-{k:06d}.json")[0], False)


def read_version(spark: SparkSession, stem: str) -> tuple[int, str] | None:
    """(version, text) of the newest file that write_version left."""
    pattern, store = _at(spark, f"{stem}-*.json")
    found = sorted(str(s.getPath().toString()) for s in store.globStatus(pattern) or [])
    if not found:
        return None
    source = store.open(_at(spark, found[-1])[0])
    text = bytes(source.readAllBytes()).decode()
    source.close()
    return int(found[-1].rsplit("-", 1)[1][:-5]), text


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str = "n", heavy: int = HEAVY_ROWS) -> DataFrame:
    """left joined with right, which is stored, has one row per key and in `weight` the rows of left with that key.

    A small right side is sent to every task. Otherwise keys with more than `heavy` rows (there are at most
    rows / heavy of them) are sent, and only the others are shuffled, so no key gathers in one task.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), keys)
    hot = right.where(F.col(weight) > heavy).drop(weight)
    if hot.isEmpty():
        return left.join(right.drop(weight), keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.drop(weight), keys)
    return cold.unionByName(left.join(F.broadcast(hot), keys))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch so that the texts of a slice take about `limit` bytes; a longer text is a slice of its own."""
    size = batch.column(column).nbytes
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * limit / max(size, 1))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_of(name: str = "text"):
    """Column: the text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
