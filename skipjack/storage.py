"""Folders that all executors share: scratch paths, stored tables, small files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def at(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = at(spark, path)
    return bool(store.exists(where))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder of this application that goes when its driver ends."""
    home = f"{shared_dir(spark).rstrip('/')}/skipjack-{spark.sparkContext.applicationId}"
    where, store = at(spark, home)
    if not store.exists(where):
        store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared store."""
    where, store = at(spark, path)
    store.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside and renamed; an older one goes first."""
    where, store = at(spark, path)
    beside, _ = at(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(where):
        store.delete(where, False)
    store.rename(beside, where)


def read_text(spark: SparkSession, path: str) -> str:
    where, store = at(spark, path)
    source = store.open(where)
    text = bytes(source.readAllBytes()).decode()
    source.close()
    return text


def fingerprint(spark: SparkSession, path: str) -> str:
    """Path, length and time of change of every file of a table: another content has another fingerprint."""
    import hashlib

    where, store = at(spark, path)
    files = store.listStatus(where) if store.getFileStatus(where).isDirectory() else [store.getFileStatus(where)]
    seen = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha1(repr(seen).encode()).hexdigest()
