"""Tables that are read from elsewhere once and kept in the folder that all executors share, and small files there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """df, written: what is asked of it from now on doesn't ask its source again, and every answer is from one reading."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table that land() wrote."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)


def _at(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, files = _at(spark, path)
    return files.exists(found)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The files of a folder as (name, time of change in milliseconds by the clock of the file system); none without it."""
    found, files = _at(spark, path)
    return [(x.getPath().getName(), x.getModificationTime()) for x in files.listStatus(found)] if files.exists(found) else []


def get_text(spark: SparkSession, path: str) -> str:
    found, files = _at(spark, path)
    stream = files.open(found)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, which is there whole or not at all: written beside its place and renamed."""
    found, files = _at(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(found)
    out.write(bytearray(data))
    out.close()
    to, _ = _at(spark, path)
    if files.exists(to):
        files.delete(to, False)
    if not files.rename(found, to):
        raise OSError(f"{path} can't be written")


def remove(spark: SparkSession, path: str) -> None:
    found, files = _at(spark, path)
    files.delete(found, True)
