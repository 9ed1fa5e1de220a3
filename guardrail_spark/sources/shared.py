"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_paths: ContextVar[list | None] = ContextVar("paths", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The paths that are made in it are gone at its end."""
    made: list[str] = []
    token = _paths.set(made)
    try:
        yield
    finally:
        _paths.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under spark.checkpoint.dir, gone when the driver ends. Where the session has no such folder, a
    local session gets one; on a cluster each machine would see its own disk, so there it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{jsc.getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    made = _paths.get()
    if made is not None:
        made.append(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side that may be broadcast once they are counted, and parts of a key that meet a larger one.
MOST_BROADCAST, SALTS = 100_000, 16


def meet(rows: DataFrame, known: DataFrame, keys: list[str], n_known: int, how: str = "inner") -> DataFrame:
    """rows joined to known (n_known rows, counted) by keys, where a key may hold a large part of the rows. A known side of
    a bounded number of rows is broadcast, and rows stay where they are; a larger one is copied SALTS times, each copy for
    a part of each key's rows."""
    if n_known <= MOST_BROADCAST:
        return rows.join(F.broadcast(known), keys, how)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]), F.lit(SALTS)).alias("__part")
    copies = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__part"))
    return rows.select("*", part).join(copies, [*keys, "__part"], how).drop("__part")


class Epochs:
    """Parquet folders of a stream's micro-batches by their numbers: a batch that runs again replaces its own folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, epoch: int):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/__epoch={epoch}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, epoch: int, keep: int | None = None) -> None:
        """Writes a batch's rows; of folders that a later batch no longer reads, the last `keep` stay."""
        rows.write.mode("overwrite").parquet(f"{self.path}/__epoch={epoch}")
        if keep and epoch >= keep:
            at, files = self._folder(epoch - keep)
            files.delete(at, True)

    def at(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/__epoch={epoch}")

    def before(self, epoch: int) -> DataFrame | None:
        """What the batch before wrote, or None for the first."""
        at, files = self._folder(epoch - 1)
        return self.at(epoch - 1) if files.exists(at) else None

    def all(self, schema: str | None = None) -> DataFrame:
        """The rows of all batches; with a schema, also where there was no batch."""
        at, files = self._folder(0)
        if schema and not files.exists(at):
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.path).drop("__epoch")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read: each batch goes to a folder of its epoch, which a retry replaces;
    `complete` ones replace each other. A stream that had no batch gives no rows."""
    path = new_path(stream.sparkSession, "stream")
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{path}/out/__epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/__epoch={0 if mode == 'complete' else epoch}")

    return _run(stream, mode, path, write).read.schema(stream.schema).parquet(f"{path}/out").select(*[F.col(f"`{c}`") for c in stream.columns])


def _run(stream: DataFrame, mode: str, path: str, write: Callable[[DataFrame, int], None]) -> SparkSession:
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession
