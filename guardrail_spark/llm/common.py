"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE_WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts at exactly these six characters


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where the session has none, a local session gets one; on
    a cluster that would be another disk on each machine, so there it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. The table goes
    when the session's driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


BATCH = "8m"  # bytes of an Arrow batch: what a task holds in the JVM, on its way and in Python, each


def small_batches(spark: SparkSession) -> None:
    """Lowers Spark's default limit on the bytes of an Arrow batch; whole texts are long, and tasks share an executor.
    A limit that the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_text(
    docs: DataFrame,
    keep: list[str],
    out: list[tuple[str, pa.DataType]],
    start: Callable[[], Callable[[bytes], tuple]],
    text: str = "text",
    end: Callable[[], None] | None = None,
) -> DataFrame:
    """One output row for each input row: the columns `keep`, then what the function that `start` makes in each
    task returns for the row's text as UTF-8 bytes (null: empty). Texts go to Python in Arrow batches, which Spark
    bounds by bytes; a row's result depends on its own text alone, so any task can be run again anywhere. `end` is called
    when a task's rows are done."""
    small_batches(docs.sparkSession)
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string", pa.int32(): "int", pa.binary(): "binary"}
    kinds |= {pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<bigint>"}
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("__text"))
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"`{n}` {kinds[t]}" for n, t in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for b in batches:
            made = [one(x.as_buffer().to_pybytes()) for x in b.column(len(keep))]
            cols = list(zip(*made)) if made else [()] * len(out)
            arrays = [b.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, (_, t) in zip(cols, out)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *(n for n, _ in out)])
        if end:
            end()

    return source.mapInArrow(run, ", ".join(ddl))
