"""The same operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.columns import canonical_json_text, last_key_counts, text_hash
from ..operators.detection import scan
from ..operators.evidence import KEYS, build_chain
from ..sources.records import EVENT
from ..sources.shared import Epochs, new_path, scratch


def stream_guard(stream: DataFrame, detector: str, text: str = "text") -> DataFrame:
    """A stateless scan of a stream of texts (append mode)."""
    return scan(stream, detector, text)


BUNDLE = "tenant string, env string, bundle_seq long, created_at timestamp"


def sound_bundles(bundles: DataFrame, now: Column | None = None, max_age_hours: int = 72) -> DataFrame:
    """(tenant, env, bundle_seq, created_at, manifest) of bundles (manifest: JSON text, manifest_hash) whose hash is that of
    the canonical manifest, that name all of these, and that are no older than allowed (zero or less: of any age). Broken
    and stale ones are left out."""
    with last_key_counts(bundles.sparkSession):
        rows = bundles.select("manifest", F.from_json("manifest", BUNDLE).alias("m"), (text_hash(canonical_json_text(F.col("manifest"))) == F.col("manifest_hash")).alias("ok"))
    rows = rows.where(F.coalesce("ok", F.lit(False))).select("m.*", "manifest").dropna()
    if max_age_hours <= 0:
        return rows
    return rows.where(F.col("created_at") >= (F.current_timestamp() if now is None else now) - F.expr(f"interval {max_age_hours} hours"))


def with_latest_policies(
    stream: DataFrame, folder: str, path: str, apply: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], now: Column | None = None, max_age_hours: int = 72
) -> DataStreamWriter:
    """A writer whose micro-batches each look into the bundles' folder (JSON lines: manifest, manifest_hash) and apply the
    newest sound bundle of each (tenant, env). Where none is newer, or the newer ones are broken or stale, the last good one
    stays; it is kept under path by the number of the batch, so that a restart goes on with it, and a batch that runs again
    takes the one that it took, or a newer one. Without any good bundle a batch fails."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        epochs = Epochs(spark, f"{path}/held")
        held = epochs.before(epoch)
        found = sound_bundles(spark.read.schema("manifest string, manifest_hash string").json(folder), now, max_age_hours)
        both = found if held is None else found.unionByName(held)
        newest = both.groupBy("tenant", "env").agg(F.max_by(F.struct("bundle_seq", "created_at", "manifest"), "bundle_seq").alias("b"))
        epochs.write(newest.select("tenant", "env", "b.*"), epoch, keep=2)
        policies = epochs.at(epoch)
        if policies.isEmpty():
            raise ValueError(f"no sound bundle in {folder}")
        sink(apply(batch, policies), epoch)

    return stream.writeStream.foreachBatch(each)


def dedup_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stream_rates(stream: DataFrame, keys: list[str], window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    grouped = stream.withWatermark("ts", late).groupBy(*keys, F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("w.end").alias("window_end"), "n", (F.col("n") / seconds).alias("rate"))


def stream_incidents(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    errors = stream.where("verdict = 'ERROR'").withWatermark("ts", late).groupBy("tenant", "app", "guard_id", F.session_window("ts", gap).alias("w"))
    return errors.agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_errors")).drop("w")


def replay(spark: SparkSession, path: str, files_a_batch: int = 50) -> DataFrame:
    """Spooled JSON lines as a stream; the checkpoint makes it at least once, dedup_stream makes that harmless."""
    return spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(path)


def chain_batches(stream: DataFrame, path: str, late: str = "append", delay: str = "0 seconds") -> DataStreamWriter:
    """A writer that chains events as they come. Each micro-batch is a batch like any other: Spark sorts it by (tenant, app,
    ts, event_id) and links it to the heads that the batch before left under path. `append`: late events go to the tail, so
    that nothing is ever linked anew; `drop`: those behind the watermark (the latest time that earlier batches saw, less
    the delay) are left out. Links and heads of a batch are folders of its number, so a batch that runs again replaces its
    own. State is one row for each (tenant, app). The stream needs a checkpoint of its own."""
    if late not in ("append", "drop"):
        raise ValueError(f"late events are appended or dropped, not {late}")

    def link(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        heads = Epochs(spark, f"{path}/heads").before(epoch)
        if late == "drop" and heads is not None:
            seen = heads.agg(F.max("seen").alias("seen")).select((F.col("seen") - F.expr(f"interval {delay}")).alias("seen")).first().seen
            if seen is not None:
                batch = batch.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(seen).cast(batch.schema["ts"].dataType)))
        with scratch(spark):
            Epochs(spark, f"{path}/chain").write(build_chain(batch, heads), epoch)
        linked = Epochs(spark, f"{path}/chain").at(epoch)
        new = linked.groupBy(*KEYS).agg(F.max("chain_seq").alias("chain_seq"), F.max_by("event_hash", "chain_seq").alias("event_hash"), F.max("ts").alias("seen"))
        if heads is not None:
            both = heads.unionByName(new)
            new = both.groupBy(*KEYS).agg(F.max("chain_seq").alias("chain_seq"), F.max_by("event_hash", "chain_seq").alias("event_hash"), F.max("seen").alias("seen"))
        Epochs(spark, f"{path}/heads").write(new, epoch, keep=2)

    return stream.writeStream.foreachBatch(link)


def stream_chain(stream: DataFrame, late: str = "append", delay: str = "0 seconds") -> DataFrame:
    """The chain of all that a stream gives until its source is read."""
    path = new_path(stream.sparkSession, "chain")
    chain_batches(stream, path, late, delay).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start().awaitTermination()
    return Epochs(stream.sparkSession, f"{path}/chain").all()
