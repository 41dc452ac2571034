"""Streams: refresh of generations from arriving files, and windowed counts of events (the latter beyond the reference)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators.lifecycle import Generations, refresh
from inkstone.session import scratch_root, written


def merged_chunks(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The current chunks with those of the notices in the batch replaced by the batch's.

    A notice whose rows in the batch all have a null ``chunk_id`` is deleted. Rows repeated in a batch count once;
    of several rows of one id that with the largest digest of its columns holds, whatever their order.
    """
    columns = [c for c in batch.columns if current is None or c in current.columns]
    last = batch.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("r")).select("r.*")
    if current is None:
        return last
    return current.select(columns).join(batch.select("notice_num").distinct(), "notice_num", "left_anti").select(columns).unionByName(last)


def refresh_from_files(spark: SparkSession, folder: str, schema: str, store: Generations, embed, model: str, checkpoint: str, every: str | None = None):
    """Takes the files that arrived since the last run, as upserts of whole notices, into a new generation.

    What arrives says nothing of other notices, so these stay. Without ``every`` the run ends when all files are taken;
    with an interval it goes on, and the running query is returned. A batch is taken again if its cycle failed,
    which changes nothing if it was published already.
    """

    def cycle(batch: DataFrame, _epoch: int) -> None:
        if batch.isEmpty():
            return
        with store.lock():
            now = store.current()
            found = refresh(store, merged_chunks(store.read("chunks", now).drop("digest") if now else None, batch), embed, model)
        if found["outcome"] == "refused":
            raise RuntimeError(f"refusing to delete {found['deleted']} of {found['before']} notices")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    started = spark.readStream.schema(schema).json(folder).writeStream.trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(cycle).start()
    if every:
        return started
    return started.awaitTermination()


def event_windows(spark: SparkSession, root: str, name: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events per type and tumbling window of event time, run as a stream to its end.

    Rows arrive from the table's files; the stream writes the windows it closed to the shared folder. In complete mode
    nothing is late, as a bounded input is read to its end; ``late`` is the watermark of a lasting stream.
    """
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    written(spark, base)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{root}/{name}.parquet*").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = events.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    flat.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{base}/out")
