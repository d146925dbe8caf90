"""A log of changes kept as a table of latest states, batch by batch, and counts of a log by time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; counted before the shuffle, so a hot key sends one row from each task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def follow(spark: SparkSession, source: str, schema, key: str, order: tuple[str, ...], out: str) -> DataFrame:
    """Reads what is new in ``source`` (parquet) and keeps in ``out`` the latest row of each key; returns that table.

    Each batch writes a whole new state under its number and is only then pointed to by the checkpoint, so a batch that is run again writes
    the same state again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        state = latest(batch, key, *order)
        if number:
            state = latest(spark.read.schema(state.schema).parquet(f"{out}/state/{number - 1}").unionByName(state), key, *order)
        state.write.mode("overwrite").parquet(f"{out}/state/{number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    # The progress folder knows the batches that are done, also where this run had none of its own.
    done = spark.read.format("binaryFile").load(f"{out}/progress/commits").select(F.regexp_extract("path", r"/(\d+)\z", 1).alias("n")).where("n <> ''")
    number = done.agg(F.max(F.col("n").cast("bigint")).alias("n")).first()["n"]
    return spark.read.schema(schema).parquet(f"{out}/state/{number}")


def windowed(log: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each kind in each time window; on a stream, windows close ``late`` after they end."""
    own = log.withWatermark(time, late) if log.isStreaming else log
    return own.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def new_folder(base: str) -> str:
    return f"{base}/stream-{uuid.uuid4().hex}"
