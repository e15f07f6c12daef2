"""Streaming forms of the log-shaped jobs. Each shares its core with the batch operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import pages as P


def page_progress(updates: DataFrame) -> DataFrame:
    """Highest status seen per page and the number of updates; works on a table and on a stream (update mode)."""
    return updates.groupBy("page_id").agg(F.max("status_rank").alias("status_rank"), F.count(F.lit(1)).alias("updates"))


def stream_progress(updates: DataFrame, path: str, checkpoint: str):
    """Start the live status query: each epoch writes the pages that changed in it to a folder of its own."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = page_progress(updates).writeStream.outputMode("update").foreachBatch(sink)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_now(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every page."""
    latest = F.max_by(F.struct("status_rank", "updates"), "epoch").alias("s")
    return spark.read.parquet(path).groupBy("page_id").agg(latest).select("page_id", "s.*")


def new_work(pending: DataFrame, stored: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Keys whose set of pending ids changed since the stored signature (or that have none)."""
    now = P.id_signature(pending, keys, id_col)
    before = stored.select(*keys, F.col("signature").alias("__before"))
    return now.join(before, list(keys), "left").where(F.col("__before").isNull() | (F.col("__before") != F.col("signature"))).drop("__before")


def stream_audit(entries: DataFrame, path: str, checkpoint: str):
    """Append audit entries to ``path``, one folder per day; late ones go to the folder of their day.

    Retention is a partition filter on read (``retained``): whole days leave at once and nothing is
    rewritten while the stream runs.
    """
    dated = entries.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    writer = dated.writeStream.outputMode("append").format("parquet").partitionBy("day").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(spark, path: str, days: int = 30) -> DataFrame:
    df = spark.read.parquet(path)
    cutoff = df.agg(F.max("ts")).scalar() - F.expr(f"make_dt_interval({days})")
    return df.where((F.col("ts") > cutoff) & (F.col("day") >= F.to_date(cutoff))).drop("day")
