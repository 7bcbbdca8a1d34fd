"""Demand sums kept up to date from a stream: an addition of this engine, on Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _instant(c: str) -> Column:
    """A zone-less timestamp as an instant, read in UTC whatever the session's zone: watermarks need instants, weeks must start at midnight."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"))


def _zoneless(c: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def _sums(rows: DataFrame, width: str) -> DataFrame:
    sums = rows.groupBy("product", F.window("ts", width).alias("w")).agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("y"), F.count("*").alias("n"))
    return sums.select("product", _zoneless("w.start").alias("period_start"), _zoneless("w.end").alias("period_end"), "y", "n")


def _rows(events: DataFrame, product: str, date: str, qty: str) -> DataFrame:
    zoneless = events.select(F.col(product).cast("string").alias("product"), F.col(date).cast("timestamp_ntz").alias("ts"), F.col(qty).cast("double").alias("qty"))
    return zoneless.withColumn("ts", _instant("ts"))


def period_sums(stream: DataFrame, width: str = "7 days", late: str = "2 days", product: str = "event_type", date: str = "ts", qty: str = "value") -> DataFrame:
    """(product, period_start, period_end, y, n): tumbling sums; rows later than the watermark are dropped, finished windows leave the state."""
    return _sums(_rows(stream, product, date, qty).withWatermark("ts", late), width)


def _increment(out: str, width: str):
    """A micro-batch is summed by product and window and written as one table of its own, over whatever an interrupted try has left there."""

    def write(batch: DataFrame, number: int) -> None:
        rows = _rows(batch, "event_type", "ts", "value")
        newest = F.max("ts").alias("newest")
        sums = rows.groupBy("product", F.window("ts", width).alias("w")).agg(F.coalesce(F.sum("qty"), F.lit(0.0)).alias("y"), F.count("*").alias("n"), newest)
        sums.select("product", _zoneless("w.start").alias("period_start"), _zoneless("w.end").alias("period_end"), "y", "n", _zoneless("newest").alias("newest")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def run_available(spark: SparkSession, folder: str, out: str, checkpoint: str, schema, width: str = "7 days", late: str = "2 days") -> DataFrame:
    """Takes in what has come to `folder` since the last run, and returns (product, period_start, period_end, y, n, finished) over all runs.

    Only new files are read: each micro-batch leaves its sums by product and window, and these sums are added up, so that an open window goes on
    where it stood and an event that comes late, however late, still corrects its window. A batch that is tried again replaces its own sums,
    and counts once. finished: the newest event is `late` beyond the window's end; a later correction is still possible.
    An empty folder gives no rows."""
    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(_increment(out, width)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kept = "product string, period_start timestamp_ntz, period_end timestamp_ntz, y double, n long, newest timestamp_ntz"
    try:
        parts = spark.read.schema(f"{kept}, batch long").option("basePath", out).parquet(f"{out}/batch=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        parts = spark.createDataFrame([], kept)
    sums = parts.groupBy("product", "period_start", "period_end").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    newest = parts.agg(F.max("newest").alias("newest"))  # one row
    finished = F.coalesce(F.col("period_end") + F.expr(f"INTERVAL {late}") <= F.col("newest"), F.lit(False))
    return sums.crossJoin(F.broadcast(newest)).withColumn("finished", finished).drop("newest")
