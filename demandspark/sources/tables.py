"""Sources and sinks: CSV and Parquet tables, side files, JSON rows, tables written between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """An upload with a header; without a schema all columns are text, to be typed by intake."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_side_series(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """(date, columns) of a side file, unreadable cells NULL; None if the file or its date column is missing."""
    try:
        raw = read_csv(spark, path)
        if "date" not in raw.columns:
            return None
    except AnalysisException:
        return None
    have = [c for c in columns if c in raw.columns]
    return raw.select(F.try_to_timestamp("date").cast("date").alias("date"), *(F.col(c).try_cast("double").alias(c) for c in have)).where("date IS NOT NULL")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Header, no index; one file for reports that are known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each row: dates as ISO text, NaN and infinities as null, null fields kept."""
    safe = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        safe.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. On one machine (a local master) it is set to a temporary folder
    where it is unset; on a cluster that raises, since executors could not read such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def with_ordinal(df: DataFrame, name: str = "_row") -> DataFrame:
    """df, as read from files and not yet changed, with each row's place (from 0) in the order of file name, then of the file's rows; written.

    A split is read from its start to its end, so that counts by split, added up in the order of splits, give every row its place: one
    window over as many rows as there are splits, and no sort of the rows."""
    held = ["_file", "_start", "_id"]
    rows = df.select("*", F.col("_metadata.file_path").alias(held[0]), F.col("_metadata.file_block_start").alias(held[1]), F.monotonically_increasing_id().alias(held[2]))
    rows = materialized(rows)
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    places = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_least")).alias("_shift"))
    return rows.join(places, ["_file", "_start"]).select(*(f"`{c}`" for c in df.columns), (F.col("_id") + F.col("_shift")).alias(name))


def head_and_sample(rows: DataFrame, ordinal: str, head: int, size: int, seed: int = 0) -> DataFrame:
    """At most `size` rows: the first `head`, and of the rest those with the smallest digests of seed and ordinal. All rows if there are no more.

    Reruns agree. The rest is cut to `size` rows by each task before anything is shuffled."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ordinal).cast("string")).cast("binary"))
    ranked = rows.withColumn("_digest", F.when(F.col(ordinal) < head, F.lit("")).otherwise(digest))
    return ranked.orderBy("_digest", ordinal).limit(size).drop("_digest")


def materialized(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, its lineage cut.

    by: a column that the rows of df are dealt by, as after a window or spread(). The table keeps them so, in buckets: what groups, orders or
    joins by it shuffles none of its rows again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        # only a named table can have buckets; the name is given up once the files are known
        name, writers = f"spark_catalog.default.kept_{path.rpartition('/')[2]}", spark.conf.get(WRITERS)
        try:
            spark.conf.set(WRITERS, 16)  # a task has few buckets: their files are open at once, so that it need not order its rows by bucket
            df.write.option("path", path).bucketBy(buckets(df), by).saveAsTable(name, format="parquet")
        finally:
            spark.conf.set(WRITERS, writers)
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    out._written_at, out._dealt_by = path, by
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder as plain rows, its plan cut: what iterates over it in many jobs sends no plan with each."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def side_by_side(spark: SparkSession, jobs: list[Callable[[], Any]], parallel: int = 4) -> list[Any]:
    """What each of jobs returns, `parallel` of them at a time: jobs that don't wait for each other leave no core idle at their ends. The first
    that raises, in their order, raises here."""
    with ThreadPoolExecutor(parallel) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Of the files that a table is made of, how many bytes a task takes that holds rows by key.
TASK_BYTES = 8 << 20


def file_bytes(df: DataFrame) -> int:
    """Size of the files behind df, 0 if it is made of none."""
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(f)) for f in df.inputFiles()]  # names, no patterns
    return paths and df.sparkSession.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0  # of the listing, no content is read


def spread(df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """df shuffled by key into tasks whose number grows with the files behind it (or behind `source`), so that what a task orders stays the same at
    every size. Tables of fewer than TASK_BYTES for each of the session's tasks, or made of no files, are left to AQE."""
    tasks = -(-file_bytes(source or df) // TASK_BYTES)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def buckets(df: DataFrame) -> int:
    """Into how many buckets df is written: two for each task of spread(), so that a task writes two files and those who read them have room for the gaps
    that a panel fills. Of a table left to AQE two for each core, where each gets an eighth of TASK_BYTES; not more than AQE has parts."""
    conf, cores, size = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism, file_bytes(df)
    tasks, small = -(-size // TASK_BYTES), -(-size // max(1, TASK_BYTES // 8))
    if tasks > cores:
        return min(2 * tasks, int(conf.get("spark.sql.sources.bucketing.maxBuckets")))
    return max(1, min(max(2 * tasks, min(2 * cores, small)), int(conf.get("spark.sql.shuffle.partitions"))))


def spread_again(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """As spread, for columns df of a table of materialized() whose rows have lost their dealing. Those of other tables keep theirs."""
    return spread(df, key, table) if getattr(table, "_written_at", None) and getattr(table, "_dealt_by", None) != key else df


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame | None) -> None:
    """Deletes a table of materialized() that nothing will read again."""
    path = getattr(df, "_written_at", None)
    if path:
        drop_path(df.sparkSession, path)
