"""What several operators share: tables in the shared folder, running totals that no single task holds, blocks of bounded size."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are what lies between these six characters.
WORD = r"[^\x20\x09-\x0D]+"


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


_open: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables of written() made inside are deleted at the end, but for those made with keep."""
    _open.append([])
    try:
        yield
    finally:
        for made in _open.pop():
            dropped(made)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: computed once, with its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _open and not keep:
        _open[-1].append(out)
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes a table of written() that nothing will read again."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A broadcast table of digests of ids holds this many rows at most.
BUCKETS = 1 << 20


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose id may be among ids, rows whose id is not), without a shuffle of df: digests of ids, BUCKETS at most, are broadcast.

    Of ids many times more than BUCKETS every row may be one; what follows must sort that out. Null is an id like others."""
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(BUCKETS)).cast("int")
    taken = F.broadcast(written(ids.select(bucket.alias("_bucket")).distinct()))
    return df.join(taken, bucket == F.col("_bucket"), "left_semi"), df.join(taken, bucket == F.col("_bucket"), "left_anti")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores put before it that df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_digits(rows: int, rows_per_bucket: int = 20_000) -> int:
    """So many leading hexadecimal digits of a digest cut rows into buckets of at most about rows_per_bucket."""
    return max(0, math.ceil(math.log(max(1, rows / rows_per_bucket), 16)))


def running(df: DataFrame, by: list[str], bucket: str, order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """Adds, for each (value column: new column), the sum of value over the earlier rows of the same `by`, ordered by bucket, then `order`.

    Only the rows of one (by, bucket) meet in a task: bucket sums are added up first, over a table with a row for each bucket.
    bucket must follow the same order as `order`; `by` and bucket hold no nulls."""
    keys = [*by, bucket]
    sums = df.groupBy(*keys).agg(*(F.sum(v).alias(f"_sum_{n}") for v, n in values.items()))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in values.values()))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, keys)
    for v, n in values.items():
        out = out.withColumn(n, F.col(f"_off_{n}") + F.coalesce(F.sum(v).over(within), F.lit(0)))
    return out.drop(*(f"_off_{n}" for n in values.values()))
