"""Comparing the rows of a key with each other when a key may hold any share of all rows: blocks of bounded size, and pairs of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def large_keys(df: DataFrame, key: str, rows_per_block: int) -> DataFrame:
    """(key, parts): the keys of more than rows_per_block rows, and into how many blocks each is cut."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_block)
    return written(counts.select(key, F.ceil(F.col("_n") / F.lit(rows_per_block)).cast("int").alias("parts")))


def block_of(df: DataFrame, key: str, id_col: str, large: DataFrame) -> DataFrame:
    """df with block (0 to parts - 1, by a digest of the id) and parts (1 unless the key is large)."""
    met = df.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return met.withColumn("block", F.pmod(F.xxhash64(F.lit(7), id_col), F.col("parts")).cast("int"))


def paired(blocks: DataFrame, large: DataFrame, key: str, steps: list[int], payload: list[str]) -> DataFrame:
    """Pairs of blocks (left_*, right_*): each block with itself and the others of its key, and with the blocks of key + step for the other steps.

    A block meets itself where it is. For every other block that it meets it goes out once; the two meet under a key of their own, so
    that no key gathers more than two blocks."""
    parts = large.select(F.col(key).alias("_to"), F.col("parts").alias("_to_parts"))
    own = blocks.select(key, "block", "parts", F.struct(*payload).alias("_has"))
    outgoing = own.where("parts > 1") if steps == [0] else own

    def sent(sign: int) -> DataFrame:
        out = outgoing.withColumn("_to", F.explode(F.array(*(F.col(key) + F.lit(sign * s) for s in steps)).cast("array<long>")))
        return out.join(parts, "_to", "left").withColumn("_to_block", F.explode(F.sequence(F.lit(0), F.coalesce("_to_parts", F.lit(1)) - 1)))

    def once(mine: Column, other: Column, same: Column) -> Column:
        return ~same | (mine < other)

    left = sent(1).where(once(F.col("block"), F.col("_to_block"), F.col(key) == F.col("_to")))
    right = sent(-1).where(once(F.col("_to_block"), F.col("block"), F.col(key) == F.col("_to")))
    left = left.select(F.col(key).alias("_a"), F.col("block").alias("_i"), F.col("_to").alias("_b"), F.col("_to_block").alias("_j"), F.col("_has").alias("left"))
    right = right.select(F.col("_to").alias("_a"), F.col("_to_block").alias("_i"), F.col(key).alias("_b"), F.col("block").alias("_j"), F.col("_has").alias("right"))
    alone = own.select(F.col("_has").alias("left"), F.col("_has").alias("right"), F.lit(True).alias("same"))
    return alone.unionByName(left.join(right, ["_a", "_i", "_b", "_j"]).select("left", "right", F.lit(False).alias("same")))
