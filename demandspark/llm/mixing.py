"""Mixing sources to target weights by a low-discrepancy schedule.

All words of a source, its documents in shuffled order and the stream repeated up to `most` times, are cut into blocks of equal words,
as many as its target needs. Slot i of the schedule takes the golden-ratio point frac(i / phi) through the cumulative numbers of blocks to
a source; the slots of a source are ranked, and slot rank r is joined with block r of the source's stream. At every point of the schedule
each source is within a few blocks of its share. Points fall a few short of some sources and beyond others: the former get late slots
after the last one, the slots beyond a source's blocks are empty. So every source gives its target to the word, however small it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, hex_digits, running, written

#: The golden ratio's fraction in 64 bits: points are exact integers, so that no share gets too small for them however many slots there are.
GOLDEN, WHOLE = 11400714819323198485, 1 << 64
#: Words of a block, at every corpus size.
BLOCK = 1024
CHUNK = 4096
CELLS = 1024
#: About how many documents a running total sees in one task.
ROWS = 2000


@dataclass(frozen=True)
class Mix:
    """plan: a row for each source. documents: a row for each document, with its place in its source's stream. schedule: a row for each
    stretch of a document in a slot: slot, source_rank, block, the document's key, from_word, words."""

    plan: DataFrame
    documents: DataFrame
    schedule: DataFrame


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes(source, size) -> source, source_size, source_rank, weight, target.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at `most` times its
    source's size and the excess goes to the others by weight, until none is above: target = min(most * size, level * weight), where the
    level is found over the sources ordered by most * size / weight. One row for each source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_rank", F.lit(len(weights))) + 1).cast("long"))
    s = s.withColumns({"_cap": F.col("source_size") * most, "_ratio": F.col("source_size") * most / F.col("weight")})
    by_ratio = Window.orderBy("_ratio", "source_rank")
    s = s.withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("_below", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_below")) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_rank", "_level"))).over(Window.partitionBy())["_level"])
    target = F.when(F.col("_first").isNull() | (F.col("_ratio") < F.col("_first")), F.col("_cap").cast("double")).otherwise(F.col("_first") * F.col("weight"))
    return s.select("source", "source_size", "source_rank", "weight", target.alias("target"))


def _slots(plan: DataFrame, words: int) -> DataFrame:
    """(source_rank, block, slot, whole): every block of every source once, in the order of the schedule."""
    ends = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, 0)
    bounds = plan.select("source_rank", F.floor("target").alias("whole"), F.ceil(F.floor("target") / F.lit(words)).alias("blocks"))
    bounds = written(bounds.withColumn("high", F.sum("blocks").over(ends)).withColumn("low", F.col("high") - F.col("blocks")))
    total, sources = bounds.agg(F.max("high"), F.count("*")).first()
    total = total or 0
    cell = lambda c: F.floor(c * CELLS / F.lit(float(max(1, total))))
    ranges = bounds.where("blocks > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = plan.sparkSession.range(total).select(F.col("id").alias("slot"), F.expr(f"(((CAST(id AS DECIMAL(20, 0)) * {GOLDEN}BD) % {WHOLE}BD) * CAST({total} AS DECIMAL(15, 0))) div {WHOLE}BD").alias("point"))
    fallen = points.withColumn("cell", cell(F.col("point"))).join(ranges, "cell").where("point >= low AND point < high")
    fallen = fallen.select("source_rank", "whole", "blocks", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).alias("one"))
    ranked = written(running(fallen, ["source_rank"], "chunk", ["slot"], {"one": "block"}))
    had = ranked.groupBy("source_rank").agg(F.count("*").alias("had"))
    short = bounds.join(had, "source_rank", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
    late = short.withColumn("block", F.explode(F.sequence("had", F.col("blocks") - 1)))
    late = late.withColumn("slot", F.lit(total) + (F.col("block") - F.col("had")) * F.lit(sources) + F.col("source_rank"))
    held = ["source_rank", "block", "slot", "whole"]
    return ranked.where("block < blocks").select(*held).unionByName(late.select(*held))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, words: int = BLOCK, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> Mix:
    """The mix of docs. Size: words of the text (null and empty: 0); such documents are in `documents` and take no slot.

    A source's stream takes its documents by md5(seed, id), repeated rows one after the other, so that reruns agree; it ends at its
    target. key_col, if given, is carried as `row_key` through documents and schedule. A slot is a block of `words` words of one source (its last
    one may be shorter), so that slots grow with the corpus. Very long texts lie in many blocks. An empty table gives no rows."""
    carried = ["row_key"] if key_col else []
    size = F.when(F.length(text_col) > 0, F.regexp_count(text_col, F.lit(WORD))).otherwise(0).cast("long")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0).cast("long")).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("key"), *([F.col(key_col).alias("row_key")] if key_col else []))
    slim = written(slim)
    plan = written(source_plan(slim, weights, most))
    digits = hex_digits(slim.count(), ROWS)
    named = slim.join(plan.select("source", "source_rank", "source_size", "target").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    named = named.withColumns({"bucket": F.substring("key", 1, digits) if digits else F.lit(""), "one": F.lit(1)})
    placed = running(named, ["source_rank"], "bucket", ["key", "doc_id", "size", *carried], {"size": "start", "one": "row"})
    placed = written(placed.drop("one", "bucket", "key"))
    taken = _slots(plan, words)
    epochs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("start") + e * F.col("source_size")), lambda at: at < F.floor("target"))
    times = placed.where("size > 0").select("source_rank", "row", "doc_id", *carried, "size", F.explode(epochs).alias("at"))
    last = F.col("at") + F.col("size") - 1
    stretches = times.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / words), F.floor(last / words))))
    met = stretches.join(taken, ["source_rank", "block"])
    begin = F.greatest(F.col("at"), F.col("block") * words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * words, F.col("whole"))
    schedule = met.select("slot", "source_rank", "block", "row", "doc_id", *carried, (begin - F.col("at")).alias("from_word"), (end - begin).alias("words")).where("words > 0")
    return Mix(plan, placed, schedule)


def taken_words(mixed: Mix) -> DataFrame:
    """documents with taken, first_slot and n_slots: the words that the schedule takes of each, repeats counted, the first slot that takes some
    (null if none does), and how many slots do."""
    sums = mixed.schedule.groupBy("source_rank", "row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.countDistinct("slot").alias("n_slots"))
    zero = F.lit(0).cast("long")
    return mixed.documents.join(sums, ["source_rank", "row"], "left").withColumns({"taken": F.coalesce("taken", zero), "n_slots": F.coalesce("n_slots", zero)})


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the schedule takes them: a document stands wherever a slot begins it, whole, up to `most` times; those without words go.

    A source so exceeds its target by part of one document at most. Columns stay as they are, whatever their names. Repeated rows are
    documents of their own; without words (null, empty) none is taken; an empty table gives no rows. The rows are numbered in a written
    copy, so that every later scan sees the same numbers. Texts are shuffled once, by number: each partition is an even share of
    the whole mix, in the schedule's order."""
    row, slot = fresh(docs, "_mix_row", "_mix_slot")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    begun = mix(keyed, key_col=row, **options).schedule.where("from_word = 0")
    places = written(begun.select(F.col("row_key").alias(row), F.col("slot").alias(slot)))
    return keyed.join(places.hint("merge"), row).sortWithinPartitions(slot, row).select(*docs.columns)


def op7_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, and where in the schedule each one is taken. Edge cases as in mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken_words(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, r % 3 + 1 AS w, source_size * 3 AS cap, source_size * 3 / (r % 3 + 1) AS ratio FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY ratio, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM s2),
f AS (SELECT arg_min(level, (ratio, r)) AS first_level FROM s3 WHERE level <= ratio),
p AS (SELECT s3.*, CASE WHEN first_level IS NULL OR ratio < first_level THEN cap::DOUBLE ELSE first_level * w END AS target FROM s3, f),
b AS (SELECT r, floor(target)::BIGINT AS lim, ceil(floor(target) / {BLOCK})::BIGINT AS blocks FROM p),
c AS (SELECT *, sum(blocks) OVER (ORDER BY r)::BIGINT AS high, (sum(blocks) OVER (ORDER BY r) - blocks)::BIGINT AS low FROM b),
n AS (SELECT max(high) AS total, count(*) AS sources FROM c),
pt AS (SELECT slot, ((slot::HUGEINT * {GOLDEN}::HUGEINT) % {WHOLE}::HUGEINT * total) // {WHOLE}::HUGEINT AS point FROM n, unnest(range(0, total)) u(slot)),
rk AS (SELECT c.r, pt.slot, row_number() OVER (PARTITION BY c.r ORDER BY slot) - 1 AS block, blocks FROM pt JOIN c ON point >= low AND point < high),
had AS (SELECT r, count(*) AS had FROM rk GROUP BY r),
sl AS (
  SELECT r, block, slot FROM rk WHERE block < blocks
  UNION ALL SELECT c.r, k, total + (k - coalesce(had, 0)) * sources + c.r FROM c LEFT JOIN had USING (r), n, unnest(range(coalesce(had, 0), greatest(blocks, coalesce(had, 0)))) u(k)),
o AS (
  SELECT row_number() OVER () AS row, d.*, p.r, p.source_size, p.target, floor(p.target)::BIGINT AS lim, coalesce(sum(size) OVER (PARTITION BY p.r ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
a AS (SELECT row, r, size, lim, start + e * source_size AS pos FROM o, unnest(range(0, 3)) u(e) WHERE size > 0 AND start + e * source_size < lim),
st AS (SELECT a.*, k AS block FROM a, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) u(k)),
m AS (SELECT st.row, sl.slot, least(pos + size, (block + 1) * {BLOCK}, lim) - greatest(pos, block * {BLOCK}) AS words FROM st JOIN sl USING (r, block)),
t AS (SELECT row, sum(words)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(DISTINCT slot) AS n_slots FROM m WHERE words > 0 GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots FROM o LEFT JOIN t USING (row)
"""
