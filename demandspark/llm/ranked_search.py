"""Ranked lexical search over a two-level quantised index.

The exact level holds, for each document, its number of terms and the frequencies of the terms that the items ask for. The coarse level
holds one byte for each of these: the term's impact in the document in steps of STEP, rounded upwards. A byte b says that the impact lies in
((b - 1) * STEP, b * STEP], so sums of bytes by item weights bound a document's score from both sides. The kth largest lower bound of an
item is a threshold: every document whose upper bound reaches it is scored again in exact integers.

The items are a stated query set. They meet all documents in blocks: a block's terms and weights go to the tasks as two arrays of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: An impact is below 10^9 / 1000, and 255 steps reach it.
SCALE = 1_000_000_000
STEP = 3922
TOP = 20
#: Distinct terms of all items of a block, item by item, and items: bounds what goes to a task. A longer item is a block of its own.
BLOCK_TERMS = 1 << 14
BLOCK_ITEMS = 512
#: Documents whose bounds are computed at a time.
ROWS = 256
#: Fixed rule: terms are digits, letters and whatever lies beyond ASCII; A-Z are lower-cased. Bytes of longer characters stay as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included; null has none."""
    return text.translate(FOLD).split() if text else []


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times): the terms of each item, as UTF-8. Equal rows are one, texts of one item id add up; rows without id are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grams, times = [], [], []
            for item, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for term, n in Counter(terms_of(text)).items():
                    ids.append(item)
                    grams.append(term)
                    times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], b.schema.field(0).type), pa.array(grams, pa.binary()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")).distinct()
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"item_id {kind}, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


@dataclass
class Block:
    """Items that are searched together. terms: the distinct ones, by number. asked: (item, term number, times) as arrays."""

    items: list
    terms: list[bytes]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _blocks(asked: DataFrame) -> Iterator[Block]:
    """The items in blocks within the bounds, one block on the driver at a time."""
    sizes = written(asked.groupBy("item_id").agg(F.count("*").alias("n")))
    many, crowded = 1, True
    while crowded:
        block = F.pmod(F.xxhash64(F.lit(11), "item_id"), F.lit(many)).alias("block")
        full = sizes.groupBy(block).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        crowded = not full.where((F.col("items") > BLOCK_ITEMS) | (F.col("n") > BLOCK_TERMS) & (F.col("items") > 1)).isEmpty()
        many *= 2 if crowded else 1
    for k in range(many):
        rows = asked.where(F.pmod(F.xxhash64(F.lit(11), "item_id"), F.lit(many)) == k).orderBy("item_id", "term").collect()
        if rows:
            items, terms = sorted({r["item_id"] for r in rows}), sorted({bytes(r["term"]) for r in rows})
            at, number = {x: i for i, x in enumerate(items)}, {t: i for i, t in enumerate(terms)}
            yield Block(items, terms, np.array([at[r["item_id"]] for r in rows]), np.array([number[bytes(r["term"])] for r in rows]), np.array([r["times"] for r in rows], np.int64))


def exact_level(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, tf): a row for each document with a term: how many it has, and the numbers and frequencies of those asked for."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for b in batches:
            rows, n, sizes, ids, tf = [], [], [0], [], []
            for i, text in enumerate(b.column(2)):
                words = terms_of(text.as_py())
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    rows.append(i)
                    n.append(len(words))
                    ids.extend(found.keys())
                    tf.extend(found.values())
                    sizes.append(len(ids))
            kept = b.take(pa.array(rows, pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tf)]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(n, pa.int64()), *lists], ["row", "doc_id", "n", "terms", "tf"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(count, f"row long, doc_id {kind}, n long, terms array<int>, tf array<int>"))


def _impact(tf, m):
    """The integer impact, for columns and arrays alike: `tf` of a term in a document of length measure `m`."""
    return (SCALE * tf) // (1000 * tf + 12 * m)


def coarse_level(exact: DataFrame, docs: int, total: int) -> DataFrame:
    """(row, terms, impacts): the impacts as bytes, each the number of steps rounded upwards."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, tf = b.column(1).to_numpy(), b.column(3)
            sizes = np.diff(np.asarray(tf.offsets))
            m = 75 + (25 * n * docs) // total
            impact = _impact(tf.flatten().to_numpy().astype(np.int64), np.repeat(m, sizes))
            steps = (-(-impact // STEP)).astype(np.uint8).tobytes()
            ends = np.concatenate([[0], sizes.cumsum()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([steps[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["row", "terms", "impacts"])

    return written(exact.select("row", "n", "terms", "tf").where(F.size("terms") > 0).mapInArrow(quantise, "row long, terms array<int>, impacts binary"))


def bounds(coarse: DataFrame, weights: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, row, lower, upper) of every document that may be among the `top` of an item as far as its task can tell.

    weights[term, item]: weight times repeats. A task keeps the `top` largest lower bounds of each item and drops what lies below them: the
    kth lower bound over all documents is not smaller, and rows that define it are never dropped."""
    held = coarse.sparkSession.sparkContext.broadcast(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        best = np.zeros((top, w.shape[1]))
        for b in batches:
            lists = b.column(1)
            starts = np.asarray(lists.offsets).astype(np.int64)
            terms = lists.flatten().to_numpy()
            starts = starts - starts[0]
            impacts = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8)
            rows = b.column(0).to_numpy()
            lower, upper = np.empty((len(rows), w.shape[1])), np.empty((len(rows), w.shape[1]))
            for at in range(0, len(rows), ROWS):
                end = min(at + ROWS, len(rows))
                here = slice(starts[at], starts[end])
                some, col = np.unique(terms[here], return_inverse=True)
                line = np.repeat(np.arange(end - at), np.diff(starts[at : end + 1]))
                steps, held_by = np.zeros((2, end - at, len(some)))
                steps[line, col] = impacts[here]
                held_by[line, col] = impacts[here] > 0
                upper[at:end] = (steps @ w[some]) * STEP
                # each impact is above its byte's step by one at least
                lower[at:end] = upper[at:end] - (held_by @ w[some]) * (STEP - 1)
            best = np.partition(np.concatenate([best, lower]), len(rows), axis=0)[len(rows) :]
            doc, item = np.nonzero((upper >= best.min(axis=0)) & (upper > 0))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(rows[doc]), pa.array(lower[doc, item].astype(np.int64)), pa.array(upper[doc, item].astype(np.int64))], ["item", "row", "lower", "upper"])

    return coarse.mapInArrow(search, "item int, row long, lower long, upper long")


def _searched(exact: DataFrame, block: Block, top: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items of a block, by number."""
    spark = exact.sparkSession
    docs, total = exact.agg(F.count("*"), F.sum("n")).first()
    df = dict(exact.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # as many rows as the block has terms
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
    weights = np.zeros((len(block.terms), len(block.items)))
    weights[block.term, block.item] = weight[block.term] * block.times
    near = written(bounds(coarse_level(exact, docs, total or 1), weights, top))
    kth = near.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))).where(F.col("place") == top).select("item", F.col("lower").alias("kth"))
    left = written(near.join(kth, "item", "left").where("upper >= coalesce(kth, 0)").select("item", "row"))
    asked = spark.createDataFrame(list(zip(block.item.tolist(), block.term.tolist(), (weight[block.term] * block.times).tolist(), strict=True)), "item int, term int, weight long")
    wanted = exact.join(left.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tf")).alias("t"))
    m = F.expr(f"75 + (25 * n * {docs}L) div {total or 1}L")
    impact = F.expr(f"({SCALE}L * tf) div (1000L * tf + 12L * m)")
    impacts = wanted.select("row", "doc_id", F.col("t.terms").alias("term"), F.col("t.tf").cast("long").alias("tf"), m.alias("m")).withColumn("impact", impact).select("row", "doc_id", "term", "impact")
    scores = impacts.join(left, "row").join(asked, ["item", "term"]).groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("impact")).alias("score"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    return scores.where("score > 0").withColumn("rank", best).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents of the highest score above 0; equal scores by id, null first, then in the table's order.

    Null and empty texts have no terms and are not counted; repeated documents are documents of their own. Items: as in item_terms; without terms,
    or with none that a document has, an item has no rows. Very long texts count whole. Empty tables give no rows. Items beyond one block are
    searched block by block, each over an index of the terms it asks for."""
    spark = docs.sparkSession
    asked = written(item_terms(items, item_id_col, item_text_col))
    kinds = (asked.schema["item_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString())
    out = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    for block in _blocks(asked):
        found = _searched(exact_level(docs, block.terms, id_col, text_col), block, top)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kinds[0]}")
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document ranked for every benchmark item. Edge cases as in search."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ws FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS big_n, sum(len(ws))::BIGINT AS big_l FROM d WHERE len(ws) > 0),
tf AS (SELECT k, doc_id, len(ws) AS n, term, count(*) AS tf FROM (SELECT k, doc_id, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
p AS (SELECT k, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l))) AS impact FROM tf, s),
sc AS (SELECT item_id, k, doc_id, sum(times * w * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, k, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, k)::INT AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
