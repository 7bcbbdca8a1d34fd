"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003), in DataFrame functions only.

Every text becomes the hashes of its k-grams of words; of each run of w successive hashes the smallest is kept, the rightmost of equal ones.
Two texts that share k + w - 1 words in a row share the kept hash of that stretch, at the same place in it. So the benchmark's windows
and the documents meet on kept hashes, and a hit is extended to the window around it and compared word by word.

Windows of each length have a winnowing of their own with k + w - 1 equal to that length, so that short items are found as surely as others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, fresh, split_by_ids, written

#: Words are what lies between these characters, after A-Z are lower-cased.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def gram_words(length: int) -> int:
    """k of the winnowing that finds every shared stretch of `length` words: half of them, so that two in length - k + 2 hashes are kept."""
    return (length + 1) // 2


def words_of(text: Column, lower: bool = True) -> Column:
    """The words of a text; null has none. Cutting at what is between them costs a third of matching them."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.translate(text, CAPITALS, SMALL) if lower else text, BETWEEN, -1), lambda x: x != "")


def kept_hashes(words: Column, length: int) -> Column:
    """What winnowing keeps: array of (hash, first, last), the smallest k-gram hash of each window of `length` words, from 0, equal ones of
    neighbouring windows as one. Empty for fewer words."""
    k = gram_words(length)
    w = length - k + 1
    hashed = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*(F.get(g, i + j) for j in range(w)))) if w > 1 else g

    def runs(mins: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(mins) - 1), lambda i: (i == 0) | (F.get(mins, i) != F.get(mins, i - 1)))
        run = lambda s: lambda i, j: F.struct(F.get(mins, i).alias("hash"), i.alias("first"), (F.coalesce(F.get(s, j + 1), F.size(mins)) - 1).alias("last"))
        return bound(starts, lambda s: F.transform(s, run(s)))

    found = lambda ws: bound(hashed(ws), lambda h: bound(grams(h), lambda g: bound(least(g), runs)))
    return bound(words, lambda ws: F.when(F.size(ws) >= length, found(ws)).otherwise(F.array().cast("array<struct<hash:bigint,first:int,last:int>>")))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, text, length): the windows of `window` words of each item, a shorter item whole; items without words or id have none."""
    cut = lambda ws: F.when(
        F.size(ws) > window, F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(window)), " "))
    ).when(F.size(ws) > 0, F.array(F.array_join(ws, " ")))
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.explode(bound(words_of(F.col(text_col)), cut)).alias("text"))
    return rows.distinct().withColumn("length", F.size(F.split("text", " ")))


def find_seeds(rows: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    """(names, length, first, last): where a document's kept hash is one of the benchmark's, for each length of windows."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # as many as a window has words at most
    seeds = rows.select(*names, F.lit(0).alias("length"), F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    for n in lengths:
        kept = windows.where(F.col("length") == n).select(F.get(kept_hashes(F.split("text", " "), n), F.lit(0))["hash"].alias("hash")).distinct()
        # the outer form, since for the other one the arrays would be made twice, once to see whether they are empty
        made = rows.select(*names, F.explode_outer(kept_hashes(words_of(F.col("text")), n)).alias("kept")).select(*names, "kept.*")
        seeds = seeds.unionByName(made.join(kept, "hash").select(*names, F.lit(n).alias("length"), "first", "last"))
    return written(seeds.distinct())


def find_leaks(rows: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    """(names, hits, n_hit, items): the documents of rows(names, text) that hold a window. hits: the stretches of hit words (first, end), end
    exclusive, in order and apart; items: the items whose windows occur, sorted as strings. names tell the documents apart, equal rows are one."""
    seeds = find_seeds(rows, windows, names)
    # only texts of documents that may have a seed are moved; each seed is extended to the windows that kept its hash
    concerned, _ = split_by_ids(rows, seeds, names[0])
    asked = seeds.groupBy(*names).agg(F.collect_list(F.struct("length", "first", "last")).alias("seeds"))
    window = lambda ws, s: lambda i: F.struct(i.alias("first"), F.array_join(F.slice(ws, i + 1, s["length"]), " ").alias("text"))
    around = lambda ws: F.flatten(F.transform("seeds", lambda s: F.transform(F.sequence(s["first"], s["last"]), window(ws, s))))
    tried = concerned.join(asked, names).select(*names, F.explode_outer(bound(words_of(F.col("text")), around)).alias("t")).select(*names, "t.*")
    found = written(tried.join(windows.select("text", "length").distinct(), "text").select(*names, "first", (F.col("first") + F.col("length")).alias("end"), "text").distinct())
    earlier = Window.partitionBy(*names).orderBy("first", "end")
    apart = F.coalesce((F.col("first") > F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    islands = found.select(*names, "first", "end").distinct().withColumn("apart", apart).withColumn("island", F.sum("apart").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy(*names, "island").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    hits = islands.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("hits"), F.sum((F.col("end") - F.col("first")).cast("long")).alias("n_hit"))
    items = found.select(*names, "text").distinct().join(windows.select("text", "item"), "text").groupBy(*names).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return hits.join(items, names)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words, hits, n_hit, items and contaminated added (replaced if there); hits and items as in find_leaks, empty for clean ones.

    A hit word lies in an occurrence of a window: `window` words in a row of an item, or all words of a shorter one. Null and empty texts have no
    words. Repeated rows get the same result; documents are told apart by digests of id and text, so that copies don't meet in one
    task. Items without id or words have no windows; rows of one item id add up. Empty tables give no rows, or no hits."""
    new = ["n_words", "hits", "n_hit", "items", "contaminated"]
    kept = docs.drop(*new)
    names = fresh(kept, "_key_a", "_key_b")
    keys = [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(n) for k, n in enumerate(names)]
    windows = written(windows_of(items, item_id_col, item_text_col, window))
    found = find_leaks(kept.select(*keys, F.col(text_col).alias("text")), windows, names)
    counted = kept.select("*", *keys, F.size(words_of(F.col(text_col), lower=False)).cast("long").alias("n_words"))
    met = counted.join(found, names, "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "hits": F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return met.withColumn("contaminated", F.col("n_hit") > 0).select(*kept.columns, *new)


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item. Edge cases as in decontaminate."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP12_SQL = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '{TOKEN}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, array_to_string(ws[p:p + least(len(ws), {WINDOW}) - 1], ' ') AS t, least(len(ws), {WINDOW}) AS n FROM i, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) u(p) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM w),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{TOKEN}') AS ws FROM documents),
g AS (SELECT k, p, n, array_to_string(ws[p:p + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, greatest(len(ws) - n + 2, 1))) u(p)),
m AS (SELECT g.k, g.p, g.n, w.item FROM g JOIN w USING (t, n)),
hit AS (SELECT k, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) u(q) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM m) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""
