"""Sharding by balanced label propagation.

Documents of equal text are linked. Every document starts in a shard by its digest. In each round every group that lies in several shards
asks for the one that holds most of its bytes and has room for all of it; requests are admitted, group after group by digest, while
the shard's quota of bytes lasts, so that a quota cuts one group. A group heavier than a shard's even share is cut into parts of that size
first, since no shard could hold it. At last documents
leave shards above the mean for shards below it, unlinked ones first, in passes of smaller and smaller documents, until sizes are even.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, hex_digits, running, written


#: About how many documents a running total sees in one task.
ROWS = 2000
#: What is known of a group that holds more than one in so many documents is broadcast; there are fewer such groups than that.
HOT = 1024


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """Bytes of each shard: as many numbers as there are shards."""
    found = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    return [int(found.get(s) or 0) for s in range(shards)]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)).cast("array<long>"), index + 1)


def _split(facts: DataFrame, count: str, docs: int) -> tuple[DataFrame, DataFrame]:
    """(facts of hot groups, to be broadcast; facts of the others): `count` tells the documents of a group, docs those of all."""
    hot = F.col(count) * HOT > docs
    return F.broadcast(facts.where(hot)), facts.where(~hot)


def _propagate(linked: DataFrame, shards: int, capacity: int, base: list[int], docs: int) -> DataFrame:
    """One round: linked(group, key, turn, size, shard, ...) with the admitted moves made; docs: how many documents there are.

    Groups that lie in one shard are settled and fill it. Each other group wishes for the shard that holds most of its bytes among those
    with room for all of it (if none has, among all); the groups that wish for a shard are admitted one after the other while it has room."""
    votes = written(linked.groupBy("group", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("_rows")))
    whole = written(votes.groupBy("group").agg(F.count("*").alias("_shards"), F.sum("bytes").alias("_whole"), F.sum("_rows").alias("_rows")))
    settled = votes.join(whole.where("_shards = 1").select("group"), "group").select("shard", F.col("bytes").alias("size"))
    room = [max(0, capacity - b - x) for b, x in zip(base, _loads(settled, shards), strict=True)]
    open_ = whole.where("_shards > 1").select("group", "_whole", F.col("_rows").alias("_docs"))
    rank = F.struct((_pick(room, F.col("shard")) >= F.col("_whole")).alias("fits"), "bytes", (-F.col("shard")).alias("s"))
    wish = written(votes.join(open_, "group").groupBy("group").agg((-F.max(rank)["s"]).cast("int").alias("wish"), F.first("_docs").alias("_docs")))
    hot, rest = _split(wish, "_docs", docs)
    cold = linked.join(hot.select("group"), "group", "left_anti")
    moving = linked.join(hot, "group").unionByName(cold.join(rest, "group"))
    ranked = running(moving, ["wish"], "turn", ["group", "key", "doc_id", "size"], {"size": "_before"})
    fits = F.col("_before") + F.col("size") <= _pick(room, F.col("wish"))
    moved = ranked.withColumn("shard", F.when(fits, F.col("wish")).otherwise(F.col("shard"))).select(*linked.columns)
    return cold.join(rest.select("group"), "group", "left_anti").select(*linked.columns).unionByName(moved)


def _level(rows: DataFrame, shards: int, most: float) -> DataFrame:
    """One pass: documents of at most `most` bytes move from shards above the mean into the gaps of those below, placed by their running bytes."""
    loads = _loads(rows, shards)
    mean = sum(loads) / shards
    over = [max(0, int(x - mean)) for x in loads]
    if not sum(over):
        return rows
    offsets = [sum(over[:s]) for s in range(shards)]
    gaps, ends, at = [max(0, mean - x) for x in loads], [], 0.0
    for g in gaps:
        at += g
        ends.append(at)
    able = (F.col("size") <= most) & (_pick(over, F.col("shard")) > 0)
    rows = rows.withColumn("_able", F.when(able, F.col("size")).otherwise(0).cast("long")).withColumn("_turn", F.concat(F.col("linked").cast("int").cast("string"), F.col("turn")))
    ranked = running(rows, ["shard"], "_turn", ["group", "key", "doc_id", "size"], {"_able": "_before"})
    goes = able & (F.col("_before") + F.col("size") <= _pick(over, F.col("shard")))
    middle = _pick(offsets, F.col("shard")) + F.col("_before") + F.col("size") / 2
    last = max((s for s in range(shards) if gaps[s] > 0), default=0)
    to = reduce(lambda rest, s: F.when(middle < ends[s], F.lit(s)).otherwise(rest), [s for s in reversed(range(shards)) if gaps[s] > 0], F.lit(last))
    return ranked.withColumn("shard", F.when(goes, to).otherwise(F.col("shard")).cast("int")).drop("_able", "_turn", "_before")


def shard(docs: DataFrame, shards: int = 8, rounds: int = 4, room: float = 1.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, size, text_crc32, group (digest of the text), linked, shard, slot (gapless from 0 in its shard).

    Size: UTF-8 bytes of the text plus 1; null counts as empty, so that null and empty texts are one group. Shards differ by about one
    small document at most, if there are enough documents. Repeated rows are documents of their own. An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"))
    slim = written(slim)
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits, capacity = hex_digits(n, ROWS), int(total / shards * room)
    bucket = F.substring("key", 1, digits) if digits else F.lit("")
    # the last digits start a document anywhere, the first ones order it
    first = F.pmod(F.conv(F.substring("key", 25, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")
    groups = written(slim.groupBy("text_md5").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes")).where("_n > 1"))
    part = max(1, total // shards)
    hot, rest = _split(groups, "_n", n)
    cold = slim.join(hot.select("text_md5"), "text_md5", "left_anti").join(rest, "text_md5", "left")
    rows = slim.join(hot, "text_md5").unionByName(cold).withColumns({"linked": F.col("_n").isNotNull(), "bucket": bucket, "shard": first})
    parts = F.ceil(F.col("_bytes") / part)
    rows = rows.withColumn("group", F.when(F.col("linked"), F.concat_ws(":", "text_md5", F.pmod(F.conv(F.substring("key", 17, 8), 16, 10).cast("long"), parts).cast("string"))))
    # a group's documents follow each other; a group of very many is itself cut by its documents' digests
    own = F.when(F.col("_n") > ROWS, F.ceil(F.log(16.0, F.col("_n") / ROWS))).otherwise(0).cast("int")
    turn = F.when(F.col("linked"), F.concat(F.substring("text_md5", 1, digits) if digits else F.lit(""), F.expr("substring(key, 1, _own)"))).otherwise(F.col("bucket"))
    rows = written(rows.withColumn("_own", own).withColumn("turn", turn).drop("_n", "_bytes", "_own"))
    free = rows.where("NOT linked")
    base, linked = _loads(free, shards), rows.where("linked")
    for _ in range(rounds):
        new = written(_propagate(linked, shards, capacity, base, n))
        dropped(linked)
        linked = new
    now = written(free.unionByName(linked))
    mean = total / max(1, n)
    for most in (8 * mean, mean, mean / 8):
        new = written(_level(now, shards, most))
        dropped(now)
        now = new
    slots = running(now.withColumn("_one", F.lit(1)), ["shard"], "bucket", ["key", "doc_id", "size"], {"_one": "slot"})
    return slots.select("doc_id", "size", "text_crc32", F.col("text_md5").alias("group"), "linked", "shard", "slot")


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: pieces (shards that each linked group touches, less one, summed up) and linked documents, to judge a sharding."""
    seen = sharded.where("linked").groupBy("group", "shard").agg(F.count("*").alias("n")).groupBy("group").agg(F.count("*").alias("shards"), F.sum("n").alias("n"))
    return seen.agg(F.coalesce(F.sum(F.col("shards") - 1), F.lit(0)).alias("cuts"), F.coalesce(F.sum("n"), F.lit(0)).alias("linked"))


def op8_shard(spark, sf_dir: str) -> DataFrame:
    """The documents in shards 0 to 7 by the law `bytes`; null and empty texts, repeated rows and ids as in shard()."""
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
