"""Prefix trie of conversations, family first.

Conversations of one base id (a family) are brought together, rebuilt from the base's first turns and their own rest, and their common
prefixes are merged; only these combined family nodes are shuffled again, to be merged over all families.

A prefix is known by the sum of its turns' digests, each digest taken together with its place, in four lanes of 32 bits. Such sums are
running totals, so that a conversation of any length is spread over tasks in buckets, and no text is ever shuffled. Sums over subtrees need
no walk either: each member adds what its own path saves below the node, which follows from two numbers for each conversation (`_states`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, written

FAMILY = 5
HEADS = 9
#: Turns of a conversation that one task adds up, and ids that one row of joined ids holds, as powers of two.
BUCKET_BITS = 9
CHUNK_BITS = 12
LANES = ("a", "b", "c", "d")
NODE = ["depth", "hi", "lo"]
LOW = (1 << 32) - 1


def _base(conv: Column) -> Column:
    return conv - conv % FAMILY


def _taken(conv: Column) -> Column:
    """How many of its base's turns a conversation takes."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def turn_digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits for (role, text), nulls taken as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def _turns(convs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, at, digest, bytes): every turn and its place, from 0, in its own conversation."""
    slim = convs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), F.lit(1).alias("one"))
    slim = slim.withColumn("bucket", F.coalesce(F.shiftright("turn", BUCKET_BITS), F.lit(-(1 << 62))))
    placed = running(slim, ["conv_id"], "bucket", [F.col("turn").asc_nulls_first(), "digest", "bytes"], {"one": "at"})
    return written(placed.select("conv_id", "at", "digest", "bytes"))


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, digest, bytes, turns) of the rebuilt turns, and (conv_id, turns): a row for each conversation."""
    heads = turns.where((F.col("conv_id") == _base(F.col("conv_id"))) & (F.col("at") < HEADS - 1)).groupBy("conv_id")
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("at", "digest", "bytes"))).alias("head")).withColumnRenamed("conv_id", "base")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": _base(F.col("conv_id")), "h": _taken(F.col("conv_id"))})
    none = F.array().cast(heads.schema["head"].dataType)
    met = own.join(heads, "base", "left").withColumn("took", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")))
    met = met.withColumn("turns", F.size("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    met = written(met.select("conv_id", "h", "took", "turns"))
    first = met.select("conv_id", "turns", F.explode("took").alias("t")).select("conv_id", "t.at", "t.digest", "t.bytes", "turns")
    later = turns.join(met, "conv_id").where(F.col("at") >= F.col("h"))
    later = later.select("conv_id", (F.col("at") - F.col("h") + F.size("took")).alias("at"), "digest", "bytes", "turns")
    return first.unionByName(later), met.select("conv_id", "turns")


def _family_nodes(turns: DataFrame) -> DataFrame:
    """A row for each node of each family: its place in the trie (depth, hi, lo), its parent's, its members and those that end there."""
    rebuilt, every = _rebuilt(turns)
    spread = F.md5(F.concat(F.col("digest"), F.lit(":"), F.col("at").cast("string")).cast("binary"))
    lanes = {lane: F.conv(F.substring(spread, 1 + 8 * i, 8), 16, 10).cast("long") for i, lane in enumerate(LANES)}
    placed = rebuilt.withColumns({**lanes, "bucket": F.shiftright("at", BUCKET_BITS)})
    sums = running(placed, ["conv_id"], "bucket", ["at"], {**{lane: f"to_{lane}" for lane in LANES}, "bytes": "before"})
    packed = lambda x, y: F.shiftleft(x.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(y.bitwiseAND(F.lit(LOW)))
    up = [F.col(f"to_{lane}") for lane in LANES]
    here = [u + F.col(lane) for u, lane in zip(up, LANES, strict=True)]
    deep = sums.select(
        "conv_id", (F.col("at") + 1).alias("depth"), packed(*here[:2]).alias("hi"), packed(*here[2:]).alias("lo"), packed(*up[:2]).alias("up_hi"), packed(*up[2:]).alias("up_lo"),
        "digest", "bytes", F.col("before").cast("long").alias("before"), "turns")
    zero = F.lit(0).cast("long")
    root = every.select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), zero.alias("up_hi"), zero.alias("up_lo"), F.lit(None).cast("string").alias("digest"), zero.alias("bytes"), zero.alias("before"), "turns")
    both = deep.unionByName(root).withColumn("base", _base(F.col("conv_id")))
    ends = F.collect_list(F.when(F.col("depth") == F.col("turns"), F.col("conv_id")))
    same = [F.first(c).alias(c) for c in ("up_hi", "up_lo", "digest", "bytes", "before")]
    return written(both.groupBy("base", *NODE).agg(*same, F.collect_list("conv_id").alias("members"), ends.alias("ends")))


def _merged(family: DataFrame) -> DataFrame:
    """The nodes over all families: n_convs and the smallest member."""
    same = [F.first(c).alias(c) for c in ("up_hi", "up_lo", "digest", "bytes", "before")]
    return family.groupBy(*NODE).agg(*same, F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id"))


def _states(family: DataFrame, nodes: DataFrame) -> DataFrame:
    """(base, states): of each conversation of a family the bytes of its path above its own nodes, and whether it stands for a leaf.

    From some depth on a conversation is the smallest member of all nodes of its path: these are its own. The turns before them are what
    it has in common with smaller ones, so it adds their bytes, as far as they lie in a subtree, to what that subtree saves."""
    own = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    all_of = family.select(F.explode("ends").alias("conv_id"), "base", (F.col("before") + F.col("bytes")).alias("total"))
    state = F.struct("conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    return all_of.join(own, "conv_id", "left").groupBy("base").agg(F.collect_list(state).alias("states"))


def _below(family: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, hi, lo, n_leaves, saved_tokens): each family adds up its members, the families are added up by node."""
    met = family.join(_states(family, nodes), "base").withColumn("mine", F.filter("states", lambda s: F.array_contains("members", s["conv_id"])))
    zero = F.lit(0).cast("long")
    leaves = F.aggregate("mine", zero, lambda acc, s: acc + s["leaf"])
    saved = F.aggregate("mine", zero, lambda acc, s: acc + F.greatest(s["shared"] - F.col("before"), zero))
    return met.select(*NODE, leaves.alias("n"), saved.alias("s")).groupBy(*NODE).agg(F.sum("n").alias("n_leaves"), F.sum("s").alias("saved_tokens"))


def _ends(family: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256) of the nodes where a conversation ends. Ids are joined in chunks of neighbouring ids, and the chunks of a node
    go through the digest one after the other, so that no node's ids are held together."""
    ids = family.select(*NODE, F.explode("ends").alias("conv_id")).withColumn("chunk", F.shiftright("conv_id", CHUNK_BITS))
    chunks = ids.groupBy(*NODE, "chunk").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == now:
                    sha.update(b"," + text.encode())
                else:
                    out += [(*now, sha.hexdigest())] if now else []
                    now, sha = key, hashlib.sha256(text.encode())
            if out:
                yield told(out)
        if now:
            yield told([(*now, sha.hexdigest())])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])

    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return ordered.mapInArrow(digest, "depth long, hi long, lo long, ends_sha256 string")


def conversation_trie(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and digest, the turn_digest of a node's last turn (`with_texts` brings the texts).

    A conversation c takes the first h turns of conversation c - c % 5, h = crc32(c) % 9, then its own after its first h. Turns are ordered
    by turn, null first; of equal ones by digest, so that the same turns give the same node; repeated rows are turns of their own. Null
    role or text is empty. Rows without conv_id are left out; an empty table gives no nodes, not even a root. A conversation of any
    length, or one that everybody copies, is spread over tasks."""
    family = _family_nodes(_turns(convs, id_col, turn_col, role_col, text_col))
    merged = written(_merged(family))
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = written(merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    root = nodes.where("depth = 0").select("conv_id").first()
    # below a conversation's first own node its parent is its own as well; only for that node the parent is looked up
    firsts = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"))
    parents = nodes.where("depth > 0 AND n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("up"))
    asks = nodes.select("conv_id", *NODE, "up_hi", "up_lo").join(firsts, "conv_id").where("depth = first AND depth > 1")
    found = asks.join(parents, ["depth", "up_hi", "up_lo"]).select(*NODE, "up")
    parent = F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None)).when(F.col("depth") > 1, F.coalesce("up", "conv_id")).cast("long")
    out = nodes.join(_below(family, nodes), NODE).join(_ends(family), NODE, "left").join(found, NODE, "left")
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "digest")


def with_texts(trie: DataFrame, convs: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """trie with role and text of each node's last turn (null for the root): the distinct turns meet the nodes by digest."""
    texts = convs.select(turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return trie.join(texts.dropDuplicates(["digest"]), "digest", "left")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie over all conversations, without the digests of turns. Edge cases as in conversation_trie."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")


OP13_SQL = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS i,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, ''))::BIGINT AS b
  FROM conversations WHERE conv_id IS NOT NULL),
crc(v, k) AS (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda a, e: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM range(256) r(n)),
tab AS (SELECT list(k ORDER BY v) AS tab FROM crc),
cv AS (SELECT DISTINCT c FROM t),
h AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(c::VARCHAR, '.'), lambda ch: ascii(ch)::BIGINT)),
    lambda a, ch: xor(a >> 8, tab[(xor(a, ch) & 255) + 1])), 4294967295) % 9 AS h FROM cv, tab),
r AS (
  SELECT h.c, 0 AS part, t.i, t.x, t.b FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.i <= h.h
  UNION ALL SELECT h.c, 1, t.i, t.x, t.b FROM h JOIN t ON t.c = h.c AND t.i > h.h),
p AS (
  SELECT c, row_number() OVER w AS d, string_agg(x, '') OVER w AS k, b FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i)
  UNION ALL SELECT c, 0, '', 0 FROM cv),
len AS (SELECT c, max(d) AS n FROM p GROUP BY c),
node AS (
  SELECT k, d, min(p.c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, any_value(substr(k, 1, greatest(0, length(k) - 64))) AS up,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM p JOIN len USING (c) GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.k, sum((v.n_convs - 1) * v.b) AS saved_tokens, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves
  FROM node v LEFT JOIN kids USING (k), unnest(range(v.d + 1)) u(e) JOIN node a ON a.d = u.e AND a.k = substr(v.k, 1, 64 * u.e) GROUP BY a.k)
SELECT node.conv_id, node.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN node parent ON node.d > 0 AND parent.k = node.up
"""
