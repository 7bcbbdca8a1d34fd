"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A rotation is three rounds of random signs and a fast Hadamard transform; a vector's hash is the axis (and its sign) nearest to the rotated
vector. A table joins `depth` hashes to one code; each vector lies in the bucket of its code and in those with one hash replaced by its
second nearest axis. Vectors that share a bucket are candidates, and the cosine in double precision decides. A pair counts in
the first bucket that both share only, so that links are counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_of, large_keys, paired
from .common import written
from .components import connected


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, depth: int, seed: int) -> np.ndarray:
    """(rows, tables, depth + 1) codes of unit vectors: the vector's own bucket in each table, then those with one hash replaced."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, x.shape[1]])
    rows, out = np.arange(len(x)), np.zeros((len(x), tables, depth + 1), np.int64)
    for t in range(tables):
        best, second = [], []
        for _ in range(depth):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(y)
            a = size.argmax(1)
            size[rows, a] = -1
            b = size.argmax(1)
            best.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
        for probe in range(depth + 1):
            code = np.zeros(len(x), np.int64)
            for k in range(depth):
                code = code * (2 * width) + (second[k] if probe == k + 1 else best[k])
            out[:, t, probe] = code * tables + t
    return out


def _unit(vectors) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(tables: int, depth: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1).to_pylist()
            found: list = [None] * len(vectors)
            for n in {len(v) for v in vectors}:
                where = [i for i, v in enumerate(vectors) if len(v) == n]
                for i, c in zip(where, codes(_unit([vectors[i] for i in where]), tables, depth, seed), strict=True):
                    found[i] = c.ravel().tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "codes"])

    return run


def _flat(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _members(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, copies, unit vectors, codes) of a block; a bucket's key holds the length of its vectors."""
    return rows.field("node").to_numpy(), rows.field("copies").to_numpy(), _unit(_flat(rows.field("vector"))), _flat(rows.field("codes"))


def _verified(least: float, tables: int):
    """Pairs of blocks -> (node, links, centre): partial counts of links, and a star for each component in the pair."""
    from .components import components_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, links, centres = [], [], []
            for left, right, same, bucket in zip(*(b.column(k) for k in range(4)), strict=True):
                (n1, w1, x1, k1), (n2, w2, x2, k2) = _members(left.values), _members(right.values)
                if x1.shape[1] != x2.shape[1]:
                    continue
                bucket = bucket.as_py()
                near = x1 @ x2.T >= least
                if same.as_py():
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                for at in range(0, len(i), 1 << 16):
                    p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    c1, c2 = k1.reshape(len(k1), tables, -1)[p], k2.reshape(len(k2), tables, -1)[q]
                    shared = np.where((c1[:, :, :, None] == c2[:, :, None, :]).any(3), c1, np.iinfo(np.int64).max)
                    mine = shared.reshape(len(p), -1).min(1) == bucket
                    p, q = p[mine], q[mine]
                    if not len(p):
                        continue
                    both, count = np.concatenate([n1[p], n2[q]]), np.concatenate([w2[q], w1[p]])
                    who, inverse = np.unique(both, return_inverse=True)
                    nodes.append(who)
                    links.append(np.bincount(inverse, count).astype(np.int64))
                    own = dict(zip(*(x.tolist() for x in components_of(n1[p], n2[q])), strict=True))
                    centres.append(np.array([own.get(x, x) for x in who.tolist()], np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, centres)], ["node", "links", "centre"])

    return run


def embedding_links(vectors: DataFrame, least: float = 0.98, tables: int = 6, depth: int = 3, seed: int = 6, rows_per_block: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each of vectors: id, n_links (other vectors linked directly, copies included), component_id, kept.

    Linked: both labels equal and not null, vectors of one length, cosine >= least, and found as candidates (recall by tables and depth).
    A null, empty or zero vector, one with null or non-finite components, or one without a label has no links and is its own component.
    Equal vectors are one node with a count, so that copies are not compared. Rows with one id are one node only if label and vector
    are equal; component_id is the smallest id among the component's rows. An empty table gives no rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # digests of the vector's text: 0.0 and -0.0 are one
    zero = F.lit(0).cast(rows.schema["vector"].dataType.elementType)
    plain = F.transform("vector", lambda x: F.when(x == 0, zero).otherwise(x))
    digest = lambda seed: F.when(usable, F.xxhash64(F.lit(seed), "label", plain))  # noqa: E731  two of 64 bits: no two vectors are taken for one
    rows = rows.withColumns({"_k1": digest(1), "_k2": digest(2)}).withColumn("vector", F.when(usable, plain))
    slim = written(rows.select("id", "_k1", "_k2"))
    nodes = rows.where("_k1 IS NOT NULL").groupBy("_k1", "_k2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("first_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    hashed = nodes.select("node", "vector").mapInArrow(_hashed(tables, depth, seed), "node long, codes array<long>")
    full = written(nodes.drop("_k1", "_k2").join(hashed, "node"))
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))
    spread = full.select("node", F.xxhash64(label, F.size("vector")).alias("_of"), F.explode(F.array_distinct("codes")).alias("code")).select("node", "code", F.xxhash64("_of", "code").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket")
    met = written(spread.join(shared, "bucket"))
    large = large_keys(met, "bucket", rows_per_block)
    member = F.struct("node", "copies", "vector", "codes", "code")
    blocks = block_of(met, "bucket", "node", large).join(full.select("node", "copies", "vector", "codes"), "node")
    blocks = blocks.groupBy("bucket", "block", "parts").agg(F.collect_list(member).alias("members"))
    pairs = paired(blocks, large, "bucket", [0], ["members"])
    columns = pairs.select(F.col("left.members").alias("a"), F.col("right.members").alias("b"), "same", F.col("left.members")[0]["code"].alias("code"))
    found = written(columns.mapInArrow(_verified(least, tables), "node long, links long, centre long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected(found.select(F.col("node").alias("u"), F.col("centre").alias("v")))
    known = nodes.select("node", "_k1", "_k2", "copies", "first_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known.join(counts, "node", "left"))
    least_id = written(known.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = written(known.join(least_id, "component").select("_k1", "_k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"))
    # unusable vectors have no key and stay out of the join, where they would meet in one task
    linked = slim.where("_k1 IS NOT NULL").join(named, ["_k1", "_k2"]).select("id", "n_links", "component_id")
    alone = slim.where("_k1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component; nulls, zeros, repeats and empty tables as in embedding_links."""
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (
  SELECT a.k AS u, b.k AS v, a.vec_id AS ui, b.vec_id AS vi FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach(k, id) AS (SELECT u, vi FROM link UNION SELECT link.u, reach.id FROM link JOIN reach ON link.v = reach.k),
least AS (SELECT k, min(id) AS id FROM reach GROUP BY k),
n AS (SELECT u AS k, count(*) AS n_links FROM link GROUP BY u),
told AS (SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least(v.vec_id, least.id) AS component_id FROM v LEFT JOIN n USING (k) LEFT JOIN least USING (k)
  UNION ALL SELECT vec_id, 0, vec_id FROM embeddings
  WHERE NOT coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false))
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, CAST(coalesce(component_id, vec_id) AS BIGINT) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM told
"""
