"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least `least`.

Wide SimHash prints (256 bits, over distinct shingles) are compared in tiles with numpy exclusive-or and bit counts, as in simhash.py. At
the distances that a similarity of 0.8 asks for, bit counts rule out hardly any pair of tiles, so two things take their part: a tile
holds the texts that share one of their KEYS smallest shingle hashes, and inside a tile only texts whose numbers of shingles allow the
similarity meet. What lies within RADIUS bits makes candidate components; inside these the shingle sets themselves are compared, and only
verified links join documents.

What can be lost (`least` = 0.8, prints and hashes taken as random): a pair shares none of the keys with a chance of 0.2 ** 8; the bits of a
pair at 0.8 differ in 39 of 256 on average with a deviation of 5.7, and RADIUS is 4 deviations above. Texts of four and five shingles
are the worst case: 48 and 6.2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_of, large_keys, paired
from .common import dropped, split_by_ids, written
from .components import components_of, connected

SEED = 42
KEYS = 8
RADIUS = 64
PRINT = ["p0", "p1", "p2", "p3"]
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the shingles of `width` words (A-Z lower-cased; fewer words: the whole sequence; no words: none)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(each))
    n = len(each) - width + 1
    out = np.full(n, SEED + width, np.uint64)
    for i in range(width):
        out = _mixed(out + each[i : i + n])
    return np.unique(out)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four words: a bit is 1 if it is set in over half of the hashes, each spread to 256 bits."""
    counts = np.zeros(64 * len(PRINT), np.int64)
    for at in range(0, len(hashes), SHINGLES):
        part = hashes[at : at + SHINGLES]
        spread = np.stack([_mixed(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(len(PRINT))], axis=1)
        counts += np.unpackbits(spread.view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is built for one of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.empty(0, kind)]).astype(kind, copy=False))


def _described(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: id, _row, digest of its set of shingles, n, wide print, KEYS smallest hashes, shingles as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            digests, sets, keys, prints = [], [], [], np.zeros((b.num_rows, len(PRINT)), np.int64)
            for k, x in enumerate(b.column(1)):
                hashes = shingle_hashes(x.as_py(), width)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                prints[k] = wide_print(hashes)
                keys.append(hashes[:KEYS].view(np.int64))
                sets.append(np.unique(hashes.astype(np.uint32)).view(np.int32))
            cols = [b.column(0), b.column(2), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            cols += [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(len(PRINT))] + [_lists(keys, np.int64), _lists(sets, np.int32)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "_row", "digest", "n", *PRINT, "keys", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, _row long, digest binary, n int, {', '.join(f'{p} long' for p in PRINT)}, keys array<long>, shingles array<int>")


def tile_links(left: tuple, right: tuple | None, least: float, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius between left and right, or inside left if right is None. Each side: (nodes, n, words of the prints).

    Rows of the right side follow in order of n, and a row of the left is compared only with those whose n its own allows."""
    nodes, n, prints = left
    other, m, others = right or left
    order = np.argsort(m, kind="stable")
    other, m, others = other[order], m[order], [p[order] for p in others]
    low, high = np.searchsorted(m, n * least - 1e-9), np.searchsorted(m, n / least + 1e-9, "right")
    turn = np.argsort(n, kind="stable")
    u, v = [], []
    for at in range(0, len(turn), 128):
        rows = turn[at : at + 128]
        a, z = low[rows[0]], high[rows[-1]]
        if a >= z:
            continue
        apart = np.zeros((len(rows), z - a), np.uint16)
        for mine, its in zip(prints, others, strict=True):
            apart += np.bitwise_count(mine[rows, None] ^ its[None, a:z])
        i, j = np.nonzero(apart <= radius)
        keep = (j + a >= low[rows[i]]) & (j + a < high[rows[i]]) & (nodes[rows[i]] != other[j + a])
        if keep.any():
            got = components_of(nodes[rows[i[keep]]], other[j[keep] + a])
            u.append(got[0])
            v.append(got[1])
    if not u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return components_of(np.concatenate(u), np.concatenate(v))


def _candidates(reps: DataFrame, least: float, rows_per_block: int) -> DataFrame:
    """(node, component): components of what lies within RADIUS bits in some tile of reps(node, n, print, keys)."""
    tiles = reps.select("node", "n", *PRINT, F.explode("keys").alias("tile"))
    large = large_keys(tiles, "tile", rows_per_block)
    held = ["node", "n", *PRINT]
    blocks = block_of(tiles, "tile", "node", large).groupBy("tile", "block", "parts").agg(F.collect_list(F.struct(*held)).alias("has"))
    blocks = written(blocks.where((F.col("parts") > 1) | (F.size("has") > 1)))
    pairs = paired(blocks, large, "tile", [0], ["has"])
    sides = pairs.select(F.col("left.has").alias("a"), F.when(~F.col("same"), F.col("right.has")).alias("b"), "same")

    def side(x) -> tuple:
        rows = x.values
        return rows.field("node").to_numpy(), rows.field("n").to_numpy(), [rows.field(p).to_numpy().view(np.uint64) for p in PRINT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for x, y, same in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                got = tile_links(side(x), None if same else side(y), least)
                u.append(got[0])
                v.append(got[1])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    found = connected(sides.mapInArrow(run, "u long, v long"))
    dropped(blocks)
    return found


def _prefix_length(n: int, least: float) -> int:
    """Two sets of Jaccard similarity >= least share one of their first so many shingles in any order that all sets follow."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], first: int, least: float) -> tuple[list[int], list[int]]:
    """Links that join whatever pairs of Jaccard similarity >= least join: between sets[:first] and the others, or among all if first is 0.

    Every pair that shares a shingle of both prefixes (rare ones first) is verified, unless verified links join it already."""
    many, lengths = len(sets), np.array([len(s) for s in sets])
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    often, ends = np.bincount(ids, minlength=len(distinct)), np.concatenate([[0], lengths.cumsum()])
    own = [ids[ends[i] : ends[i + 1]] for i in range(many)]
    prefix = [t[np.lexsort((t, often[t]))[: _prefix_length(len(t), least)]] for t in own]
    tokens = np.concatenate(prefix)
    holders = np.repeat(np.arange(many), [len(p) for p in prefix])[np.argsort(tokens, kind="stable")]
    starts = np.searchsorted(np.sort(tokens), np.arange(len(distinct) + 1))
    label, mark, apart = np.arange(many), np.zeros(len(distinct), bool), many
    u, v = [], []
    for i in range(first or many):
        if apart == 1:  # all are joined
            break
        met = np.unique(np.concatenate([holders[starts[t] : starts[t + 1]] for t in prefix[i]]))
        met = met[met >= first] if first else met[met > i]
        n = lengths[met]
        met = met[(label[met] != label[i]) & (np.minimum(n, lengths[i]) >= least * np.maximum(n, lengths[i]) - 1e-9)]
        if not len(met):
            continue
        mark[own[i]] = True
        for j in met.tolist():
            if label[j] == label[i]:
                continue
            shared = int(np.count_nonzero(mark[own[j]]))
            if shared >= least * (lengths[i] + lengths[j] - shared) - 1e-9:
                label[label == label[j]] = label[i]
                apart -= 1
                u.append(int(nodes[i]))
                v.append(int(nodes[j]))
        mark[own[i]] = False
    return u, v


def _verified(sets: DataFrame, candidates: DataFrame, least: float, shingles_per_block: int) -> DataFrame:
    """(node, component): components by verified links between the sets(node, shingles) of each component of candidates(node, component).

    A component of more shingles than a block holds is cut into blocks and every pair of its blocks is compared."""
    # by sort and merge at every size, so that what is shuffled grows with the input alone
    met = written(split_by_ids(sets, candidates, "node")[0].join(candidates.hint("merge"), "node").select("component", "node", "shingles"))
    sums = met.groupBy("component").agg(F.sum(F.size("shingles")).alias("_n")).where(F.col("_n") > shingles_per_block)
    large = written(sums.select("component", F.ceil(F.col("_n") / F.lit(shingles_per_block)).cast("int").alias("parts")))
    blocks = written(block_of(met, "component", "node", large).groupBy("component", "block", "parts").agg(F.collect_list(F.struct("node", "shingles")).alias("has")))
    pairs = paired(blocks, large, "component", [0], ["has"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            u, v = [], []
            for x, y, same in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                nodes, held = [], []
                for one in (x,) if same else (x, y):
                    nodes.append(one.values.field("node").to_numpy())
                    held.extend(s.values.to_numpy() for s in one.values.field("shingles"))
                if len(held) > 1:
                    got = similar_links(np.concatenate(nodes), held, 0 if same else len(nodes[0]), least)
                    u += got[0]
                    v += got[1]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    # a block that meets itself is sent to Python once
    sides = pairs.select(F.col("left.has").alias("a"), F.when(~F.col("same"), F.col("right.has")).alias("b"), "same")
    found = connected(sides.mapInArrow(run, "u long, v long"))
    for old in (met, blocks):
        dropped(old)
    return found


def _grouped(docs: DataFrame, least: float, width: int, shingles_per_block: int, rows_per_block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with id and digest; a row for each digest: node, copies, component_id, whether verified links join it to another)."""
    sets = written(_described(docs, width, id_col, text_col))
    nodes = written(sets.groupBy("digest").agg(F.min(id_col).alias("least"), F.min("_row").alias("node"), F.count("*").alias("copies")))
    once = nodes.select(F.col("node").alias("_row")).hint("merge")
    reps = written(sets.select(F.col("_row"), "n", *PRINT, "keys").join(once, "_row", "left_semi").withColumnRenamed("_row", "node"))
    candidates = _candidates(reps, least, rows_per_block)
    joined = _verified(sets.select(F.col("_row").alias("node"), "shingles"), candidates, least, shingles_per_block)
    grown = nodes.join(joined.hint("merge"), "node", "left").withColumns({"linked": F.col("component").isNotNull(), "component": F.coalesce("component", "node")})
    grown = written(grown)
    names = grown.where("linked").groupBy("component").agg(F.min("least").alias("component_id"))
    named = grown.join(names.hint("merge"), "component", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    named = written(named.select("digest", "node", "copies", "linked", "component_id"))
    for old in (reps, candidates, joined, nodes, grown):
        dropped(old)
    return sets.select(id_col, "digest"), named


def similar_groups(docs: DataFrame, least: float = 0.8, width: int = 5, shingles_per_block: int = 1 << 18, rows_per_block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: the smallest id of its group of near copies, that is, of what links of Jaccard similarity >= least reach.

    Texts with the same set of shingles are one node; null, empty and blank texts are one such group. Null ids are passed over when the
    smallest id is taken (a group without any has a null component_id). Repeated rows stay. An empty table gives no rows. Long texts
    are compared whole. What the search for candidates can lose is stated at the top of this module."""
    rows, named = _grouped(docs, least, width, shingles_per_block, rows_per_block, id_col, text_col)
    return rows.join(named.select("digest", "component_id").hint("merge"), "digest").select(id_col, "component_id")


def dedup(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, one row of each group of similar_groups: that with the smallest id (of rows with this id, one of them; rows without id stay).

    Columns stay as they are. Texts are shuffled only for rows whose id may be one that goes or repeats; a broadcast table of at most
    2 ** 20 digests of ids tells."""
    rows, named = _grouped(docs, least, width, 1 << 18, 4096, id_col, text_col)
    several = named.where("linked OR copies > 1").select("digest", "component_id").hint("merge")
    gone = written(rows.join(several, "digest").where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    twice = written(rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col))
    maybe, apart = split_by_ids(docs, gone.union(twice), id_col)
    left = maybe.join(gone.hint("merge"), id_col, "left_anti")
    if not twice.isEmpty():
        again = left.join(twice.hint("merge"), id_col, "left_semi").dropDuplicates([id_col])
        left = left.join(twice.hint("merge"), id_col, "left_anti").unionByName(again)
    return apart.unionByName(left).select(*docs.columns)
