"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, compared exactly in tiles with numpy exclusive-or and bit counts.

Equal fingerprints are one node. The others are sorted into tiles by the population counts of their four 16-bit quarters: two fingerprints
within the radius have quarter counts that differ by no more than the radius in sum, so all other pairs of tiles are skipped. Tiles
are cut into blocks of bounded size and each pair of blocks is compared in one numpy call; it gives a star for each component
it sees, not all pairs, and the stars are joined to connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_of, large_keys, paired
from .common import written
from .components import components_of, connected

SEED = 42
#: Shingles hashed at a time: bounds the bit matrix of a long document.
SHINGLES = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles of `width` words (fewer words: the whole sequence), XXH64 with seed 42.

    A bit is 1 if it is set in over half the hashes, repeats included. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    n = len(words) - width + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        parts = [words[at + i : min(at + SHINGLES, n) + i] for i in range(width)]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*parts, strict=True)), ">u8", len(parts[0]))
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(make, f"`{id_col}` {kind}, fp long")


def _steps(radius: int) -> list[int]:
    """Differences of tile keys, each pair of tiles once: quarter counts in base 32, the sum of differences within the radius."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return sorted(s for s in (sum(x << (5 * i) for i, x in enumerate(d)) for d in near) if s >= 0)


def stars(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) for the components that links between left and right (unsigned fingerprints) make; centres are smallest as signed longs."""
    apart = np.bitwise_count(left[:, None] ^ right[None, :])
    i, j = np.nonzero((apart <= radius) & (left[:, None] != right[None, :]))
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return components_of(left[i].view(np.int64), right[j].view(np.int64))


def near_links(prints: DataFrame, radius: int = 2, rows_per_block: int = 2048) -> DataFrame:
    """(u, v): links that connect what lies within `radius` differing bits, for the distinct values of prints.fp."""
    quarter = lambda i: (F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) + radius) * (1 << (5 * i))
    tiles = written(prints.select("fp").distinct().select("fp", sum((quarter(i) for i in range(1, 4)), quarter(0)).cast("long").alias("tile")))
    large = large_keys(tiles, "tile", rows_per_block)
    blocks = block_of(tiles, "tile", "fp", large).groupBy("tile", "block", "parts").agg(F.collect_list("fp").alias("fps"))
    pairs = paired(blocks, large, "tile", _steps(radius), ["fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for x, y in zip(b.column(0), b.column(1), strict=True):
                got = stars(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius)
                u.append(got[0])
                v.append(got[1])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return pairs.select(F.col("left.fps").alias("a"), F.col("right.fps").alias("b")).mapInArrow(compare, "u long, v long")


def _named(prints: DataFrame, nodes: DataFrame, joined: DataFrame, id_col: str) -> DataFrame:
    grown = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grown = written(grown)
    least = written(grown.groupBy("component").agg(F.min("least").alias("component_id")))
    named = written(grown.join(least, "component").select("fp", "component_id"))
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def simhash_groups(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable by links of at most `radius` differing bits.

    Null and empty texts have the fingerprint 0 and link like any other. Rows that repeat stay, each with its own row. Null ids get the
    component of their fingerprint. An empty table gives no rows. Links are between distinct fingerprints, so that copies cost nothing."""
    prints = written(fingerprints(docs, width, id_col, text_col))
    return _named(prints, prints.groupBy("fp").agg(F.min(id_col).alias("least")), connected(near_links(prints, radius)), id_col)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
