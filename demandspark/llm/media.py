"""Media columns: Chroma audio fingerprints of binary PCM columns, and their alignment.

A recording's frames are folded to 12 pitch classes; sixteen rectangle filters on the integral image of this chroma sequence give two
bits each (Gray code), packed in one integer for each frame position. The integers of asking recordings are ordered, a block in each task, and
all others are looked up in them: a histogram of the offsets at which equal integers meet gives the alignment, judged by the share of
unequal bits where the two overlap. Every integer is looked up, so that no pair that meets anywhere is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_by_ids, written


@dataclass(frozen=True)
class Pcm:
    """How a binary column is read: mono samples, u8 or s16 (little-endian), at `rate` Hz, in frames of `frame` samples every `hop`."""

    encoding: str = "s16"
    rate: int = 11025
    frame: int = 4096
    hop: int = 1365


#: Frames that the widest filter spans, and the margins of the quantizer (fixed values).
SPAN = 16
MARGIN = 0.25
GRAY = (0, 1, 3, 2)
#: How many integers of asking recordings a task holds, and of others: blocks of about so many, whose number grows with the tables.
ASKING, OTHERS = 1 << 23, 1 << 24
#: How many meetings of equal integers are counted at a time.
MEETINGS = 1 << 22
#: Frames transformed at a time.
CHUNK = 4096


def _filters() -> list[tuple[str, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames): every kind at every fourth of a ladder of widths, by rule."""
    kinds = ("whole", "time", "pitch", "both")
    return [(kinds[i % 4], (5 * i) % 9, 2 + 2 * (i % 2), (4, 8, 12, 16)[(i // 4 + i) % 4]) for i in range(16)]


def samples(audio: bytes, pcm: Pcm) -> np.ndarray:
    if pcm.encoding == "u8":
        return (np.frombuffer(audio, np.uint8).astype(np.float32) - 128) / 128
    return np.frombuffer(audio[: len(audio) // 2 * 2], "<i2").astype(np.float32) / 32768


def chroma(x: np.ndarray, pcm: Pcm) -> np.ndarray:
    """(frames, 12): energy of each pitch class, as a share of the frame's; silence is all zeros."""
    n = 1 + (len(x) - pcm.frame) // pcm.hop if len(x) >= pcm.frame else 0
    freq = np.fft.rfftfreq(pcm.frame, 1 / pcm.rate)
    used = (freq >= 28) & (freq <= 3520)
    fold = np.zeros((len(freq), 12), np.float32)
    fold[np.nonzero(used)[0], np.round(12 * np.log2(freq[used] / 440)).astype(int) % 12] = 1
    window, out = np.hanning(pcm.frame).astype(np.float32), np.zeros((n, 12))
    if not n:
        return out
    frames = np.lib.stride_tricks.sliding_window_view(x, pcm.frame)[:: pcm.hop]
    for at in range(0, n, CHUNK):
        part = frames[at : at + CHUNK]
        part = (part - part.mean(1, keepdims=True)) * window
        out[at : at + CHUNK] = (np.abs(np.fft.rfft(part, axis=1)) ** 2) @ fold
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 0.0)


def fingerprint(audio: bytes | None, pcm: Pcm, least: int = 4) -> np.ndarray:
    """One unsigned 32-bit integer for each position of SPAN frames; none for null and empty recordings.

    A recording too short for `least` positions is repeated up to these: silence behind it would make short ones alike."""
    x = samples(audio or b"", pcm)
    if not len(x):
        return np.empty(0, np.uint32)
    whole = pcm.frame + (SPAN + least - 2) * pcm.hop
    c = chroma(np.resize(x, max(whole, len(x))), pcm)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, high, wide in _filters():
        all_, t, m = area(0, wide, p, p + high), wide // 2, high // 2
        if kind == "whole":
            a, b = all_ * 12 / high, area(0, wide, 0, 12)
        elif kind == "time":
            a = area(0, t, p, p + high)
            b = all_ - a
        elif kind == "pitch":
            a = area(0, wide, p, p + m)
            b = all_ - a
        else:
            a = area(0, t, p, p + m) + area(t, wide, p + m, p + high)
            b = all_ - a
        value = np.log((0.01 + a) / (0.01 + b))
        level = (value > -MARGIN).astype(np.uint32) + (value > 0) + (value > MARGIN)
        out = (out << np.uint32(2)) | np.array(GRAY, np.uint32)[level]
    return out


def align(left: np.ndarray, right: np.ndarray) -> tuple[int, int, int, float]:
    """(offset, votes, overlap, error): the offset (position in right less position in left) at which most equal integers meet, the
    smallest of several, and the share of unequal bits over the overlap there."""
    order = np.argsort(right, kind="stable")
    ranked = right[order]
    lo, hi = np.searchsorted(ranked, left, "left"), np.searchsorted(ranked, left, "right")
    histogram = np.zeros(len(left) + len(right), np.int64)
    for i in np.nonzero(hi > lo)[0]:
        histogram[order[lo[i] : hi[i]] - i + len(left)] += 1
    best = int(histogram.argmax())
    offset, votes = best - len(left), int(histogram[best])
    return offset, votes, *overlap_at(left, right, offset)


def overlap_at(left: np.ndarray, right: np.ndarray, offset: int) -> tuple[int, float]:
    """(overlap, error) of an alignment: its length and the share of unequal bits."""
    a, b = max(0, -offset), max(0, offset)
    n = min(len(left) - a, len(right) - b)
    return n, float(np.bitwise_count(left[a : a + n] ^ right[b : b + n]).sum()) / (32 * n) if n > 0 else 1.0


def keys_of(prints: np.ndarray) -> np.ndarray:
    """The keys by which a recording is asked for: its distinct integers, all of them. Recordings that meet at any offset share one."""
    return np.unique(prints)


class Asking:
    """The integers of a block of recordings in order, to look others up in."""

    def __init__(self, ids: np.ndarray, prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        sizes = np.array([len(p) for p in prints])
        whole = np.concatenate(prints)
        order = np.argsort(whole, kind="stable")
        self.ranked = whole[order]
        self.owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
        self.place = (order - (sizes.cumsum() - sizes)[self.owner]).astype(np.int32)
        self.longest = int(sizes.max())

    def meetings(self, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, offset, votes), ordered: at which offsets (position in other less position in the owner) how many integers are equal."""
        at = np.searchsorted(self.ranked, other, "left")
        met = np.nonzero(self.ranked[np.minimum(at, len(self.ranked) - 1)] == other)[0]
        at = at[met]
        n = np.searchsorted(self.ranked, other[met], "right") - at
        ends, span, parts, first = n.cumsum(), self.longest + len(other), [], 0
        while first < len(met):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MEETINGS, "right")))
            many = n[first:last]
            here = np.repeat(at[first:last] - (many.cumsum() - many), many) + np.arange(many.sum())
            offset = np.repeat(met[first:last], many) - self.place[here]
            parts.append(np.unique(self.owner[here].astype(np.int64) * span + offset + self.longest, return_counts=True))
            first = last
        if not parts:
            return (np.empty(0, np.int64),) * 3
        codes, votes = parts[0]
        if len(parts) > 1:
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            votes = np.zeros(len(codes), np.int64)
            np.add.at(votes, where, np.concatenate([v for _, v in parts]))
        return codes // span, codes % span - self.longest, votes

    def aligned(self, other: np.ndarray, least_votes: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(index of the asking recording, *align(asking, other)) of those with so many votes."""
        owner, offset, votes = self.meetings(other)
        enough = votes >= least_votes
        owner, offset, votes = owner[enough], offset[enough], votes[enough]
        order = np.lexsort((offset, -votes, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        for k, o, v in zip(owner[best].tolist(), offset[best].tolist(), votes[best].tolist(), strict=True):
            yield k, o, v, *overlap_at(self.prints[k], other, o)


def _sound(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(_id, _audio, _sha) of media; ids are cast to long, a null recording is empty."""
    audio = F.coalesce(F.col(audio_col), F.lit("").cast("binary"))
    return media.select(F.col(id_col).cast("long").alias("_id"), audio.alias("_audio")).withColumn("_sha", F.sha2("_audio", 256))


def packed(prints: np.ndarray) -> bytes:
    """Compressed: successive integers differ in few bits."""
    change = prints.copy()
    change[1:] ^= prints[:-1]
    return zstandard.compress(change.tobytes(), 12)


def unpacked(data: bytes) -> np.ndarray:
    return np.bitwise_xor.accumulate(np.frombuffer(zstandard.decompress(data), np.uint32))


def recordings(media: DataFrame, pcm: Pcm, id_col: str, audio_col: str) -> DataFrame:
    """(_id, _sha, n, prints) for each row of media, written; ids are cast to long. prints are n integers, packed. Null and empty recordings
    have none; an empty table gives no rows; repeated rows stay; a very long recording is transformed a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(x.as_py(), pcm) for x in b.column(1)]
            cols = [b.column(0), b.column(2), pa.array([len(x) for x in made], pa.int32()), pa.array([packed(x) for x in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "_sha", "n", "prints"])

    return written(_sound(media, id_col, audio_col).mapInArrow(run, "_id long, _sha string, n int, prints binary"))


def classes_of(found: DataFrame, asked: Column) -> DataFrame:
    """(sha, class_id, copies, n, prints, asked): equal recordings are one class, named by its smallest id; asked if any of its rows is."""
    grouped = found.groupBy(F.col("_sha").alias("sha"))
    return written(grouped.agg(F.min("_id").alias("class_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prints").alias("prints"), F.max(asked).alias("asked")))


def match_recordings(media: DataFrame, pcm: Pcm, id_col: str, audio_col: str, classes: DataFrame, queries: DataFrame, least_votes: int = 2, most_error: float = 0.25, least_overlap: int = 4) -> DataFrame:
    """(query_class, class_id, offset, votes, overlap, bit_error): which classes align with the classes in queries(class_id), themselves left out.

    Every query meets every class, in pairs of blocks: a task holds a block of each side, and no limit is set on what meets. The integers come
    with the classes, media is not read again. Recordings without prints match nothing. Of equally good offsets the smallest counts. Empty
    tables give no rows."""
    named = classes.where("class_id IS NOT NULL AND n > 0").select("class_id", "n", "prints")
    ids = queries.select("class_id").where("class_id IS NOT NULL").distinct()
    near, _ = split_by_ids(named, ids, "class_id")
    mine = written(near.join(ids, "class_id", "left_semi"))
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lefts, rights = total(mine) // ASKING + 1, max(total(named) // OTHERS + 1, 2 * classes.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = mine.select("class_id", "prints", dealt(lefts).alias("left"), each(rights).alias("right"))
    others = named.select("class_id", "prints", dealt(rights).alias("right"), each(lefts).alias("left"))
    kinds = {"query_class": pa.int64(), "class_id": pa.int64(), "offset": pa.int32(), "votes": pa.int32(), "overlap": pa.int32(), "bit_error": pa.float64()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if len(left) and len(right):
            block = Asking(left["class_id"].to_numpy(), [unpacked(x.as_py()) for x in left["prints"]])
            for class_id, prints in zip(right["class_id"].to_pylist(), right["prints"], strict=True):
                for k, offset, votes, n, error in block.aligned(unpacked(prints.as_py()), least_votes):
                    if block.ids[k] != class_id and n >= least_overlap and error <= most_error:
                        got.append((int(block.ids[k]), class_id, offset, votes, n, error))
        return pa.table({c: pa.array([g[i] for g in got], kind) for i, (c, kind) in enumerate(kinds.items())})

    met = asking.groupBy("left", "right").cogroup(others.groupBy("left", "right"))
    return met.applyInArrow(run, "query_class long, class_id long, offset int, votes int, overlap int, bit_error double")


def search_result(found_keys: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Links and membership in one frame. kind `member`: doc_id and its class_id, for every recording. kind `link`: query_class, the class_id that
    aligns with it, offset, votes, overlap, bit_error. Columns of the other kind are null."""
    rows = found_keys.select(F.col("_id").alias("doc_id"), F.col("_sha").alias("sha")).join(classes.select("sha", "class_id"), "sha")
    members = rows.select(F.lit("member").alias("kind"), "doc_id", "class_id")
    return members.unionByName(found.withColumn("kind", F.lit("link")), allowMissingColumns=True)


def op4_chroma_match(spark, sf_dir: str) -> DataFrame:
    """Every document's UTF-8 bytes are read as 8-bit PCM (the tables hold no sound); queries: ids divisible by 100, against all.

    Null and empty texts are a class without links; equal texts are one class; tables without rows give none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media, pcm = docs.select("doc_id", F.col("text").cast("binary").alias("audio")), Pcm("u8", 8000, 64, 8)
    found, is_asked = recordings(media, pcm, "doc_id", "audio"), F.coalesce(F.col("_id") % 100 == 0, F.lit(False))
    classes = classes_of(found, is_asked)
    return search_result(found, classes, match_recordings(media, pcm, "doc_id", "audio", classes, classes.where("asked")))
