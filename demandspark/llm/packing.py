"""Packing: token pieces into windows of one length by Karmarkar-Karp multiway differencing.

Each task tokenizes its documents and packs them in blocks as it goes. What fills a whole window alone is its own sequence; the rest of
each document is cut into pieces of `piece` tokens at most, and the pieces of a block are dealt to k windows by differencing: every piece
is a partial partition of k sums, and the two partitions of largest spread are merged again and again, largest sum onto smallest, until
one is left with near-equal windows. If a window exceeds the capacity, k rises by one and the block is dealt again. No shuffle.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: The end of a document.
END_ID = 1
#: Texts are tokenized in parts of about this many characters, cut where the tokenizer's pattern cuts anyway.
PART = 1 << 18

_encoders: dict[str, object] = {}


def _encoder():
    """text -> ids of byte_bpe_50k.json without special tokens.

    tiktoken on the same vocabulary is several times faster and gives the same ids. It is used for texts of Latin letters and common
    marks only, where both libraries' character classes agree; others go to tokenizers. Without neighbouring white space the
    pattern's look-ahead cannot matter and is left out."""
    if "ids" not in _encoders:
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        exact.encode_special_tokens = True
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        single = tiktoken.Encoding("single", pat_str=public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
        spaces, beyond = re.compile(r"\s\s"), re.compile("[^\t\n\r -~¡-¬®-ÿ]")

        def ids(text: str) -> list[int]:
            if beyond.search(text):
                return exact.encode(text, add_special_tokens=False).ids
            return (full if spaces.search(text) else single).encode_ordinary(text)

        _encoders["ids"] = ids
    return _encoders["ids"]


_cut = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def token_ids(text: str | None) -> np.ndarray:
    """The document's ids with END_ID at the end, as uint32. Null counts as empty."""
    encode, out, at = _encoder(), [], 0
    text = text or ""
    while len(text) - at > PART:  # between a letter and " letter" a match of the pattern always ends
        cut = _cut.search(text, at + PART)
        if not cut:
            break
        out.extend(encode(text[at : cut.start()]))
        at = cut.start()
    out.extend(encode(text[at:] if at else text))
    out.append(END_ID)
    return np.array(out, "<u4")


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (window of each item, sum of each window). Ties fall by the items' order."""
    n = len(sizes)
    sums: list = [None] * n
    for i in range(n):
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = sizes[i]
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums)))
        sums.append(both)
    window = np.zeros(n, np.int64)
    at: list = [None] * len(sums)
    at[-1] = np.arange(k)
    for m in range(len(merges) - 1, -1, -1):  # from the whole down to single items: which window each sum of a part has become
        a, b, order = merges[m]
        mine = np.empty(k, np.int64)
        mine[order] = at[n + m]
        for part, where in ((a, mine), (b, mine[::-1])):
            if part < n:
                window[part] = where[0]
            else:
                at[part] = where
        at[n + m] = None
    return window, sums[-1]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, with as few near-equal windows as hold them all."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return window
        k += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, piece: int, block: int, slack: int, ids_too: bool) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 36, 0
    rest: list[tuple] = []  # (doc_id, start, length, crc, doc_tokens, ids)
    held = 0
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * (8 if ids_too else 7)
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if ids_too else [])
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids_too else [])])

    def put(p: tuple, sequence: int, offset: int) -> None:
        out.append((*p[:5], base + sequence, offset, *([p[5]] if ids_too else [])))

    def deal() -> None:
        nonlocal made, held
        if rest:
            window = windows(np.array([p[2] for p in rest], np.int64), capacity)
            filled = dict.fromkeys(range(int(window.max()) + 1), 0)
            for p, w in zip(rest, window.tolist(), strict=True):
                put(p, made + w, filled[w])
                filled[w] += p[2]
            made += len(filled)
            rest.clear()
            held = 0

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
            ids = token_ids(text)
            n, at = len(ids), 0
            while at < n:
                length = min(capacity if n - at >= capacity else piece, n - at)
                if length < capacity:
                    length = min(length, block - held)  # a full block leaves each window a little slack
                part = ids[at : at + length]
                p = (doc_id, at, length, zlib.crc32(part.tobytes()), n, part.astype(np.int32) if ids_too else None)
                if length == capacity:
                    put(p, made, 0)
                    made += 1
                else:
                    rest.append(p)
                    held += length
                    if held == block:
                        deal()
                at += length
            if len(out) >= 20_000:
                yield table()
    deal()
    yield table()


def pack(docs: DataFrame, capacity: int = 2048, piece: int = 512, windows_per_block: int = 256, slack: int = 8, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, an array, if with_ids).

    Every id of every document, END_ID included, lies in exactly one piece; a null or empty text is one piece of one id. The pieces of a
    sequence lie from offset 0 without gaps and sum up to `capacity` at most; what is missing is padding. Rows with one doc_id, or
    equal rows, are packed separately. A very long document becomes whole windows and one rest. An empty table gives no rows.

    A block holds the pieces for `windows_per_block` windows, `slack` tokens short of each; the last block of a task may be smaller.
    Memory: one block of pieces and one document. sequence_id: partition and number in it, so that no task waits for another."""
    block = windows_per_block * (capacity - slack)
    if not 0 < piece < capacity:
        raise ValueError("piece must be less than the capacity")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(lambda b: _pack(b, capacity, piece, block, slack, with_ids), schema)


def op9_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
