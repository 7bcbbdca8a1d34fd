"""Toxicity by compression distance with two zstandard dictionaries.

Every word of a text, between blanks, is a window: wider ones were tried, and what their other words cost by chance hid the difference. A
window is compressed with a dictionary trained on toxic and one trained on ordinary text, and the bytes that the toxic one saves are its distance.
Both dictionaries begin with the same base of ordinary words, so that what is common costs the same with either; then follows what
zstandard's training keeps of the words that are typical of a class. A logistic curve, fitted on texts that neither dictionary has seen, turns
the distances of a text's windows into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: zstandard finds no match in the last bytes of a block and gives up on blocks that hardly shrink: every window stands between these.
HEAD = b"\x01" + bytes(range(128, 168)) + b"\x02"
TAIL = b"\x03" + bytes(range(200, 216)) + b"\x04"
LEVEL = 6
#: Windows whose distance a task remembers.
MEMO = 200_000
THRESHOLD = 0.3
#: A passage is typical of toxic texts if chance would bring it among so many candidates with this probability at most.
CHANCE = 0.01
#: And is at least so much denser there (natural logarithm).
DENSER = math.log(8)
_word = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _words(text: str | None) -> list[bytes]:
    return _word.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _passages(word: bytes, least: int = 4, most: int = 8) -> set[bytes]:
    """The substrings of least to most bytes of a word between blanks."""
    w = b" " + word + b" "
    return {w[i : i + n] for n in range(least, min(most, len(w)) + 1) for i in range(len(w) - n + 1)}


def _tail(k: int, n: int, p: float) -> float:
    """The natural logarithm of an upper bound (Chernoff) on the chance of k hits or more in n draws of probability p."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


#: Of one text a passage counts so often at most, so that no text decides alone.
OFTEN = 4


def _counted(texts: list[str], only: set[bytes] | None = None) -> tuple[Counter, Counter, Counter, int]:
    """(passage: texts that hold it, passage: texts that hold it twice or more, passage: its places, OFTEN of a text at most, words)."""
    once, twice, places, total = Counter(), Counter(), Counter(), 0
    for t in texts:
        words = _words(t)
        total += len(words)
        mine: Counter = Counter()
        for w, n in Counter(words).items():
            for k in _passages(w) if only is None else _passages(w) & only:
                mine[k] += n
        once.update(mine.keys())
        twice.update(k for k, n in mine.items() if n > 1)
        places.update({k: min(n, OFTEN) for k, n in mine.items()})
    return once, twice, places, total


def typical_passages(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Passages that toxic texts hold more often than chance allows, those with most evidence first, none within another.

    Among the texts that hold a passage (and among those that hold it repeatedly), as many would be toxic as among all texts if it meant
    nothing; the chance of so many more is held against the number of candidates. The evidence is the places in toxic texts times the
    logarithm of how much denser they are there."""
    if not toxic or not ordinary:
        return []
    once, twice, places, words = _counted(toxic)
    share = len(toxic) / (len(toxic) + len(ordinary))
    need = math.log(CHANCE / max(1, 2 * len(once)))
    found = {k for k, v in once.items() if v * math.log(share) <= need}  # even with no ordinary text at all
    once0, twice0, places0, words0 = _counted(ordinary, found)
    sure = [k for k in found if min(_tail(once[k], once[k] + once0[k], share), _tail(twice[k], twice[k] + twice0[k], share)) <= need]
    denser = {k: math.log(places[k] / words * words0 / (places0[k] + 1)) for k in sure}
    chosen: list[bytes] = []
    for k in sorted((k for k in sure if denser[k] > DENSER), key=lambda k: (-places[k] * denser[k], -len(k), k)):
        if not any(k in c or c in k for c in chosen):
            chosen.append(k)
    return chosen


def _trained(samples: list[bytes], size: int) -> bytes:
    """What zstandard's dictionary training keeps of the samples; too few for it are kept as they are, the last ones first to go."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def train_dictionaries(toxic: list[str], ordinary: list[str], size: int = 4096, base_size: int = 16384) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents from texts of both classes; either list may be empty.

    The ordinary one is trained on the words without a typical passage, to base_size bytes. The toxic one is trained on the typical passages
    of toxic texts, as often as they stand there, to `size` bytes, and is put behind the ordinary one; in the other content bytes that match
    nothing take this place, so that a window without a typical passage costs the same with both but for chance."""
    marks = typical_passages(toxic, ordinary)
    holds = re.compile(b"|".join(map(re.escape, marks)) or rb"(?!)")
    inside = re.compile(b"|".join(re.escape(m.strip()) for m in marks) or rb"(?!)")
    plain = [x for x in (b"".join(b" " + w for w in _words(t) if not inside.search(w)) for t in ordinary) if x]
    base = _trained(plain, base_size)
    typical = _trained([x for x in (b"".join(m for w in _words(t) for m in holds.findall(b" " + w + b" ")) for t in toxic) if x], size)
    return base + b"\x05" * len(typical) + TAIL + HEAD, base + typical + TAIL + HEAD


class Scorer:
    """The distances of a text's windows, and the probability that they stand for."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean=None, spread=None, weights=None):
        self.dictionaries, self.mean, self.spread, self.weights = (ordinary, toxic), mean, spread, weights
        self._pair, self._memo = None, {}

    def __getstate__(self):
        return self.dictionaries, self.mean, self.spread, self.weights

    def __setstate__(self, state):
        self.__init__(*state[0], *state[1:])

    def distance(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if self._pair is None:
            raw = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in self.dictionaries]
            self._pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in raw]
        got = self._memo.get(window)
        if got is None:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            whole = HEAD + b" " + window + b" " + TAIL
            got = self._memo[window] = len(self._pair[0](whole)) - len(self._pair[1](whole))
        return got

    def distances(self, text: str | None) -> np.ndarray:
        """Of all windows of the whole text; a text without words has one empty window."""
        words = _words(text) or [b""]
        return np.fromiter(map(self.distance, words), float, len(words))

    def features(self, text: str | None) -> np.ndarray:
        d = self.distances(text)
        n = len(d)
        top = -np.sort(-np.partition(d, n - 8)[n - 8 :]) if n > 8 else -np.sort(-d)
        hits, sure = (d >= 2).sum(), (d >= 3).sum()
        return np.array([top[0], top[:2].mean(), top[:4].mean(), hits / n, np.log((hits + 0.1) / n), np.log((sure + 0.1) / n), np.log1p(hits), np.log1p(sure), np.log1p(n)])

    def fit(self, texts: list[str], toxic: list[int], weights: list[float], rounds: int = 40, ridge: float = 1e-2) -> Scorer:
        """Logistic regression by Newton's method; weights undo the sampling of the classes."""
        x, y, w = np.array([self.features(t) for t in texts]), np.array(toxic, float), np.array(weights, float)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        beta = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            hessian = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
            step = np.linalg.solve(hessian, z.T @ (w * (p - y)) + ridge * beta)
            beta -= np.clip(step, -5, 5)
        self.weights = beta
        return self

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = np.append((self.features(text) - self.mean) / self.spread, 1.0) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, sample_bytes: int = 2_000_000, sample_docs: int = 20_000, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Scorer:
    """A scorer from the documents that labels(id, label 0 or 1) marks; other labels, and null texts, teach nothing.

    The driver fits it on a bounded sample: about sample_bytes of toxic and twice as much of ordinary text for the dictionaries, and as
    much again for the curve, and sample_docs documents of either class at most on average; they are chosen by a digest of
    their id. Only ids and lengths are shuffled; the chosen ids, so bounded, are broadcast to the scan that reads their texts.
    Without rows of both classes every score is 0."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    known = written(docs.where(F.col(text_col).isNotNull()).select(id_col, F.octet_length(text_col).alias("_bytes")).join(marked, id_col))
    totals = {r["_y"]: r for r in known.groupBy("_y").agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("docs")).collect()}
    if not all(y in totals and totals[y]["bytes"] for y in (0, 1)):
        return Scorer(TAIL + HEAD, TAIL + HEAD)
    chance = (F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    share = {y: min((2 - y) * sample_bytes / totals[y]["bytes"], sample_docs / totals[y]["docs"]) for y in (0, 1)}
    words = F.when(F.col("_y") == 1, F.lit(min(0.6, share[1]))).otherwise(F.lit(min(0.6, share[0])))
    curve = F.when(F.col("_y") == 1, F.lit(min(0.4, share[1]))).otherwise(F.lit(min(0.4, share[0])))
    use = F.when(chance < words, F.lit(0)).when((chance >= 0.6) & (chance < curve + 0.6), F.lit(1))
    chosen = known.select(id_col, "_y", use.alias("_use")).where("_use IS NOT NULL").distinct()
    drawn = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(F.broadcast(chosen), id_col)
    rows = sorted(drawn.select(F.col(text_col).alias("text"), "_y", "_use").collect(), key=lambda r: (r["_use"], r["_y"], r["text"]))
    texts = lambda use, y: [r["text"] for r in rows if r["_use"] == use and r["_y"] == y]
    scorer = Scorer(*train_dictionaries(texts(0, 1), texts(0, 0)))
    drawn = [r for r in rows if r["_use"] == 1]
    if {r["_y"] for r in drawn} != {0, 1}:
        drawn = rows
    return scorer.fit([r["text"] for r in drawn], [r["_y"] for r in drawn], [1 / min(0.4, share[r["_y"]]) * min(0.4, share[0]) for r in drawn])


def score_toxicity(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold) added (replaced if there), from whole texts alone.

    A null text counts as empty; an empty one gets the score of a text without words. Repeated rows stay, very long texts are scored whole, an
    empty table gives no rows. Nothing is shuffled."""
    rows = docs.drop("score", "predicted")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.fromiter((scorer.score(x.as_py()) for x in b.column(at)), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, rows.select(*rows.columns, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from the labels of the others than the held-out ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = docs.withColumn("held_out", out)
    scorer = learn(docs.where("NOT held_out"), labels)
    return score_toxicity(docs, scorer).select("doc_id", "held_out", "score", "predicted")
