"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is the list of its most frequent letter n-grams (1 to 3) by rank; a document's own list is compared with each profile by
the out-of-place distance, and the nearest language is the answer.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

UNKNOWN = "und"
#: Letters are what \w matches but for digits of any kind: \w and \d disagree about superscripts and the like, which are rare, and looked for first.
_odd = "".join(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_has_odd, _beyond = re.compile(f"[{re.escape(''.join(c for c in _odd if c <= chr(0xFFFF)))}]"), re.compile("[\U00010000-\U0010ffff]")
_word, _careful_word = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{re.escape(_odd)}]+")
#: Letters of a text that are counted at a time: bounds the arrays of a very long document.
PART = 1 << 20


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 characters of the lower-cased words, a blank at either end of each, packed in 21 bits a character; their counts."""
    grams, counts = [], []
    text = text or ""
    at = 0
    while at < len(text):
        end = at + PART
        while end < len(text) and not text[end].isspace() and end < at + 2 * PART:
            end += 1
        part = text[at:end].lower()
        words = (_careful_word if not part.isascii() and (_has_odd.search(part) or _beyond.search(part)) else _word).findall(part)
        at = end
        if words:
            a = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            blank = a == 32
            found = np.concatenate([a[~blank], a[:-1] << 21 | a[1:], (a[:-2] << 42 | a[1:-1] << 21 | a[2:])[~blank[1:-1]]])
            g, c = np.unique(found, return_counts=True)
            grams.append(g)
            counts.append(c)
    if len(grams) < 2:
        return (grams[0], counts[0]) if grams else (np.empty(0, np.int64), np.empty(0, np.int64))
    g, where = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def learn_profiles(labelled: DataFrame, size: int = 300, docs_per_language: int = 2000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(lang, gram, rank) from a bounded sample of labelled rows: about docs_per_language documents of each language, by a digest of the id.

    Rows without lang or text teach nothing; very long texts count whole; an empty table gives no profiles. The result has size * languages
    rows at most, for any number of languages."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # written, so that its size is known when the join is planned: texts stay where they are read
    totals = written(known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")))
    chance = (F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    sample = known.join(totals, F.col(lang_col) == F.col("_lang")).where(chance * F.col("_n") <= docs_per_language).select("_lang", text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by[lang].append(ngrams(text.as_py()))
            for lang, found in by.items():
                g, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([f[1] for f in found]), len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= size)
    return ranked.select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """The profiles, gram by gram: which languages have it, at which rank. As large as the profiles themselves."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        number = {lang: k for k, lang in enumerate(self.langs)}
        gram, lang, rank = (np.array([r[1] for r in rows], np.int64), np.array([number[r[0]] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        order = np.lexsort((lang, gram))
        self.lang, self.rank = lang[order], rank[order]
        self.grams, self.starts = np.unique(gram[order], return_index=True)
        self.starts = np.append(self.starts, len(order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 less the distance as a share of the largest possible. Ties fall by the language's code."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        order = np.lexsort((grams, -counts))[: self.size]
        grams, counts = grams[order], counts[order]
        first = np.concatenate([[True], counts[1:] != counts[:-1]])
        rank = np.maximum.accumulate(np.where(first, np.arange(len(grams)), 0))  # equally frequent ones share a rank
        where = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[where] == grams
        start, many = self.starts[where[known]], self.starts[where[known] + 1] - self.starts[where[known]]
        # the places of each gram's languages, one after the other
        at = np.arange(many.sum()) + np.repeat(start - np.concatenate([[0], many.cumsum()[:-1]]), many)
        apart = np.minimum(np.abs(self.rank[at] - np.repeat(rank[known], many)), self.size)
        # a gram that a language lacks costs `size`
        total = len(grams) * self.size - np.bincount(self.lang[at], self.size - apart, len(self.langs))
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (len(grams) * self.size))


def identify(docs: DataFrame, profiles: DataFrame, size: int = 300, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out and score_out added (replaced if there), from the text alone.

    Null texts and texts without a letter: `und`, score 0. Without profiles all are `und`. Repeated rows stay, very long texts count whole, an
    empty table gives no rows. The profiles go to the tasks as one array; their size is bounded by learn_profiles."""
    held = Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()], size)
    rows = docs.drop(lang_out, score_out)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.predict(x.as_py()) for x in b.column(at)]
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, score], [*b.schema.names, lang_out, score_out])

    schema = rows.select(*rows.columns, F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keep_known(docs: DataFrame, profiles: DataFrame, least: float = 0.3, size: int = 300) -> DataFrame:
    """docs without those of unknown language or with a score below `least`; the columns stay as they are, whatever their names."""
    lang, score = fresh(docs, "_told_lang", "_told_score")
    told = identify(docs, profiles, size, lang_out=lang, score_out=score)
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; profiles from the others than the held-out ones. Edge cases as in identify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = learn_profiles(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
