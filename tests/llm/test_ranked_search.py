from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
from conftest_llm import make_docs, words
from demandspark.llm import ranked_search
from demandspark.llm.ranked_search import OP11_SQL, op11_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts, ids, items, top=20):
    docs = [(i, k, Counter(ts), len(ts)) for k, (i, t) in enumerate(zip(ids, texts, strict=True)) if (ts := split(t))]
    big_n, big_l = len(docs), sum(d[3] for d in docs)
    df = Counter(t for d in docs for t in d[2])
    out = []
    for item, text in items:
        scored = []
        for i, k, tf, n in docs:
            m = 100 - 25 + (25 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
            if score > 0:
                scored.append((-score, i, k))
        out += [(item, rank + 1, i, -s) for rank, (s, i, _) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def check(spark, texts, bench, ids=None):
    items = spark.createDataFrame(bench, "item_id long, text string, score long")
    got = sorted(map(tuple, search(make_docs(spark, texts, ids=ids), items).collect()))
    ids = ids or list(range(len(texts)))
    assert got == brute(texts, ids, sorted({b[:2] for b in bench if b[0] is not None}))
    return got


def test_against_brute_force(spark, texts, monkeypatch):
    rng = random.Random(11)
    some = [t for t in texts if t and len(t) > 20]
    bench = [(i, " ".join(rng.choice(some).split()[:12]) + " " + words(rng, 6), 1) for i in range(9)]
    bench += [(50, None, 1), (51, "", 1), (52, "nowhere_found", 1), (53, "ba BA ba, ba", 1), (54, "Ünï 漢字", 1), (None, "ba ce", 1), bench[0]]
    texts = texts + [words(rng, rng.randint(1, 60)) for _ in range(900)] + ["ba"] * 40
    want = check(spark, texts, bench)
    # several blocks, in each of which the same items are found
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 2)
    assert check(spark, texts, bench) == want


def test_copies_and_ties(spark):
    """Hundreds of equal documents tie for the last places; a third of all rows is one text."""
    rng = random.Random(2)
    base = words(rng, 30)
    texts = [base] * 300 + [words(rng, 30) for _ in range(600)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = check(spark, texts, [(1, base, 1), (2, " ".join(base.split()[:3]), 1), (3, words(rng, 10), 1)], ids)
    assert len([r for r in got if r[0] == 1]) == 20


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = make_docs(spark, ["a b", None, "", "!"])
    assert [tuple(r)[:3] for r in search(docs, items).collect()] == [(1, 1, 0)]
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cols = ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, op11_search(spark, folder).select(*cols).collect())) == sorted(c.sql(f"select {', '.join(cols)} from ({OP11_SQL})").fetchall())
