from __future__ import annotations

import random
import re

import duckdb
import pytest
from conftest_llm import make_docs, words
from demandspark.llm.decontaminate import OP12_SQL, TOKEN, decontaminate, op12_decontaminate


def split(text):
    return re.findall(TOKEN, "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window=10):
    """(words, hit places, items) by looking at every place."""
    ws, hit, found = split(text), set(), set()
    for item, words_ in items:
        n = min(window, len(words_))
        for q in range(len(words_) - n + 1) if n else ():
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == words_[q : q + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(ws), hit, sorted(found)


def check(spark, texts, bench):
    docs = make_docs(spark, texts)
    items = spark.createDataFrame(bench, "item_id long, text string, lang string")
    known = [(str(i), split(t)) for i, t, _ in bench if i is not None]
    got = decontaminate(docs, items).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = brute(r.text, known)
        spans = [p for first, end in r.hits for p in range(first, end)]
        assert (r.n_words, r.n_hit, spans, r["items"], r.contaminated) == (n, len(hit), sorted(hit), found, bool(hit))
        assert r.shard == "kept"
    return got


def test_against_brute_force(spark, texts):
    rng = random.Random(12)
    long = words(rng, 80).split()
    bench = [(1, " ".join(long[:30]), "x"), (2, " ".join(long[20:50]), "x"), (3, " ".join(long[40:]), None), (3, "an other text of the same item with more than ten words in it", None), (10, "Short item", "x"), (11, "ha", "x"), (12, None, "x"), (13, "  ", "x"), (None, " ".join(long), "x"), (14, " ".join(["ha"] * 12), "x"), (1, " ".join(long[:30]), "x"), (15, "Ünï ÇÖDÉ 漢字", "x")]
    planted = [
        " ".join(long), " ".join(long[3:12]), " ".join(long[3:13]), "; ".join(w.upper() for w in long[35:60]), " ".join(long[:10] + ["break"] + long[10:25]), " ".join(long[15:26]) + " and " + " ".join(long[60:75]),
        "a SHORT--item, ha", "short\titem short item", " ".join(["ha"] * 25), " ".join(["ha"] * 9), "xha hax", "Ünï ÇÖDÉ 漢字", "ünï çödé 漢字", " ".join(long) * 1,
    ]
    check(spark, [*texts, *planted, *(words(rng, 30) + " " + " ".join(long[k : k + 10]) + " " + words(rng, 30) for k in range(70))], bench)


def test_every_length_of_short_items(spark):
    """A shared stretch of exactly the window's length is found wherever it stands."""
    rng = random.Random(3)
    bench = [(n, words(rng, n), None) for n in range(1, 12)]
    texts = [words(rng, k) + " " + t + " " + words(rng, 5) for _, t, _ in bench for k in (0, 1, 4, 9)]
    got = check(spark, texts, bench)
    assert all(r.contaminated for r in got)


def test_empty_tables(spark):
    docs, items = make_docs(spark, ["a b c", None]), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate(docs, items).collect()] == [False, False]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, op12_decontaminate(spark, folder).select(*cols).collect())) == sorted(c.sql(f"select {', '.join(cols)} from ({OP12_SQL})").fetchall())
