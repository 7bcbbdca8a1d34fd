from __future__ import annotations

import random

import numpy as np
import xxhash
from conftest_llm import make_docs, words
from demandspark.llm.components import connected
from demandspark.llm.near_copies import dedup, similar_groups
from demandspark.llm.simhash import _steps, fingerprint, simhash_groups


def slow_print(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, link):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if link(i, j) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(texts):
    assert all(fingerprint(t) == slow_print(t) for t in texts if t is None or len(t) < 20_000)
    assert fingerprint("AÉ b") == fingerprint("aÉ b") != fingerprint("aé b")


def test_links_against_brute_force(spark, texts):
    rng = random.Random(1)
    few = [f"{rng.choice('abc')} {rng.choice('de')}" for _ in range(30)]
    every = [t for t in texts if t is None or len(t) < 20_000] + few
    prints = [slow_print(t) for t in every]
    want = components(len(every), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r.doc_id: r for r in simhash_groups(make_docs(spark, every)).collect()}
    assert [got[i].component_id for i in range(len(every))] == want
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(every))] == prints
    assert simhash_groups(make_docs(spark, every).limit(0)).count() == 0


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(2)
    steps = set(_steps(2))

    def key(x):
        return sum(((x >> 16 * i & 0xFFFF).bit_count() + 2) << 5 * i for i in range(4))

    for _ in range(500):
        x = int(rng.integers(0, 1 << 63))
        y = x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        assert abs(key(x) - key(y)) in steps


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7), (900, 901), (901, 900)] + [(1000, 2000 + i) for i in range(300)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[450] == 400 and got[901] == 900
    assert {got[2000 + i] for i in range(300)} == {1000}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard(a, b, width=5):
    s = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in ((a or "").lower().split(), (b or "").lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_dedup_by_similarity(spark):
    rng = random.Random(11)
    texts = [words(rng, 150) for _ in range(80)]
    for i in range(0, 20):
        w = texts[i].split()
        w[rng.randrange(150)] = "changed"
        texts.append(" ".join(w))
    half = [" ".join(texts[i].split()[:75]) + " " + words(rng, 75) for i in range(30, 40)]
    texts += [*half, texts[0], None, "", "a b", "a b"]
    docs = make_docs(spark, texts)
    want = components(len(texts), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    got = {r.doc_id: r.component_id for r in similar_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if want[i] == i}


def test_dedup_keeps_rows_without_id(spark):
    docs = make_docs(spark, ["same text", "same text", "same text"], ids=[None, 3, 3])
    assert sorted(str(r.doc_id) for r in dedup(docs).collect()) == ["3", "None"]


def test_dedup_in_a_template_family(spark):
    rng = random.Random(5)
    template = words(rng, 200).split()
    texts = []
    for _ in range(50):
        w = list(template)
        for k in rng.sample(range(200), 6):
            w[k] = f"own{rng.randrange(10**6)}"
        twin = list(w)
        for k in rng.sample(range(200), 3):
            twin[k] = f"own{rng.randrange(10**6)}"
        texts += [" ".join(w), " ".join(twin)]
    alike = np.array([[jaccard(a, b) >= 0.8 for b in texts] for a in texts])
    want = components(len(texts), lambda i, j: alike[i, j])
    docs = make_docs(spark, texts)
    assert 30 <= len(set(want)) < 75
    for block in (1 << 18, 5000):
        got = {r.doc_id: r.component_id for r in similar_groups(docs, shingles_per_block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_dedup_down_to_the_least_similarity(spark):
    rng = random.Random(6)
    texts, near = [], 0
    while near < 150:
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 300))]
        twin = list(w)
        for k in rng.sample(range(len(w)), round(len(w) * 0.0235)):
            twin[k] = "other"
        if 0.8 <= jaccard(" ".join(w), " ".join(twin)) < 0.85:
            near += 1
            texts += [" ".join(w), " ".join(twin)]
    got = {r.doc_id: r.component_id for r in similar_groups(make_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]
