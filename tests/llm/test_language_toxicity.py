from __future__ import annotations

import math
import random
import re
from collections import Counter

import zstandard
from conftest_llm import make_docs, words
from demandspark.llm.language_id import identify, keep_known, learn_profiles
from demandspark.llm.toxicity import HEAD, TAIL, Scorer, learn, score_toxicity, train_dictionaries, typical_passages

KINDS = {"aa": ("the", "and", "ing", "er", "wh"), "bb": ("sch", "ung", "ei", "zu", "tz"), "cc": ("que", "eau", "ou", "ai", "oi")}


def sample(n=40, seed=1):
    rng = random.Random(seed)
    langs = [rng.choice(sorted(KINDS)) for _ in range(n)]
    return [words(rng, rng.randint(5, 60), KINDS[k]) for k in langs], langs


def test_languages(spark):
    texts, langs = sample(60)
    profiles = learn_profiles(make_docs(spark, texts, langs=langs)).cache()
    assert profiles.groupBy("lang").count().where("count > 300").count() == 0
    odd = [None, "", "123 !!!", "the", "x" * 3_000_000]
    fresh, true = sample(50, 2)
    got = {r.doc_id: r for r in identify(make_docs(spark, fresh + odd), profiles).collect()}
    assert sum(got[i].lang_pred == k for i, k in enumerate(true)) >= 48
    assert [got[50 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[50].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = keep_known(make_docs(spark, fresh + odd), profiles)
    assert set(kept.columns) == set(make_docs(spark, ["a"]).columns)
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(50)) <= ids and not ids & {50, 51, 52}
    assert {r.lang_pred for r in kept.collect()} == {"kept"}


def test_without_labels(spark):
    none = learn_profiles(make_docs(spark, ["abc", None]))
    assert none.count() == 0
    assert [r.lang_pred for r in identify(make_docs(spark, ["abc"]), none).collect()] == ["und"]


def slow_grams(text):
    """n-grams by plain loops."""
    counts, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f" {word} "
            counts.update(c for c in word)
            counts.update(w[i : i + 2] for i in range(len(w) - 1))
            counts.update(w[i : i + 3] for i in range(len(w) - 2))
            word = ""
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return {code(g): n for g, n in counts.items()}


def slow_language(text, profiles, size=300):
    counts = slow_grams(text)
    if not counts or not profiles:
        return "und", 0.0
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    best = []
    for lang, ranks in sorted(profiles.items()):
        total, rank, last = 0, 0, None
        for place, (g, n) in enumerate(ranked):
            rank, last = (place, n) if n != last else (rank, n)
            total += min(size, abs(ranks[g] - rank)) if g in ranks else size
        best.append((total, lang))
    total, lang = min(best)
    return lang, 1 - total / (len(ranked) * size)


def test_against_brute_force(spark):
    texts, langs = sample(80, 7)
    texts += ["², ³ ¼", "x²y", "École ÉCOLE école"]
    langs += [None, "aa", "cc"]
    docs = make_docs(spark, texts, langs=langs)
    learned = {}
    for r in learn_profiles(docs).collect():
        learned.setdefault(r.lang, {})[r.gram] = r["rank"]
    for lang in KINDS:
        total = Counter()
        for t, k in zip(texts, langs, strict=True):
            if k == lang:
                total.update(slow_grams(t))
        assert learned[lang] == {g: i for i, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:300])}
    asked, _ = sample(40, 9)
    asked += [None, "", "²³", "12", "Zu ²² zu", texts[0] * 50]
    got = {r.doc_id: r for r in identify(make_docs(spark, asked), learn_profiles(docs)).collect()}
    for i, t in enumerate(asked):
        lang, score = slow_language(t, learned)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-9, t


def test_many_languages_and_empty_tables(spark):
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} text" for i in range(600)]
    docs = make_docs(spark, texts, langs=[f"l{i:03d}" for i in range(600)])
    profiles = learn_profiles(docs)
    assert profiles.select("lang").distinct().count() == 600
    got = {r.doc_id: r.lang_pred for r in identify(docs, profiles).collect()}
    assert sum(got[i] == f"l{i:03d}" for i in range(600)) > 550
    assert learn_profiles(docs.limit(0)).count() == 0 and identify(docs.limit(0), profiles).count() == 0 and keep_known(docs.limit(0), profiles).count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["vileword", "grimslur", "nastyish"]
    texts = [words(rng, rng.randint(20, 80)) for _ in range(240)]
    toxic = [int(i % 4 == 0) for i in range(240)]
    for i, y in enumerate(toxic):
        if y:
            w = texts[i].split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
            texts[i] = " ".join(w)
    docs = make_docs(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(160)] + [(241, None), (None, 1)], "doc_id long, toxic int")
    scorer = learn(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, scorer).collect()}
    right = [got[i].predicted == toxic[i] for i in range(160, 240)]
    assert sum(right) >= 76
    assert all(0 <= r.score <= 1 for r in got.values()) and got[240].score == got[241].score and got[241].predicted == 0
    blank = learn(docs, labels.where("toxic = 0"))
    assert {r.score for r in score_toxicity(docs.limit(3), blank).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), scorer).count() == 0


def test_dictionary_saves_bytes():
    ordinary = ["plain words of no harm"] * 30
    s = Scorer(*train_dictionaries(["some vileword here"] * 30, ordinary))
    assert s.distance(b"vileword") >= 3 > s.distance(b"plain") == s.distance(b"") == 0


def test_passages_are_those_that_chance_does_not_bring():
    rng = random.Random(1)
    base = [words(rng, 40) for _ in range(400)]
    toxic = [t + " grimslur" if i % 2 else t + " oddmark" * 3 for i, t in enumerate(base[:60])]
    found = typical_passages(toxic, [t + " oddmark" if i % 9 == 0 else t for i, t in enumerate(base[60:])])
    assert any(b"grims" in f for f in found) and any(b"oddma" in f for f in found)
    assert all(any(f.strip() in w for w in (b"grimslur", b"oddmark")) for f in found)
    assert typical_passages(base[:60], base[60:]) == [] and typical_passages([], base) == typical_passages(base, []) == []


def test_scores_against_brute_force(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(1, 120)) + (" vileword" * rng.randint(1, 4) if i % 3 == 0 else "") for i in range(150)]
    scorer = Scorer(*train_dictionaries(texts[0:60:3], [t for i, t in enumerate(texts[:60]) if i % 3]))
    scorer.fit(texts[60:120], [int(i % 3 == 0) for i in range(60, 120)], [1.0] * 60)
    asked = [*texts[120:], None, "", "?!", "vileword " * 20_000]
    got = {r.doc_id: r for r in score_toxicity(make_docs(spark, asked), scorer).collect()}
    size = lambda content, window: len(zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))
    for i, t in enumerate(asked[:-1]):
        d = []
        for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) or [""]:
            whole = HEAD + f" {w} ".encode() + TAIL
            d.append(size(scorer.dictionaries[0], whole) - size(scorer.dictionaries[1], whole))
        top, n = sorted(d, reverse=True)[:8], len(d)
        two, three = sum(x >= 2 for x in d), sum(x >= 3 for x in d)
        mean = lambda x: sum(x) / len(x)
        f = [top[0], mean(top[:2]), mean(top[:4]), two / n, math.log((two + 0.1) / n), math.log((three + 0.1) / n), math.log1p(two), math.log1p(three), math.log1p(n)]
        z = sum((x - m) / s * w for x, m, s, w in zip(f, scorer.mean, scorer.spread, scorer.weights[:-1], strict=True)) + scorer.weights[-1]
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert got[i].predicted == int(got[i].score >= 0.3)
    assert got[len(asked) - 1].predicted == 1
