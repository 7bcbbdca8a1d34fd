from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, tile string, lang_pred string"


def make_docs(spark, texts, sources=None, langs=None, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    n = len(texts)
    rows = [((ids or range(n))[i], texts[i], langs[i] if langs else None, sources[i] if sources else None, len(texts[i]) if texts[i] is not None else None, 7.5, "kept", "kept", "kept") for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, syllables=("ba", "ce", "di", "fo", "gu", "ha", "li", "mo", "nu", "re", "st", "tra")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Empty, blank, null, tiny, repeated, near-equal and very long texts."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 80)) for _ in range(60)]
    long = words(rng, 30_000)
    near = words(rng, 200).split()
    variants = [" ".join(near[:k] + ["other"] + near[k + 1 :]) for k in (3, 90)]
    return [None, "", "  \t\n", "a", "A b", *base, base[0], base[0], long, long, " ".join(near), *variants, "Ünï çödé ﷽ 漢字 \U0001f600 x"]
