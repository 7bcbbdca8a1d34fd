from __future__ import annotations

import zlib

import numpy as np
from conftest_llm import make_docs
from demandspark.llm import packing
from demandspark.llm.packing import differencing, pack, token_ids, windows


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizer(texts):
    odd = ["a  b", " a", "a ", "\n\n x\t\ty", "it's we'll 'S", "naïve ÀÉ ¿qué?", "a\u00a0b", "a\u2003 b", "\x1c x \x85 y", "<|endoftext|> x", "x¹²½ Ⅷ", "ʼn ſ"]
    for t in [*texts, *odd]:
        assert token_ids(t).tolist() == reference_ids(t), t


def test_long_texts_are_cut_where_ids_allow(monkeypatch, texts):
    monkeypatch.setattr(packing, "PART", 50)
    for t in texts:
        assert token_ids(t).tolist() == reference_ids(t)


def test_differencing():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 2), (40, 7), (3, 8)):
        sizes = rng.integers(1, 500, n)
        window, sums = differencing(sizes, k)
        assert sorted(np.bincount(window, sizes, k).astype(int)) == sorted(sums.tolist())
    assert differencing(np.array([8, 7, 6, 5, 4]), 2)[1].tolist() == [16, 14]
    sizes = rng.integers(1, 512, 400)
    w = windows(sizes, 2048)
    assert np.bincount(w, sizes).max() <= 2048 and w.max() + 1 <= sizes.sum() / 2048 * 1.03 + 1


def test_pieces(spark, texts):
    rows = pack(make_docs(spark, texts * 2, ids=[*range(len(texts))] * 2), with_ids=True).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    for i, t in enumerate(texts):
        ids = reference_ids(t)
        pieces = sorted(by[i], key=lambda r: r.start)
        assert sum(p.length for p in pieces) == 2 * len(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
        for p in pieces:
            assert p.ids == ids[p.start : p.start + p.length]
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert pack(make_docs(spark, texts).limit(0)).count() == 0
