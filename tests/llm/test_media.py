from __future__ import annotations

import numpy as np
from demandspark.llm.media import Asking, Pcm, align, chroma, classes_of, fingerprint, keys_of, match_recordings, recordings, search_result

PCM = Pcm("s16", 8000, 1024, 256)


def melody(seed, seconds=6.0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(8000 * seconds)) / 8000
    notes = 440 * 2 ** (rng.integers(-12, 12, int(seconds * 4)) / 12)
    return (np.sin(2 * np.pi * notes[np.minimum((t * 4).astype(int), len(notes) - 1)] * t) * 12000).astype("<i2")


def test_chroma_of_a_tone():
    t = np.arange(8000) / 8000
    for semitone in (0, 3, 7):
        c = chroma(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t).astype(np.float32), PCM)
        assert (c.argmax(1) == semitone).all()
    assert not chroma(np.zeros(4000, np.float32), PCM).any()


def test_short_and_empty():
    assert len(fingerprint(None, PCM)) == len(fingerprint(b"", PCM)) == 0
    assert len(fingerprint(b"abc", PCM)) == len(fingerprint(melody(3)[:2000].tobytes(), PCM)) == 4 < len(fingerprint(melody(3).tobytes(), PCM))


def test_alignment():
    a = fingerprint(melody(1).tobytes(), PCM)
    b = a[20:90]
    assert align(b, a)[0] == 20 and align(b, a)[3] == 0
    assert align(a, fingerprint(melody(2).tobytes(), PCM))[3] > 0.2


def test_matches(spark):
    clip = melody(1)
    noisy = (clip + np.random.default_rng(0).normal(0, 100, len(clip))).astype("<i2")
    cut = clip[256 * 12 :]
    rows = [(0, clip.tobytes()), (1, clip.tobytes()), (2, noisy.tobytes()), (3, cut.tobytes()), (4, melody(9).tobytes()), (5, None), (6, b""), (7, b"x")]
    media = spark.createDataFrame(rows, "id long, audio binary")
    prints = recordings(media, PCM, "id", "audio")
    classes = classes_of(prints, prints["_id"] == 0)
    assert {r.class_id: r.copies for r in classes.collect()} == {0: 2, 2: 1, 3: 1, 4: 1, 5: 2, 7: 1}
    found = match_recordings(media, PCM, "id", "audio", classes, classes.where("asked"))
    got = {r.class_id: r for r in found.collect()}
    assert set(got) == {2, 3}
    assert got[3].offset == -12 and got[3].bit_error == 0 and got[2].offset == 0
    rows = search_result(prints, classes, found).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows if r.kind == "member") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert sorted((r.query_class, r.class_id, r.offset) for r in rows if r.kind == "link") == [(0, 2, 0), (0, 3, -12)]


def test_empty_table_ties_and_clashing_names(spark):
    kind = "id long, audio binary, prints string, _sha string, _id string"
    media = spark.createDataFrame([], kind)
    none = recordings(media, PCM, "id", "audio")
    classes = classes_of(none, none["_id"] == 0)
    assert search_result(none, classes, match_recordings(media, PCM, "id", "audio", classes, classes.where("asked"))).count() == 0
    clip = melody(1).tobytes()
    prints = recordings(spark.createDataFrame([(3, clip, "a", "b", "c"), (2, clip, "a", "b", "c"), (None, clip, "a", "b", "c")], kind), PCM, "id", "audio")
    assert {(r.class_id, r.copies) for r in classes_of(prints, prints["_id"] == 3).collect()} == {(2, 3)}


def test_matches_against_brute_force(spark):
    rng = np.random.default_rng(5)
    clips = [melody(k, 3.0) for k in range(12)]
    for k in range(12):  # cut, noisy and spliced versions, silence before, a common jingle behind
        c = clips[k]
        clips.append(c[256 * int(rng.integers(1, 20)) :])
        clips.append((c + rng.normal(0, 300, len(c))).astype("<i2"))
        clips.append(np.concatenate([np.zeros(256 * 30, "<i2"), c, clips[0][:6000]]))
    clips += [np.zeros(20_000, "<i2"), np.zeros(30_000, "<i2"), clips[0][:500]]
    media = spark.createDataFrame([(k, c.tobytes()) for k, c in enumerate(clips)], "id long, audio binary")
    prints = recordings(media, PCM, "id", "audio")
    classes = classes_of(prints, prints["_id"] % 3 == 0)
    held = [fingerprint(c.tobytes(), PCM) for c in clips]
    want = {}
    for q in range(0, len(clips), 3):
        for k in range(len(clips)):
            if q != k and len(np.intersect1d(keys_of(held[q]), keys_of(held[k]))):
                offset, votes, overlap, error = align(held[k], held[q])[0], *align(held[q], held[k])[1:]
                del offset
                if votes >= 2 and overlap >= 4 and error <= 0.25:
                    want[q, k] = round(error, 9)
    found = match_recordings(media, PCM, "id", "audio", classes, classes.where("asked"))
    assert {(r.query_class, r.class_id): round(r.bit_error, 9) for r in found.collect()} == want and len(want) > 20


def test_recall_of_near_copies(spark):
    """Texts read as sound, as the registered query does: nine of ten near copies with a few changed words are linked, wherever the changes stand."""
    texts, pcm = [], Pcm("u8", 8000, 64, 8)
    for k in range(240):
        if k % 60 == 0:
            rng = np.random.default_rng(8 + k // 60)
        word = lambda: "".join(rng.choice(list("aeinorst"), rng.integers(2, 9)))  # noqa: B023, E731
        base = [word() for _ in range(int(rng.integers(120, 400)))]
        other = list(base)
        for _ in range(len(base) // 60):  # about five shingles each: a similarity of some 0.85
            at = int(rng.integers(len(other)))
            other[at : at + int(rng.integers(0, 2))] = [word()]
        texts += [(100 * k, " ".join(base)), (100 * k + 1, " ".join(other))]
    media = spark.createDataFrame([(i, t.encode()) for i, t in texts], "id long, audio binary")
    prints = recordings(media, pcm, "id", "audio")
    classes = classes_of(prints, prints["_id"] % 100 == 0)
    links = {(r.query_class, r.class_id) for r in match_recordings(media, pcm, "id", "audio", classes, classes.where("asked")).collect()}
    assert sum((100 * k, 100 * k + 1) in links for k in range(240)) >= 216
    assert all(b == a + 1 for a, b in links)


def test_every_pair_that_meets_is_found(spark):
    """Equal integers that aren't neighbours, in long texts with changes everywhere: all links of brute force, by the thresholds alone."""
    rng, pcm, texts = np.random.default_rng(2), Pcm("u8", 8000, 64, 8), []
    for k in range(12):
        words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(300)]
        texts.append((100 * k, " ".join(words)))
        for j in range(1, 5):  # every 25th word and more of them changes
            texts.append((100 * k + j, " ".join("x" * len(w) if i % (60 - 10 * j) == 0 else w for i, w in enumerate(words))))
    texts += [(7000, "a" * 3000), (7001, "a" * 2500), (7002, "a" * 3000 + texts[0][1])]
    media = spark.createDataFrame([(i, t.encode()) for i, t in texts], "id long, audio binary")
    rows = recordings(media, pcm, "id", "audio")
    classes = classes_of(rows, rows["_id"] % 100 == 0)
    found = match_recordings(media, pcm, "id", "audio", classes, classes.where("asked")).collect()
    held, want = {i: fingerprint(t.encode(), pcm) for i, t in texts}, {}
    for q in (i for i, _ in texts if i % 100 == 0):
        for i in held:
            offset, votes, overlap, error = align(held[q], held[i])
            if q != i and votes >= 2 and overlap >= 4 and error <= 0.25:
                want[q, i] = (offset, votes, overlap, round(error, 9))
    assert {(r.query_class, r.class_id): (r.offset, r.votes, r.overlap, round(r.bit_error, 9)) for r in found} == want and len(want) > 40


def test_meetings_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    held = [rng.integers(0, 6, int(rng.integers(5, 60))).astype(np.uint32) for _ in range(20)]
    other = rng.integers(0, 7, 80).astype(np.uint32)
    for pieces in (1, 50, 1 << 22):
        monkeypatch.setattr("demandspark.llm.media.MEETINGS", pieces)
        got = {k: rest for k, *rest in Asking(np.arange(20), held).aligned(other, 2)}
        assert got == {k: list(align(h, other)) for k, h in enumerate(held)}
