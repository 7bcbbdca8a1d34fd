from __future__ import annotations

import hashlib
import math
import random
from binascii import crc32

import duckdb
from demandspark.llm import prefix_trie
from demandspark.llm.prefix_trie import OP13_SQL, conversation_trie, op13_prefix_trie, with_texts

SCHEMA = "conv_id long, turn int, role string, text string, depth string, members long"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        childless = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    return sorted((tuple(r) for r in conversation_trie(spark.createDataFrame([(*r, "kept", 7)[:6] for r in rows], SCHEMA)).drop("digest").collect()), key=repr)


def made(rng, convs, longest=12, kinds=3):
    return [(c, t, rng.choice(["user", "assistant", None]) if t % 4 == 3 else "user", rng.choice(["", "ä" * 3, "text", None, "other"][:kinds])) for c in convs for t in range(rng.randint(0, longest))]


def test_against_brute_force(spark):
    rng = random.Random(13)
    rows = made(rng, range(40), kinds=2) + made(rng, range(100, 120), kinds=5)
    rows += [(c, None if t % 2 else 5, "user", rng.choice("ab")) for c in (200, 201, 203) for t in range(6)]  # null and equal turns
    rows += [(7, 0, "user", "text")] * 3 + [(None, 0, "user", "text"), (1 << 40, 1, None, None), (-3, 0, "user", "")]
    assert trie(spark, rows) == brute(rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    """A third of all rows in one conversation, others copied many times, cut into many buckets and chunks."""
    monkeypatch.setattr(prefix_trie, "BUCKET_BITS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rng = random.Random(5)
    rows = [(1000, t, "user", rng.choice("ab")) for t in range(150)]
    rows += [(c, t, "user", "same") for c in range(60) for t in range(4)]
    rows += [(2000 + c, t, "user", "abc"[t % 3]) for c in range(3) for t in range(70)]
    assert trie(spark, rows) == brute(rows)


def test_empty_table_and_turnless(spark):
    assert trie(spark, []) == []
    # conversations whose base is absent or short: some end at the root
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9, 11, 12)]
    got = trie(spark, rows)
    assert got == brute(rows)
    assert got[0][4:6] != (0, 0)


def test_texts(spark):
    convs = spark.createDataFrame([(0, 0, "user", "hi", "x", 1), (0, 1, None, None, "x", 1)], SCHEMA)
    assert sorted((r.depth, r.role, r.text) for r in with_texts(conversation_trie(convs), convs).collect()) == [(0, None, None), (1, "user", "hi"), (2, "", "")]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(map(tuple, op13_prefix_trie(spark, folder).select(*cols).collect()), key=repr)
    assert got == sorted(c.sql(f"select {', '.join(cols)} from ({OP13_SQL})").fetchall(), key=repr)
