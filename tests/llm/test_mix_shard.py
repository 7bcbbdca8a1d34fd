from __future__ import annotations

import math
import random
import re

from conftest_llm import make_docs, words
from demandspark.llm.mixing import mix, mixed_documents, source_plan, taken_words
from demandspark.llm.sharding import cut_edges, shard
from pyspark.sql import functions as F


def fill(sizes, most=3, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def corpus(spark, n=300, seed=8):
    rng = random.Random(seed)
    sources = [rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"]) for _ in range(n)]
    texts = [rng.choice([None, "", words(rng, rng.randint(1, 60))]) if i % 9 == 0 else words(rng, rng.randint(1, 60)) for i in range(n)]
    return make_docs(spark, texts, sources=sources), texts, sources


def test_plan_is_water_filling(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1, None: 50}, {"a": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 7, "c": 9, "d": 1}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in source_plan(rows).collect()}
        want = fill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix(spark):
    docs, texts, sources = corpus(spark)
    rows = taken_words(mix(docs)).collect()
    assert len(rows) == len(texts)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    by = {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(sources[r.doc_id], [0, r.target])[0] += r.taken
    assert all(t == math.floor(want) for t, want in by.values())
    for block in (1, 7, 10**6):
        other = {r.doc_id: r.taken for r in taken_words(mix(docs, words=block)).collect()}
        assert other == {r.doc_id: r.taken for r in rows}
    again = {(r.doc_id, r.taken) for r in taken_words(mix(docs)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_schedule_is_balanced_and_loses_no_small_source(spark):
    rng = random.Random(3)
    many = {"big": 400, "mid": 60, "small": 2, "tiny": 1}
    sources = [s for s, n in many.items() for _ in range(n)]
    docs = make_docs(spark, [words(rng, 100) for _ in sources], sources=sources)
    mixed = mix(docs, words=64)
    plan = {r.source: r for r in mixed.plan.collect()}
    slots = sorted({(r.slot, r.source_rank) for r in mixed.schedule.collect()})
    assert len(slots) == len({s for s, _ in slots}) == sum(-(-math.floor(p.target) // 64) for p in plan.values())
    for s in many:  # at every point of the schedule each source is near its share
        share, seen = math.ceil(plan[s].target / 64) / len(slots), 0
        for place, (_, rank) in enumerate(slots, 1):
            seen += rank == plan[s].source_rank
            assert abs(seen - share * place) <= 6
    order = [r.slot for r in mixed.schedule.where("source_rank = 0").orderBy("block").select("slot", "block").distinct().orderBy("block").collect()]
    assert order == sorted(order)


def test_mix_repeats_and_empties(spark):
    same = make_docs(spark, ["one two three"] * 6, sources=["x"] * 6, ids=[1] * 6)
    assert [r.taken for r in taken_words(mix(same)).collect()] == [3] * 6
    assert taken_words(mix(same.limit(0))).count() == 0
    assert [r.taken for r in taken_words(mix(make_docs(spark, [None, ""]))).collect()] == [0, 0]


def test_mixed_documents(spark, tmp_path):
    docs, texts, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "d"))
    out = mixed_documents(spark.read.parquet(str(tmp_path / "d")))
    assert out.columns == docs.columns
    odd = docs.withColumn("_mix_row", F.lit("r")).withColumn("_mix_slot", F.lit("s"))
    kept = mixed_documents(odd)
    assert kept.columns == odd.columns and kept.select("_mix_row", "_mix_slot").distinct().collect() == [("r", "s")] and kept.count() == out.count()
    assert mixed_documents(docs.limit(0)).count() == 0 and mixed_documents(make_docs(spark, ["word " * 400_000, "a b"], sources=["x", "y"])).count() >= 2
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 3 and all((texts[i] or "").split() for i in n)


def test_shards_even_and_groups_together(spark):
    rng = random.Random(2)
    copies = [words(rng, 30) for _ in range(20)]
    texts = [words(rng, rng.randint(5, 60)) for _ in range(500)] + [c for c in copies for _ in range(4)] + [None, "", ""]
    done = shard(make_docs(spark, texts)).cache()
    rows = done.collect()
    assert len(rows) == len(texts)
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 1 for r in rows)
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 0.05 * sum(load) / 8
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    cut = cut_edges(done).first()
    assert cut.linked == 83 and cut.cuts <= 12
    assert done.select("text_crc32").where(F.col("text_crc32") < 0).count() == 0


def test_hot_group_and_empty(spark):
    texts = ["hot text of a third"] * 200 + [f"text number {i} of the rest" for i in range(400)]
    load = [r["n"] for r in shard(make_docs(spark, texts)).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(load) == 8 and max(load) - min(load) <= 0.06 * sum(load) / 8
    assert shard(make_docs(spark, texts).limit(0)).count() == 0
    assert shard(make_docs(spark, ["a"])).count() == 1


def test_shards_against_what_must_hold(spark):
    """Groups that a shard can hold stay whole before the levelling of sizes needs them cut; only what exceeds a shard is cut on purpose."""
    rng = random.Random(4)
    groups = [words(rng, rng.randint(20, 40)) for _ in range(12)]
    texts = [g for g in groups for _ in range(rng.randint(2, 40))] + [words(rng, rng.randint(1, 20)) for _ in range(900)] + ["big one " * 20] * 120
    docs = make_docs(spark, texts)
    rows = shard(docs).collect()
    sizes, total = [len(t.encode()) + 1 for t in texts], sum(len(t.encode()) + 1 for t in texts)
    load = [0] * 8
    for r in rows:
        load[r.shard] += sizes[r.doc_id]
    assert max(load) - min(load) <= 0.05 * total / 8
    touched = {}
    for r in rows:
        if r.linked:
            touched.setdefault(r.group, set()).add(r.shard)
    heavy = {g for g in touched if sum(sizes[r.doc_id] for r in rows if r.group == g) > total / 8}
    assert len(heavy) == 1 and sum(len(s) - 1 for g, s in touched.items() if g not in heavy) <= 8
    assert {(r.doc_id, r.shard, r.slot) for r in shard(docs).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
    long = shard(make_docs(spark, ["x" * 3_000_000, "y", None]).withColumn("group", F.lit(1)).withColumn("slot", F.lit(2))).collect()
    assert sorted(r["size"] for r in long) == [1, 2, 3_000_001]
