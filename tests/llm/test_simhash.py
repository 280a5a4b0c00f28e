import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lifelog.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("a b c", 42)


def test_query_against_brute_force(spark, sf, docs):
    rows = {r.doc_id: r for r in simhash.op6_simhash(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    least = {}
    labels = groups(fps, 3)
    for i, g in zip(ids, labels):
        least[g] = min(least.get(g, i), i)
    assert [rows[i].component_id for i in ids] == [least[g] for g in labels]


def test_trees_find_every_pair():
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(20)})
    shard = np.array([i % 3 for i in range(len(fps))])
    by = np.argsort(shard, kind="stable")
    shard, fp = shard[by], np.array(fps, np.uint64)[by]
    old, simhash.FRONTIER = simhash.FRONTIER, 64
    try:
        got = {tuple(sorted(p)) for a, b in simhash.Forest(shard, fp).pairs(5) for p in zip(a.tolist(), b.tolist())}
    finally:
        simhash.FRONTIER = old
    want = {(i, j) for j in range(len(fp)) for i in range(j) if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 5}
    assert got == want
    for radius in (2, 3, 5):
        first = simhash.Forest(shard, fp).groups(radius)
        plain = [groups([int(f) for f in fp[shard == k]], radius) for k in range(3)]
        for k in range(3):
            assert len(set(zip(first[shard == k].tolist(), plain[k]))) == len(set(plain[k])) == len(set(first[shard == k].tolist()))


def test_a_dense_group_is_one():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = np.unique(np.array([base ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 3))) for _ in range(60_000)], np.uint64))
    forest = simhash.Forest(np.zeros(len(fps), int), fps)
    assert len(set(forest.groups(3).tolist())) == 1


def test_every_scheme_of_blocks_is_complete(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), 3)) for b in base for _ in range(6)} | set(base))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").withColumn("node", F.col("fp"))
    want = len(set(groups(fps, 3)))
    for blocks in (4, 5, 6, 7):
        links = simhash.shard_links(simhash.shard_keys(df, blocks, blocks - 3), 3)
        roots = {r.node: r.root for r in simhash.components(links).collect()}
        assert len({roots.get(s, s) for s in signed}) == want
    assert simhash.block_plan(10**5, 3) == (4, 1)
    assert simhash.block_plan(3 * 10**10, 3)[0] > 5


def test_long_chain(spark):
    links = spark.range(1, 400).select(F.col("id").alias("node"), (F.col("id") - 1).alias("other"))
    assert {r.root for r in simhash.components(links).collect()} == {0}


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd, F.col("doc_id")).collect()
    assert len(rows) == odd.count()
    assert {r.component for r in rows if r.fp == 0} == {2}
    assert [r.component for r in rows if r.doc_key is None] == [None]
    assert simhash.near_duplicates(empty, F.col("doc_id")).count() == 0
