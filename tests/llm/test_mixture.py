import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lifelog.llm import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, left = {}, share * sum(sizes.values())
    open_ = set(sizes)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_query_against_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in mixture.op1_mixture(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    sizes, sources = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}, {r.doc_id: r.source for r in rows}
    total = defaultdict(int)
    for i, n in sizes.items():
        total[sources[i]] += n
    target, taken = filled(total), defaultdict(int)
    for i, r in got.items():
        assert (r.size, r.source_size) == (sizes[i], total[sources[i]])
        assert r.target == pytest.approx(target[sources[i]])
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[i]] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(2, total[s] // mixture.MIN_BLOCKS + 1)
    again = {r.doc_id: r.taken for r in mixture.op1_mixture(spark, sf).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_shards_are_disjoint_and_even(spark, docs):
    rows = mixture.mix(docs, carry=["doc_id"], shard_bits=3).select("row.doc_id", F.inline("pieces")).collect()
    spans, shards = defaultdict(list), defaultdict(int)
    for r in rows:
        spans[r.doc_id, r.epoch].append((r.start, r.stop))
        shards[r.shard] += r.stop - r.start
    for pieces in spans.values():
        pieces.sort()
        assert all(a[1] <= b[0] for a, b in zip(pieces, pieces[1:]))
    assert set(shards) == set(range(8))
    mean = sum(shards.values()) / 8
    assert all(abs(n - mean) < 0.1 * mean for n in shards.values())


def test_draw_follows_the_law(spark):
    draw = mixture.hypergeometric((F.col("id") + 0.5) / 20_000, F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"))
    counts = {r.x: r.n for r in spark.range(20_000).select(draw.alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}
    from math import comb

    for x in range(11):
        assert counts.get(x, 0) / 20_000 == pytest.approx(comb(20, x) * comb(30, 10 - x) / comb(50, 10), abs=2e-4)


def test_whole_documents(spark, sf, docs):
    mixed = mixture.mixed_documents(spark, docs, sf)
    assert mixed.columns == docs.columns
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2
    assert mixed.select("doc_id", "text").distinct().exceptAll(docs.select("doc_id", "text")).count() == 0


def test_odd_rows(spark, odd, empty):
    rows = mixture.mix(odd, carry=["doc_id", "key", "size"]).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r.row.doc_id in (2, 3, 4)} == {0}
    assert all(not r.pieces for r in rows if not r["size"])
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert mixture.mixed_documents(spark, odd, "").columns == odd.columns
    assert mixture.mix(empty).count() == 0
