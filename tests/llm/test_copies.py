import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lifelog.llm import copies
from lifelog.llm.simhash import shard_links
from lifelog.staging import stage


def test_near_copies_stay_once(spark, sf):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) + str(g) for _ in range(200)]
        rows.append((g * 10, " ".join(text)))
        rows.append((g * 10 + 1, " ".join(text)))
        near = list(text)
        near[rng.randrange(200)] = "changed"
        rows.append((g * 10 + 2, " ".join(near)))
    rows += [(500, None), (501, ""), (502, "just one"), (503, "Just  ONE"), (None, "no id"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id for r in copies.distinct_documents(spark, docs, sf).collect()), key=str)
    assert kept == sorted([g * 10 for g in range(12)] + [500, 502, None], key=str)


def like_groups(texts, least=0.8):
    """All pairs: the smallest index linked to each text, and the likeness of the linked pairs."""
    sets = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    up, found = list(range(len(sets))), []

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-12:
                found.append(both / (len(sets[i]) + len(sets[j]) - both))
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(sets))], found


def stay(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = copies.numbered(docs).select("row", "doc.doc_id", "doc.text").withColumnRenamed("doc_id", "id")
    return sorted(r.id for r in copies.near_copies(rows).where("stays").collect())


def test_chains_without_a_hub(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(8):  # each version is like the next one only
        words = [f"w{rng.randrange(10**6)}" for _ in range(240)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = words[20:] + [f"w{rng.randrange(10**6)}" for _ in range(20)]
    first, found = like_groups(texts)
    assert len(set(first)) == 8 and len(found) == 8 * 11
    order = list(range(len(texts)))
    rng.shuffle(order)
    mixed = [texts[i] for i in order]
    assert stay(spark, mixed) == sorted(set(like_groups(mixed)[0]))


def test_every_band_of_likeness(spark):
    rng = random.Random(13)
    frame = [f"frame{i}" for i in range(60)]  # in a third of the texts, so common
    texts = []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 400))]
        words = frame + words if k % 3 == 0 else words
        new = max(1, round(len(words) * rng.uniform(0.01, 0.14)))
        block = [f"w{rng.randrange(10**6)}" for _ in range(new)]
        at = rng.randrange(len(words) - new)
        texts += [" ".join(words), " ".join(words + block) if k % 2 else " ".join(words[:at] + block + words[at + new:])]
    first, found = like_groups(texts)
    bands = np.histogram(found, [0.8, 0.85, 0.9, 0.95, 1])[0]
    assert min(bands) >= 10
    assert stay(spark, texts) == sorted(set(first))


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            out, word = out + [word] if word else out, ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] if word else out


def test_sets_prefixes_and_parities():
    rng = random.Random(1)
    pool = ["a", "B", "b", "é", "x" * 30, "\U0001f600", "w1", "W1"]
    texts = [rng.choice(["", " ", "\n"]).join([""] + rng.choices(pool, k=rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", " ", "one two three four", "one two three four five", "a b a b a b a b a b"]
    found, bounds = copies.sets(pa.array(texts), 5)
    plain = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(words_of, texts)]
    got = [frozenset(found[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(g) for g in got] == [len(p) for p in plain] == np.diff(bounds).tolist()
    of = {}
    for i, p in enumerate(plain):
        for j, q in enumerate(plain):
            assert len(got[i] & got[j]) == len(p & q)
        of[frozenset(p)] = got[i]
    common = np.unique(found)[::3]
    first, cut = copies.prefixes(found, bounds, 0.8, common, np.arange(1, len(common) + 1))
    odd = [np.unpackbits(np.array(p, np.int64).view(np.uint8), bitorder="little") for p in copies.parities(found, bounds).to_pylist()]
    for i in range(len(texts)):
        kept = set(first[cut[i]:cut[i + 1]].tolist())
        assert kept <= got[i]
        for j in range(len(texts)):
            both = len(got[i] & got[j])
            if both and both >= 0.8 * len(got[i] | got[j]):
                assert kept & set(first[cut[j]:cut[j + 1]].tolist())
            half = min(len(odd[i]), len(odd[j]))
            one, two = (o.reshape(-1, half).sum(axis=0) % 2 for o in (odd[i], odd[j]))
            assert (one != two).sum() <= len(got[i] ^ got[j])


def test_long_sets_get_more_parities(spark):
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(6000)]
    texts = [" ".join(words), " ".join(words[:5800] + ["x", "y"]), " ".join(words[2500:]), " ".join(words[:300]), " ".join(words[:290])]
    found, bounds = copies.sets(pa.array(texts))
    assert [len(p) * 64 for p in copies.parities(found, bounds).to_pylist()] == [16384, 16384, 8192, 1024, 1024]
    nodes = spark.createDataFrame(
        [(i, int(n), p) for i, (n, p) in enumerate(zip(np.diff(bounds), copies.parities(found, bounds).to_pylist()))],
        "node long, size long, parities array<long>")
    pairs = spark.createDataFrame([(a, b) for b in range(5) for a in range(b)], "a long, b long")
    assert sorted(tuple(r) for r in copies.possible(pairs, nodes, 0.8).collect()) == [(0, 1), (3, 4)]
    assert sorted(tuple(r) for r in copies.possible(pairs, nodes, 0.5).collect()) == [(0, 1), (0, 2), (1, 2), (3, 4)]


def test_a_split_shard_loses_no_pair(spark, monkeypatch):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = np.unique(np.array([c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(35)], np.uint64))
    assert len(fps) > 1000
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 6
    label = np.arange(len(fps))
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            break
        label = low
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").withColumn("node", F.col("fp"))
    monkeypatch.setattr(copies, "tree_plan", lambda count, blocks=8: 0)  # one shard holds all
    assert copies.tree_shards(nodes, len(fps), 6).select("shard").distinct().count() == 1
    monkeypatch.setattr(copies, "SHARD_MOST", 1000)  # and is split: the sample is everything
    keyed = copies.tree_shards(nodes, len(fps), 6)
    sizes = keyed.groupBy("shard").count()
    assert sizes.agg(F.sum("count")).first()[0] == 7 * len(fps) and sizes.agg(F.max("count")).first()[0] < 400
    roots = {r.node: r.root for r in copies.components(shard_links(keyed, 6)).collect()}
    got = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist()))


@pytest.mark.parametrize("name", ["_rows", "_kept_node", "row", "doc", "node", "id", "root", "prefix"])
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "other words in here now", 9)],
                                 f"doc_id long, text string, {name} int")
    kept = copies.distinct_documents(spark, docs, "")
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", 7), (3, "other words in here now", 9)]


def test_odd_tables(spark, odd, empty):
    assert copies.distinct_documents(spark, odd, "").columns == odd.columns
    assert copies.distinct_documents(spark, empty, "").count() == 0
    texts = stage(odd.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text"), "test-odd")
    rows = copies.near_copies(texts).collect()
    blank = {r.root for r in rows if r.id in (2, 3, 4)}
    assert len(rows) == 9 and len(blank) == 1 and sum(r.n for r in rows) == odd.count()
    assert [r.stays for r in rows if r.id is None] == [True]


def test_repeated_rows_stay_once(spark):
    docs = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (None, "no id"), (None, "no id")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in copies.distinct_documents(spark, docs, "").collect()) == [
        ("1", "same words here"), ("None", "no id")]


def test_a_passage_of_many_texts_brings_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(copies, "SAMPLED", 4)  # so few texts never show which passages repeat
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**9)}"
    passages = [[word() for _ in range(10)] for _ in range(4)]
    texts = [" ".join([word() for _ in range(60)] + passages[i % 4]) for i in range(400)]
    for size in (5, 9, 24, 64, 150):  # alike in every measure, with words more, fewer and others
        words = [word() for _ in range(size + 4)]
        for less in range(size // 5 + 1):
            texts += [" ".join(words), " ".join(words[less:]), " ".join(words[:-1] + [word()])]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    like = {(j, i) for i in range(len(sets)) for j in range(i)
            if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12}
    assert len(like) > 100
    rows = stage(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, id long, text string"), "test-texts")
    nodes = stage(copies.sketched(rows, 0.8, 5).withColumnRenamed("row", "node"), "test-nodes")
    none = spark.createDataFrame([], "node long, root long")
    met = {tuple(r) for r in copies.apart(nodes, none, 0.8).collect()}
    assert like <= met
    assert len({(a, b) for a, b in met if b < 400}) < 1000  # of the 19,800 that share a passage
