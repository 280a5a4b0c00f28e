import random
import re

import pytest
from pyspark.sql import functions as F

from lifelog.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, span=10):
    """doc -> (words, words hit, spans, items) from all windows."""
    wanted = []
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        if n:
            wanted += [(item, n, tuple(w[s:s + n])) for s in range(len(w) - n + 1)]
    out = []
    for key, text in docs:
        w, hit, met = words(text), set(), set()
        runs = []
        for n in sorted({n for _, n, _ in wanted}):
            of = {}
            for item, m, g in wanted:
                if m == n:
                    of.setdefault(g, set()).add(item)
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in of:
                    met |= of[tuple(w[s:s + n])]
                    hit |= set(range(s, s + n))
                    runs.append((s, s + n))
        spans = []
        for a, b in sorted(runs):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        out.append((key, len(w), len(hit), [tuple(s) for s in spans], sorted(str(m) for m in met if m is not None)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in df.collect()), key=repr)


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"), (2, "alpha BETA gamma"), (3, "alpha"), (4, "..."), (5, None),
    (6, "één twee drie vier vijf zes zeven acht negen tien elf"), (None, "no item id here at all but ten words or more, really"),
    (7, "three four five six seven eight nine ten eleven twelve thirteen"), (1, "second text of item one"), (8, "x y " * 12),
]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, fp int")


@pytest.mark.parametrize("joined", [False, True])
def test_against_all_windows(spark, bench, monkeypatch, joined):
    if joined:  # the way beyond the bound of a broadcast
        monkeypatch.setattr(winnowing, "BROADCAST_SPANS", 0)
    monkeypatch.setattr(winnowing, "SLICE_BYTES", 300)
    rng = random.Random(3)
    pool = [w for _, t in ITEMS for w in words(t)] + ["filler", "É", "straße", "7"]
    docs = []
    for k in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = words(rng.choice(ITEMS)[1])
            a = rng.randint(0, max(0, len(w) - 8))
            text += w[a:a + rng.randint(1, 14)] if rng.random() < 0.7 else rng.choices(pool, k=rng.randint(1, 12))
        sep = rng.choice([" ", ", ", "\n", " -- ", "_"])
        docs.append((k, sep.join(w.upper() if rng.random() < 0.3 and w.isascii() else w for w in text)))
    docs += [(3, docs[3][1]), (None, ITEMS[0][1]), (200, None), (201, ""), (202, " \t.")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, runs int").repartition(3)
    assert got(winnowing.contamination(df, bench)) == plain(docs, ITEMS)


def test_every_shared_span_is_found(spark):
    rng = random.Random(4)
    item = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(391):  # ten words from any place, between words of no item
        docs.append((k, " ".join([f"a{rng.random()}"] * 3 + item[k:k + 10] + ["z"] * 3)))
    docs += [(1000 + k, " ".join(["b"] + item[k:k + 9] + ["c"])) for k in range(391)]
    rows = {r.doc_id: r for r in winnowing.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert all(rows[k].n_hit == 10 and rows[k]["items"] == ["1"] for k in range(391))
    assert not any(rows[1000 + k].n_hit for k in range(391))


def test_full_sieve_changes_nothing(spark, bench, monkeypatch):
    docs = spark.createDataFrame([(k, f"{ITEMS[k % 8][1]} word {k}") for k in range(40)], "doc_id long, text string")
    want = got(winnowing.contamination(docs, bench))
    monkeypatch.setattr(winnowing, "_sifted", lambda fp, table: fp == fp)
    assert got(winnowing.contamination(docs, bench)) == want


def test_query_against_brute_force(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r[0]: r for r in plain([(r.doc_id, r.text) for r in docs.collect()], items)}
    rows = winnowing.op11_winnowing(spark, sf).collect()
    assert len(rows) == len(want) and any(r.contaminated for r in rows)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (*want[r.doc_id][1:3], len(want[r.doc_id][4]), want[r.doc_id][2] > 0)


def test_odd_rows(spark, odd, empty, bench):
    rows = winnowing.contamination(odd, bench)
    assert rows.count() == odd.count()
    assert {r.n_words for r in rows.where("doc_id = 2 OR doc_id = 3 OR doc_id = 4").collect()} == {0}
    assert winnowing.contamination(empty, bench).count() == 0
    assert winnowing.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = winnowing.clean_documents(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    again = odd.union(odd.limit(1).withColumn("text", F.lit(ITEMS[0][1])))
    assert winnowing.clean_documents(again, bench).count() == odd.count()
