import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lifelog.llm import spotsigs

STOP = set(spotsigs.ANCHORS)


def plain_signatures(text):
    words = re.findall(r"[^\W_]+", text.lower())
    content = [(i, w) for i, w in enumerate(words) if w not in STOP]
    found = {f"{words[a - 1]}:{w} {content[k + 1][1]}" for k, (a, w) in enumerate(content[:-1]) if a and words[a - 1] in STOP}
    if not found and words:
        found = {" ".join(words[i:i + 2]) for i in range(len(words) - 1)} | {words[-1]}
    if not found and text:
        found = {text}
    return found


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_query_against_brute_force(spark, sf, docs):
    rows = {r.doc_id: r for r in spotsigs.op5_spotsigs(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, nxt in zip(order, order[1:] + order[:1]):
        text, cut = texts[i], len(texts[i]) // 3
        edited = text[:len(text) - cut] + texts[nxt][:cut]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, n = map(plain_signatures, (text, edited, texts[nxt]))
        assert r.fingerprint == hashlib.md5("\n".join(sorted(a, key=str.encode)).encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (pytest.approx(jaccard(a, e)), pytest.approx(jaccard(a, n)))


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(spotsigs.ORACLE["op5_spotsigs"]).fetchall())
    assert sorted(map(tuple, spotsigs.op5_spotsigs(spark, sf).collect())) == want


def test_ranges_of_ids_do_not_change_the_next(spark, docs):
    few = docs.where("doc_id < 60")
    one = sorted(map(tuple, spotsigs.neighbour_likeness(few, rows=1000).collect()))
    assert sorted(map(tuple, spotsigs.neighbour_likeness(few, rows=7).collect())) == one


def test_near_pairs_against_brute_force(spark, docs):
    base = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    rows = list(base)
    for i, t in base[:25]:
        words = t.split(" ")
        for k in range(1 + i % 4):
            words[len(words) * (k + 1) // 7] = "changed"
        rows += [(1000 + i, " ".join(words)), (2000 + i, t)]
    rows += [(3000, None), (3001, ""), (3002, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tau in (0.8, 0.5):
        members, pairs = spotsigs.near_pairs(df, F.col("doc_id"), tau)
        classes = {r.doc_key: r["class"] for r in members.collect()}
        assert len(classes) == len(rows)
        sets = {classes[i]: plain_signatures(t or "") for i, t in rows}
        want = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= tau}
        got = {(r["class"], r.other): r.likeness for r in pairs.collect()}
        assert got == pytest.approx(want)


def test_odd_rows(spark, odd, empty):
    rows = spotsigs.neighbour_likeness(odd).collect()
    assert len(rows) == odd.count()
    none = [r for r in rows if r.doc_id in (2, 3)]
    assert {r.n_signatures for r in none} == {0} and len({r.fingerprint for r in none}) == 1
    twins = [r for r in rows if r.doc_id == 1]
    assert twins[0].fingerprint == twins[1].fingerprint and 1.0 in {r.near_next for r in twins}
    single = spotsigs.neighbour_likeness(odd.where("doc_id = 7")).collect()
    assert [(r.near_next, r.near_edited > 0) for r in single] == [(1.0, True)]
    assert spotsigs.neighbour_likeness(empty).count() == 0
