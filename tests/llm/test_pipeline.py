import re

import corpus_pipeline
from lifelog.llm import pii, sentencepiece
from lifelog.llm.common import documents
from lifelog.staging import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_take_effect(spark, sf):
    tables, docs = {}, documents(spark, sf)
    columns = docs.columns
    tables["input"] = docs.collect()
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf), f"test-{name}")
        tables[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "simhash", "pii", "mixture", "sentencepiece"]
    ids = {n: {r.doc_id for r in rows} for n, rows in tables.items()}
    assert len(ids["language"]) >= 0.98 * len(ids["input"])
    kept = tables["simhash"]
    assert len({r.text for r in kept}) == len(kept) == len(ids["simhash"])
    removed = ids["language"] - ids["simhash"]
    sets = {r.doc_id: shingles(r.text) for r in tables["language"]}
    for i in removed:  # nothing unlike goes
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i)
    assert ids["pii"] == ids["simhash"]
    for r in tables["pii"]:
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
    assert ids["mixture"] <= ids["pii"]
    by_id = {r.doc_id: r.text for r in tables["mixture"]}
    assert len(tables["sentencepiece"]) == len(tables["mixture"])
    codec = sentencepiece.codec(sentencepiece.MODEL)
    for r in tables["sentencepiece"]:
        assert codec.decode(r.ids) == by_id[r.doc_id]


def test_run_is_the_stages(spark, sf):
    docs = documents(spark, sf)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf), "test-run")
    count = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert count(corpus_pipeline.run(spark, sf)) == count(docs)


def test_odd_rows(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, function in corpus_pipeline.STAGES:
            docs = stage(function(spark, docs, ""), "test-odd")
            assert name == "sentencepiece" or docs.columns == table.columns
        assert docs.where("NOT round_trip").count() == 0
