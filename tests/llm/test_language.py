import zlib

import numpy as np
import pytest

from lifelog.llm import language


def test_query_on_the_held_out_fold(spark, sf, docs):
    rows = {r.doc_id: r for r in language.op7_language(spark, sf).collect()}
    real = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == real.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not language.has_letter(real[i].text))
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].lang_pred == real[i].lang for i in held) >= 0.97 * len(held)


def test_held_out_rows_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.training_rows(docs), language.training_rows(other)
    assert [r[2] for r in a] == [r[2] for r in b]


def test_prediction_is_the_average(spark):
    rng = np.random.default_rng(0)
    table = rng.normal(0, 1, (1 << language.BUCKETS_BITS, 2))
    model = language.Model(["a", "b"], table, np.array([0.1, -0.1]), 2.0, 0.0)
    counts = language.subword_counts("Some words, some more")
    p = language.softmax((counts @ table / counts.sum() + model.bias) / 2.0)
    name, score, rejected = model.predict("Some words, some more")
    assert score == pytest.approx(p.max()) and name == "ab"[int(p.argmax())] and not rejected


def test_subwords_of_long_text_are_those_of_its_parts():
    text = "abc déf"
    long = language.subword_counts(" ".join([text] * 1000))
    assert (long[language.subword_counts(text) > 0] > 0).all()
    assert language.subword_counts("a").sum() == 3  # " a", "a ", " a "


def test_rejection_follows_the_sample():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        name = "ab"[i % 2]
        rows.append((np.array([i % 2, 2 + rng.integers(0, 50)]), np.array([3.0, 1.0]), name))
    model = language.train(rows)
    assert model.languages == ["a", "b"] and model.least < 1
    assert language.train([]).predict("text") == ("und", 0.0, True)


def test_strangers_are_rejected_and_clean_texts_stay(spark, sf, docs):
    model = language.train(language.training_rows(docs))
    strangers = ["xqzv bnmk plrt", "zzz qqq xxx www", "La volpe marrone veloce salta sopra il cane pigro e poi corre verso le colline.",
                 "Il gatto mangia il pesce nella cucina della nonna", "Съешь же ещё этих мягких французских булок"]
    assert all(model.predict(t)[2] for t in strangers)
    held = [r.text for r in docs.where(language.held_out(docs["doc_id"])).collect() if language.has_letter(r.text)]
    assert sum(model.predict(t)[2] for t in held) <= 0.02 * len(held)  # fifty texts, one of them may go


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_an_unlearnt_language_is_rejected(spark, left_out):
    many = language.documents(spark, "/root/testdata/sf0.01")
    known = language.training_rows(many.where(f"lang <> '{left_out}'"))
    model = language.train(known, epochs=3)
    texts = many.where(language.held_out(many["doc_id"])).collect()
    away = [model.predict(r.text)[2] for r in texts if r.lang == left_out and len(r.text or "") > 40]
    stay = [not model.predict(r.text)[2] for r in texts if r.lang != left_out and language.has_letter(r.text)]
    assert sum(away) >= 0.93 * len(away) and sum(stay) >= 0.99 * len(stay) - 1  # of about a hundred, one more may go


def test_strange_bound_needs_strangers():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(np.arange(k * 100, k * 100 + 60), 30, False)), np.ones(30), "ab"[k]) for k in (0, 1) for _ in range(60)]
    model = language.train([rows[i] for i in rng.permutation(120)])
    far = np.arange(500, 530)
    assert model.familiarity(far, np.ones(30) / 30, 0) < model.strange < model.familiarity(rows[0][0], np.ones(30) / 30, 0)


def test_odd_rows(spark, odd, empty):
    found = language.identify(odd).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 4, 7)} == {"und"}
    assert all(r.rejected and r.score == 0 for r in found if r.lang_pred == "und")
    kept = language.identified_documents(spark, odd, "")
    assert kept.columns == odd.columns and kept.where("doc_id IN (2, 3, 4, 7)").count() == 0
    assert language.identify(empty).count() == 0
