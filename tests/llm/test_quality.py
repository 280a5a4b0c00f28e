import zlib

import numpy as np
import pytest

from lifelog.llm import quality


def test_query_on_the_held_out_fold(spark, sf):
    rows = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [i for i in labels if rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_scores_are_sums_of_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs  # only an interaction tells
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9
    for row in x[:20]:
        total = model.intercept
        for k, table in enumerate(model.tables):
            total += table[sum(c <= row[k] for c in model.cuts[k])]
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[sum(c <= row[i] for c in model.pair_cuts[i]), sum(c <= row[j] for c in model.pair_cuts[j])]
        assert model.logits(row[None])[0] == pytest.approx(total)


def test_shallow_tree_takes_the_best_cut():
    steps = quality.shallow_tree(np.array([5.0, 5, -5, -5]), np.full(4, 10.0), depth=1)
    assert steps[0] == steps[1] > 0 > steps[2] == steps[3]


def test_without_two_kinds_of_labels():
    for x, y in ((np.zeros((0, 16)), np.zeros(0, int)), (np.ones((5, 16)), np.ones(5, int))):
        scores = quality.train(x, y).scores(np.zeros((3, 16)))
        assert np.allclose(scores, (y.sum() + 1) / (len(y) + 2))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (6, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(*quality.training_sample(odd, labels))
    rows = quality.quality_scores(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(empty, model).count() == 0
    assert all(np.isfinite(quality.text_features(t)).all() for t in (None, "", " \n", "x"))
