import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from lifelog.llm import fertility

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_query_against_brute_force(spark, sf, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = fertility.op4_fertility(spark, sf).collect()
    assert len(rows) == len(texts)
    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    for r in rows:
        n = plain_counts(texts[r.doc_id])
        assert tuple(r[c] for c in fertility.COUNTS) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        counts = np.array(list(Counter(ids).values()))
        p = counts / counts.sum()
        assert r.token_entropy == pytest.approx(-(p * np.log2(p)).sum())


def test_verdict_against_the_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in fertility.op4_fertility(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id]]
    assert sum(good) >= 0.98 * len(good)


def test_bands_reject_what_is_far(spark):
    prose = ["the men of the house went to the sea and found that all of it was gone by the time that they came %d" % i for i in range(60)]
    rows = [(i, " ".join([t, *(f"w{i}x{k}" for k in range(45))]), "en") for i, t in enumerate(prose)]
    rows += [(100 + i, " ".join("እሰክ"[:1 + k % 3] + "Ꭰ" * (k % 4) + str(k) for k in range(60)), "en") for i in range(3)]
    out = {r.doc_id: r for r in fertility.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in range(60))
    assert not any(out[100 + i].kept for i in range(3)) and out[100].byte_share > 0.3


def test_repeats():
    for text in ("a b c a b c", "a a a a", "a b c d", "a b", "", "x y z w x y z"):
        words = text.split()
        assert fertility.repeated_words(words) == plain_counts(text)[4]
    assert fertility.script("привет") == "Cyrl" and fertility.script("123") == "Zyyy"


def test_odd_rows(spark, odd, empty):
    rows = fertility.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert [r.n_repeat_words for r in rows if r.doc_id == 6] == [40_000]
    assert fertility.quality_rules(empty).count() == 0


def test_copies_vote_once(spark):
    prose = "the men of the house went to the sea and found that all of it was gone by the time that they came"
    texts = [" ".join([prose, *(f"w{i}x{k}" for k in range(45))]) for i in range(60)]
    junk = " ".join("እሰክ" + str(k) for k in range(60))
    alone = [(i, t, "en") for i, t in enumerate(texts)]
    copied = alone + [(1000 + i, texts[0], "en") for i in range(400)] + [(2000 + i, junk, "en") for i in range(400)]

    def limits(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return {(r.group, r.octave): r for r in fertility.bands(fertility.measure(df)).collect()}

    assert limits(copied) == limits(alone + [(2000, junk, "en")])
    df = spark.createDataFrame(copied, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.quality_rules(df).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[2000 + i] for i in range(400))
