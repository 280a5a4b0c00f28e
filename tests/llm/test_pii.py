import hashlib
import random
import re

import numpy as np

from lifelog.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return pii.order(found)


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for alphabet in ("ab1@.9+- (2_%5\n", "0123456789 -.", "a@b.c-@.", "+1 ()-2.3"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000) == []
    assert pii.base_spans("1" * 300_000) == []
    assert pii.base_spans("a" * 200_000 + "@b.c") == [("email", 0, 200_004)]


def test_viterbi_against_every_path():
    field = pii.default_field()
    rng = np.random.default_rng(0)
    lengths = np.array([1, 3, 2, 4, 1])
    scores = rng.normal(0, 3, (lengths.sum(), len(pii.LABELS)))
    got, at = field.viterbi(scores, lengths), 0
    for n in lengths:
        best = None
        for code in range(len(pii.LABELS) ** n):
            path = [code // len(pii.LABELS) ** k % len(pii.LABELS) for k in range(n)]
            total = sum(scores[at + k, y] for k, y in enumerate(path))
            total += sum(field.move[a, b] for a, b in zip([0, *path], [*path, 0]))
            if best is None or total > best[0]:
                best = (total, path)
        assert got[at:at + n].tolist() == best[1]
        at += n


def test_held_out_accuracy():
    field, right, total = pii.default_field(), 0, 0
    for tokens, labels in pii.labelled_table(300, seed=99):
        runs = pii.hot_runs(tokens)
        rows = [pii.features(tokens, i) for a, b in runs for i in range(a, b)]
        gold = [labels[i] for a, b in runs for i in range(a, b)]
        got = [pii.LABELS[y] for y in field.viterbi(field.scores(rows), np.array([b - a for a, b in runs], np.int64))]
        right, total = right + sum(x == y for x, y in zip(got, gold)), total + len(gold)
    assert right / total > 0.97


def test_what_the_field_adds():
    texts = ["call (017) 555-7713 now", "two 4539578763621486 4539578763621486 x", "mail joe(at)mail.com", "on 2024-01-02 at 10:30 v1.2.3",
             "pay 1234567812345678 here"]
    spans = [pii.written(a) for _, a in pii.all_spans(texts, pii.default_field())]
    assert spans == ["phone:5:19", "card:4:20,card:21:37", "email:5:20", "", ""]


def test_query(spark, sf, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.op2_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in pii.KINDS]
        assert set(pii.written(base).split(",")) - {""} <= set(r.spans.split(","))


def test_redaction_and_odd_rows(spark, odd, empty):
    assert pii.redact("a joe@x.com b", [("email", 2, 11)]) == "a [EMAIL] b"
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}
    out = pii.redacted_documents(spark, odd, "")
    assert out.columns == odd.columns and out.where("text IS NULL").count() == 1
    assert pii.personal_data(empty).count() == 0
