import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lifelog.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(key, text):
    """The contract, by slices of a list of units."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return key, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return key, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def rows(spark, docs):
    done = fim.digests(fim.fill_in_middle(docs, F.col("doc_id")))
    names = ("key", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return sorted((tuple(r[c] for c in names) for r in done.collect()), key=repr)


def texts(seed, count):
    rng = random.Random(seed)
    parts = ["abc", "Zeile", "é", "\U0001f600", " ", "\n", "<", "P>", "<S", ">", "123", "\0", "x" * 50, "ß", "<M"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("size", [5, 17, 1 << 15])
def test_frames_are_the_text(size, monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", size)
    rng = random.Random(size)
    for text in texts(size, 60):
        data = text.encode()
        store = fim.Frames()
        at = 0
        while at < len(data):
            step = rng.randint(1, 30)
            store.write(data[at:at + step])
            at += step
        store.close()
        units = UNIT.findall(text)
        assert (store.bytes, store.chars, store.units) == (len(data), len(text), len(units))
        assert b"".join(store.read(0, store.bytes)) == data
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert store.seek_unit(u) == (len(before.encode()), len(before))
        a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        assert b"".join(store.read(a, b)) == data[a:b]
        for mark in (b"<P>", b"<S>", b"a"):
            assert store.find(mark, a) == data.find(mark, a)


def test_only_the_frames_of_cuts_are_decompressed(monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", 64)
    store = fim.Frames()
    store.write(b"word and word " * 400)
    store.close()
    asked = []
    real = fim.Frames._data
    monkeypatch.setattr(fim.Frames, "_data", lambda self, k: asked.append(k) or real(self, k))
    store.seek_unit(1000)
    assert len(asked) == 1 and len(store.rows) > 80
    assert len(list(store.read(640, 700))) == 1 and len(asked) == 2


@pytest.mark.parametrize("size", [7, 1 << 15])
def test_against_slices(spark, monkeypatch, size):
    monkeypatch.setattr(fim, "FRAME_BYTES", size)
    docs = list(enumerate(texts(3, 300))) + [(None, "no id but text"), (5, None), (6, ""), (7, "has <P> in it"), (8, "x" * 5000)]
    df = spark.createDataFrame([(*d, b"") for d in docs], "doc_id long, text string, frames binary")
    got = rows(spark, df)
    assert got == sorted((plain(*d) for d in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_query(spark, sf, docs):
    want = sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in fim.op12_fim(spark, sf).collect()), key=repr) == want
    assert all(r[6] == hashlib.sha256((t or "").encode()).hexdigest() for r, t in zip(want, [
        {d.doc_id: d.text for d in docs.collect()}[w[0]] for w in want]))


def test_output_rows_grow_by_bytes(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(fim, "OUT_BYTES", 200)
    want = sorted((plain(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert rows(spark, odd) == want
    assert rows(spark, empty) == []
