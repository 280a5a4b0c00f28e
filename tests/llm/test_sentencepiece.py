import random

import sentencepiece as library

from lifelog.llm import sentencepiece as sp


def best_path(v, meta):
    """Viterbi over the whole text at once."""
    n = len(meta)
    best, back = [0.0] + [None] * n, [None] * (n + 1)
    for i in range(n):
        steps = [(i + k, v.ids[meta[i:i + k]][1], (v.ids[meta[i:i + k]][0],)) for k in range(1, v.longest + 1)
                 if i + k <= n and meta[i:i + k] in v.ids]
        if meta[i] not in v.ids:
            data = (sp.META if meta[i] == sp.LITERAL else meta[i]).encode()
            steps.append((i + 1, v.unknown * len(data), tuple(v.byte_ids[b] for b in data)))
        for j, score, ids in steps:
            if best[j] is None or best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, ids)
    out = []
    while n:
        n, ids = back[n]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def meta_text(text):
    return sp.META + text.replace(sp.META, sp.LITERAL).replace(" ", sp.META)


def test_streams_cut_anywhere_give_the_best_path():
    codec, rng = sp.codec(sp.MODEL), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("the in  er\n▁é€😀²1.ab") for _ in range(rng.randint(1, 60)))
        meta, at = meta_text(text), 0
        encoder, got = sp.StreamingEncoder(codec.v), []
        while at < len(meta):
            step = rng.randint(1, 9)
            got += encoder.feed(meta[at:at + step])
            at += step
        got += encoder.finish()
        assert got == best_path(codec.v, meta) == codec.encode(text)
        assert codec.decode(got) == text


def test_memory_is_bounded_and_ids_leave_early():
    encoder, out = sp.StreamingEncoder(sp.codec(sp.MODEL).v), 0
    for _ in range(3000):
        out += len(list(encoder.feed("thtionerinealy")))
    assert encoder.held <= 3 * encoder.v.longest and out > 10_000


def test_vocabularies_whose_pieces_cross_words():
    pieces = [(p, s) for p, s in (("a", -3.0), ("b", -3.0), (sp.META, -3.0), (f"a{sp.META}b", -1.0), ("ab", -2.0), ("b1", -1.5), ("1", -4.0))]
    v = sp.Vocabulary(pieces + [("", 0.0)] * 256, [len(pieces) + b for b in range(256)])
    assert v.cuts is None
    codec = sp.Codec(v)
    for text in ("a b", "ab ab a b1", "b b1 é", "aaaa bbbb"):
        assert codec.encode(text) == best_path(v, meta_text(text)) and codec.decode(codec.encode(text)) == text


def test_decoding_agrees_with_the_library():
    processor, codec = library.SentencePieceProcessor(model_file=sp.MODEL), sp.codec(sp.MODEL)
    for text in ("Hello world, it is 12.5!", "déjà vu\nà la", "  two  spaces "):
        assert codec.decode(processor.encode(text)) == text
        assert processor.decode(codec.encode(text)) == text


def test_memory_of_stretches_changes_nothing(monkeypatch, docs):
    texts = [r.text for r in docs.limit(20).collect()]
    want = [sp.codec(sp.MODEL).encode(t) for t in texts]
    monkeypatch.setattr(sp, "REMEMBERED", 5)
    fresh = sp.Codec(sp.codec(sp.MODEL).v)
    assert [fresh.encode(t) for t in texts] == want


def test_query_round_trip(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = sp.op9_sentencepiece(spark, sf)
    rows = encoded.collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert {r.doc_id: r.text for r in sp.decode_documents(encoded).collect()} == texts
    for r in rows[:15]:
        assert list(r.ids) == best_path(sp.codec(sp.MODEL).v, meta_text(texts[r.doc_id]))


def test_odd_rows(spark, odd, empty):
    rows = sp.encode_documents(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip for r in rows)
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [None, []]
    assert sp.encode_documents(empty).count() == 0
