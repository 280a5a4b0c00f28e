"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary and its scores come from a public model file, read by the library of that name; the
segmentation is computed here.  It is the one of greatest total score: at each character the best
way to reach it, over pieces of at most the vocabulary's longest.  The encoder keeps a window of
that length.  As soon as the backpointer paths of all positions in the window meet at one boundary,
no later text can change what lies before it: those ids are committed and their state is dropped,
so memory does not follow the text.  Ties go to the longer last piece.

A space reads as the meta character, and one is put before the text.  A character of the text that
no piece spells, and the meta character itself, is spelt as its UTF-8 bytes; a byte counts like an
unknown piece, ten below the least score.  Decoding gives back every text exactly.

No piece of the usual vocabularies goes on over the start of a word, or from letters to other
characters.  Where that holds for the loaded one, those places are boundaries for every path, and ids
of the short stretches between them are kept in a bounded memory for the next time.

Defined results: a null text has null ids; an empty text has no ids; repeated rows stay; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from lifelog.llm.common import documents, map_rows

META = "▁"
#: Model file; a cluster names its own place, or ships the file with the job.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Stretches whose ids each of a worker's two generations remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 24


class Vocabulary:
    """Pieces with ids and scores; byte pieces apart."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        """``pieces`` by id; an empty piece stands for an id that spells nothing."""
        self.text = [p for p, _ in pieces]
        self.byte_ids = byte_ids
        byte_set = set(byte_ids)
        self.ids = {p: (i, s) for i, (p, s) in enumerate(pieces) if p and i not in byte_set}
        self.longest = max(map(len, self.ids), default=1)
        finite = [s for _, s in self.ids.values() if s > -1e8]
        self.unknown = min(finite, default=0.0) - 10.0
        # Every prefix of a piece; None where the prefix is no piece itself.
        self.prefixes: dict[str, tuple[int, float] | None] = {p[:n]: None for p in self.ids for n in range(1, len(p))}
        self.prefixes |= self.ids
        self.spelling = [b"" if i in byte_set else p.replace(META, " ").encode("utf-8", "surrogatepass")
                         for i, p in enumerate(self.text)]
        for b, i in enumerate(byte_ids):
            self.spelling[i] = bytes((b,))
        self.cuts = self._cuts()

    def _cuts(self) -> re.Pattern | None:
        """Stretches of text between boundaries that no piece goes over, if pieces leave such.

        Letters and other characters are kept apart, but for the letters that some piece joins to
        others; meta characters lead a stretch.
        """
        joined = {c for p in self.ids for c in p if len(re.findall(r"[^\W\d_]+|[\W\d_]+", p.strip(META))) > 1}
        apart = "".join(re.escape(c) for c in sorted(joined) if re.match(r"[^\W\d_]", c))
        for letter, other in ((rf"[^\W\d_{apart}]+", rf"(?:(?!{META})[\W\d_{apart}])+"), (f"[^{META}]+", f"[^{META}]+")):
            cuts = re.compile(f"{META}*(?:{letter}|{other})|{META}+")
            if all(len(cuts.findall(p)) == 1 for p in self.ids):
                return cuts
        return None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        pieces = [(sp.id_to_piece(i) if plain[i] else "", sp.get_score(i)) for i in range(n)]
        return cls(pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


#: No piece begins so.
NONE = (-1, 0.0)


class StreamingEncoder:
    """``feed`` takes meta-text in any cuts and yields committed ids; ``finish`` yields the rest.

    ``literal`` marks a private character that stands for a meta character of the text.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base = 0  # text position of window[0]
        self.window = ""  # characters from the last commit on
        self.best = [0.0]  # best score of each position of the window; None if no path ends there
        self.back: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # start of the last piece, its ids
        self.done = 0  # positions of the window whose outgoing pieces are all known
        self.held = 0  # the most positions held at once

    def feed(self, text: str, final: bool = False) -> Iterator[int]:
        v, longest = self.v, self.v.longest
        at = 0
        while at < len(text) or (final and self.done < len(self.window)):
            # Take a window's worth, extend every position that sees its longest piece, then try to commit.
            self.window += text[at:at + longest]
            at += longest
            size = len(self.window)
            self.best += [None] * (size + 1 - len(self.best))
            self.back += [(0, ())] * (size + 1 - len(self.back))
            stop = size if final and at >= len(text) else max(self.done, size - longest + 1)
            for i in range(self.done, stop):
                self._extend(i, v)
            self.done = stop
            self.held = max(self.held, size)
            yield from self._commit()

    def _extend(self, i: int, v: Vocabulary) -> None:
        score = self.best[i]
        window, best, prefixes = self.window, self.best, v.prefixes
        c = window[i]
        for j in range(i + 1, len(best)):
            found = prefixes.get(window[i:j], NONE)
            if found is NONE:
                break
            if found is not None:
                total = score + found[1]
                if best[j] is None or total > best[j]:
                    best[j] = total
                    self.back[j] = (i, (found[0],))
        if c not in v.ids:
            spelt = (META if c == LITERAL else c).encode("utf-8", "surrogatepass")
            total = score + v.unknown * len(spelt)
            if best[i + 1] is None or total > best[i + 1]:
                best[i + 1] = total
                self.back[i + 1] = (i, tuple(v.byte_ids[b] for b in spelt))

    def _commit(self) -> Iterator[int]:
        # Live ends: positions that may still get an outgoing piece.  Their paths are followed back
        # together, always from the furthest, until one boundary is left.
        live = {i for i in range(self.done, len(self.best)) if self.best[i] is not None}
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(self.back[far][0])
        meet = live.pop()
        if meet == 0:
            return
        ids: list[tuple[int, ...]] = []
        at = meet
        while at:
            at, piece = self.back[at]
            ids.append(piece)
        for piece in reversed(ids):
            yield from piece
        self.base += meet
        self.window = self.window[meet:]
        shift = self.best[meet]
        self.best = [None if b is None else b - shift for b in self.best[meet:]]
        self.back = [(a - meet, p) for a, p in self.back[meet:]]
        self.back[0] = (0, ())
        self.done = max(0, self.done - meet)

    def finish(self) -> Iterator[int]:
        yield from self.feed("", final=True)


#: Stands for a meta character that the text itself has; a noncharacter, itself spelt as bytes.
LITERAL = "﷐"


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # Ids of stretches seen lately, in two generations: a full younger one becomes the older.
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _segment(self, word: str) -> tuple[int, ...]:
        if len(word) <= self.v.longest and LITERAL not in word:
            ids = self._window(word)
            if ids is not None:
                return ids
        encoder = StreamingEncoder(self.v)
        return (*encoder.feed(word), *encoder.finish())

    def _window(self, word: str) -> tuple[int, ...] | None:
        """Ids of a word that fits in one window, where the encoder commits once, at its end.

        None if a character needs its bytes.
        """
        n, prefixes = len(word), self.v.prefixes
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for i in range(n):
            score = best[i]
            if word[i] not in prefixes or score is None:
                return None
            for j in range(i + 1, n + 1):
                found = prefixes.get(word[i:j], NONE)
                if found is None:
                    continue
                if found is NONE:
                    break
                total = score + found[1]
                old = best[j]
                if old is None or total > old:
                    best[j] = total
                    back[j] = (i, found[0])
        if best[n] is None:
            return None
        out = []
        while n:
            n, piece = back[n]
            out.append(piece)
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if LITERAL in text:
            return [i for k, part in enumerate(re.split(f"({LITERAL})", text)) for i in (
                [self.v.byte_ids[b] for b in LITERAL.encode()] if k % 2 else self._encode(part, k == 0))]
        return self._encode(text, True)

    def _encode(self, text: str, first: bool) -> list[int]:
        meta = (META if first else "") + text.replace(META, LITERAL).replace(" ", META)
        if self.v.cuts is None:
            return list(self._segment(meta)) if meta else []
        out: list[int] = []
        get = self.young.get
        for word in self.v.cuts.findall(meta):
            ids = get(word)
            if ids is None:
                ids = self.old.get(word) or self._segment(word)
                if len(word) <= REMEMBERED_LENGTH:
                    if len(self.young) >= REMEMBERED:
                        self.old, self.young = self.young, {}
                        get = self.young.get
                    self.young[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes joined as UTF-8, meta characters as spaces, the first one dropped."""
        if not len(ids):
            return ""
        whole = b"".join(map(self.v.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return whole[1:] if whole[:1] == " " else whole


def model_path(path: str) -> str:
    """``path`` on this machine: as it is, or the file of that name shipped with the job."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(Vocabulary.load(model_path(path)))


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of the ids as 32-bit little-endian integers."""
    return hashlib.sha256(np.asarray(ids, dtype="<i4").tobytes()).hexdigest()


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, round_trip): the ids, and whether decoding them gives the text."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        c = codec(model)
        ids = [None if t is None else c.encode(t) for t in batch["text"]]
        return pd.DataFrame({
            "doc_id": batch["doc_id"], "ids": pd.Series([i if i is None else np.asarray(i, np.int32) for i in ids], dtype=object), "n_tokens": [len(i or ()) for i in ids],
            "ids_sha256": [ids_digest(i or ()) for i in ids],
            "round_trip": [t is None or c.decode(i) == t for t, i in zip(batch["text"], ids)]})

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        c = codec(model)
        return pd.DataFrame({"doc_id": batch["doc_id"], "text": [None if i is None else c.decode(i.tolist()) for i in batch["ids"]]})

    kind = dict(encoded.dtypes)["doc_id"]
    return map_rows(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document."""
    return encode_documents(docs)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``."""
    return encode_documents(documents(spark, sf_dir))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE: dict[str, str] = {}
