"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans.  The field reads white-space tokens and adds what the patterns
cannot: numbers that a longer run of digits hides, telephone numbers without a country sign, mail
addresses with a spelt-out at sign or a host without a dot.  It is trained here from a small
labelled table.  A token without a digit, an ``@`` or a bracketed "at" can only be outside, in
training and in decoding, so a text falls into runs of the other tokens, and decoding the runs by
themselves is exact.  Runs of an Arrow batch are decoded together by Viterbi in numpy.

A span of the field must also be sound (digits, Luhn sum, octets) and must not touch a base span.

Defined results: null and empty texts have no spans; repeated rows stay; an empty table gives no
rows; other columns are not read.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import WORD, documents, map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[str, int, int]

_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT = re.compile(r"@(?=([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_WORD = re.compile(WORD)
_NUMBER = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> list[Span]:
    # The local part is the run before the sign, cut where the last match ended; taking it from
    # the sign backwards keeps long runs linear.
    found, end = [], 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < end:
            continue
        low = max(end, text.rfind("@", 0, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL_PART))
        if start < at:
            end = m.end(1)
            found.append(("email", start, end))
    return found


def _ips(text: str) -> list[Span]:
    found = []
    for chain in _DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        numbers = [m.span() for m in _NUMBER.finditer(text, *chain.span())]
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i:i + 4]
            if all(octet(text[a:b]) for a, b in four):
                found.append(("ip", four[0][0], four[3][1]))
    return found


def _cards(text: str) -> list[Span]:
    found = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    return found


def _phones(text: str) -> list[Span]:
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    spans = _emails(text) if "@" in text else []
    if _NUMBER.search(text):
        spans += _ips(text) + _cards(text) + _phones(text)
    return order(spans)


# --- the field -------------------------------------------------------------------------------------------------

_EDGE = "\"'`<>()[]{},;:!?."
_CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone", "reach"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte"),
    "ip": ("ip", "host", "server", "address", "from"), "email": ("mail", "email", "e-mail", "write", "contact"),
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}


def shape(token: str) -> str:
    """Letters as ``a``, runs of digits as ``9`` with their length, other characters as they are."""
    core = token.strip(_EDGE.replace("(", "").replace(")", ""))
    if len(core) > 64:
        return "long"
    core = re.sub(r"[(\[]at[)\]]", "@", core, flags=re.IGNORECASE)
    core = _NUMBER.sub(lambda m: f"9{{{min(len(m.group()), 20)}}}", core)
    return re.sub(r"[^\W\d_]+", "a", core)


def features(tokens: list[str], i: int) -> list[str]:
    """Features of a hot token: its shape and parts of it, its neighbours' shapes, a cue word before it."""
    own = shape(tokens[i])
    digits = sum(map(str.isdigit, tokens[i]))
    sides = [shape(tokens[j]) if 0 <= j < len(tokens) and _HOT.search(tokens[j]) else "-" for j in (i - 1, i + 1)]
    cue = next((_CUE[w] for w in (tokens[j].strip(_EDGE).lower() for j in (i - 1, i - 2) if j >= 0) if w in _CUE), "-")
    return [f"s={own}", f"n={min(digits, 20)}", f"@={'@' in own}", f"+={own[:1] == '+'}", f".={min(own.count('.'), 4)}",
            f"p={sides[0]}", f"q={sides[1]}", f"s={own}|p={sides[0]}", f"s={own}|q={sides[1]}", f"c={cue}",
            f"c={cue}|n={min(digits, 20)}", "bias"]


def labelled_table(rows: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences as tokens and their labels, made from patterns of writing."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9)))
    host = lambda: f"{word()}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de', 'fr', 'es'])}"
    octets = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    private = {
        "email": [lambda: f"{word()}@{host()}", lambda: f"{word()}.{digits(2)}@{host()}", lambda: f"{word()}@{word()}",
                  lambda: f"{word()}(at){host()}", lambda: f"{word()}[at]{host()}"],
        "ip": [octets, lambda: f"{octets()}:{digits(4)}"],
        "card": [lambda: digits(16), lambda: digits(15), lambda: "-".join(digits(4) for _ in range(4)),
                 lambda: " ".join(digits(4) for _ in range(4)), lambda: ".".join(digits(4) for _ in range(4)),
                 lambda: f"{digits(4)} {digits(6)} {digits(5)}", lambda: digits(13)],
        "phone": [lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
                  lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}",
                  lambda: f"+{digits(2)} {digits(3)} {digits(7)}", lambda: f"+{digits(11)}"],
    }
    plain = [lambda: digits(rng.randint(1, 6)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
             lambda: f"{digits(2)}:{digits(2)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}",
             lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{word()}{digits(2)}", lambda: f"{digits(4)}-{digits(4)}",
             lambda: f"@{word()}", lambda: f"#{digits(4)}", lambda: f"{digits(3)} {digits(3)}", lambda: digits(rng.randint(8, 12)),
             lambda: f"{word()}-{digits(1)}.{digits(1)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: digits(rng.randint(20, 30))]
    table = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(rng.randint(1, 4)):
            filler = [word() for _ in range(rng.randint(0, 3))]
            kind = rng.choice((*KINDS, "O", "O", "O"))
            if kind != "O" and rng.random() < 0.3:
                filler.append(rng.choice(_CUES[kind]))
            made = (rng.choice(plain) if kind == "O" else rng.choice(private[kind]))()
            if rng.random() < 0.2:
                made += rng.choice(".,;")
            parts = made.split(" ")
            tokens += [*filler, *parts]
            labels += ["O"] * len(filler) + (["O"] * len(parts) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(parts) - 1)])
        table.append((tokens, labels))
    return table


def hot_runs(tokens: list[str]) -> list[tuple[int, int]]:
    """(first, end) of runs of tokens that may be inside."""
    runs, start = [], None
    for i, t in enumerate(tokens):
        if _HOT.search(t):
            start = i if start is None else start
        elif start is not None:
            runs.append((start, i))
            start = None
    return runs + ([(start, len(tokens))] if start is not None else [])


def allowed() -> np.ndarray:
    """Which label may follow which: an inner label only its own kind."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [a[2:] == b[2:] and a != "O" for a in LABELS]
    return ok


_NEVER = -1e9


class Field:
    """Weights of features and transitions; runs begin and end beside an outside token."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        for i, names in enumerate(rows):
            known = [self.index[f] for f in names if f in self.index]
            if known:
                out[i] = self.emit[known].sum(axis=0)
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of runs whose tokens follow each other in ``scores``."""
        best = np.zeros(len(scores), np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        by = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[by], starts[by]
        state = self.move[0][None, :] + scores[starts] if len(starts) else np.zeros((0, len(LABELS)))
        back: list[np.ndarray] = []
        for t in range(1, int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t, "left"))  # runs longer than t
            step = state[:live, :, None] + self.move[None]
            back.append(step.argmax(axis=1).astype(np.int8))
            state[:live] = step.max(axis=1) + scores[starts[:live] + t]
        label = (state + self.move[:, 0][None, :]).argmax(axis=1)
        for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            best[starts[:live] + t] = label[:live]
            if t:
                label[:live] = back[t - 1][np.arange(live), label[:live]]
        return best


def train(table: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.1, ridge: float = 0.3) -> Field:
    """Maximum likelihood with a ridge, by Adam over forward and backward sums of all runs at once."""
    sequences = [([features(tokens, i) for i in range(a, b)], [LABELS.index(labels[i]) for i in range(a, b)])
                 for tokens, labels in table for a, b in hot_runs(tokens)]
    index: dict[str, int] = {}
    for rows, _ in sequences:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    n, longest, k, width = len(sequences), max(len(r) for r, _ in sequences), len(LABELS), len(features(["1"], 0))
    feats = np.full((n, longest, width), len(index))
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for s, (rows, labels) in enumerate(sequences):
        for t, row in enumerate(rows):
            feats[s, t], gold[s, t], mask[s, t] = [index[f] for f in row], labels[t], True
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    bar = np.where(allowed(), 0.0, _NEVER)
    lengths = mask.sum(axis=1)
    rows_n = np.arange(n)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    for r in range(1, rounds + 1):
        scores, trans = emit[feats].sum(axis=2), move + bar
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = trans[0] + scores[:, 0]
        for t in range(1, longest):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + trans, 1) + scores[:, t]
        for t in range(longest - 1, -1, -1):
            last = (lengths - 1 == t)[:, None]
            after = lse(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2) if t + 1 < longest else 0.0
            beta[:, t] = np.where(last, trans[:, 0], after)
        total = lse(alpha[rows_n, lengths - 1] + trans[:, 0], 1)
        p = np.exp(np.minimum(alpha + beta - total[:, None, None], 0.0)) * mask[..., None]
        d_emit, d_move = np.zeros_like(emit), np.zeros_like(move)
        p[rows_n[:, None], np.arange(longest), gold] -= mask
        np.add.at(d_emit, feats.reshape(-1, width), p.reshape(-1, 1, k))
        d_move[0] += p[:, 0].sum(axis=0)
        ends = np.exp(np.minimum(alpha[rows_n, lengths - 1] + trans[:, 0] - total[:, None], 0.0))
        ends[rows_n, gold[rows_n, lengths - 1]] -= 1
        d_move[:, 0] += ends.sum(axis=0)
        for t in range(1, longest):
            on = mask[:, t]
            pair = alpha[on, t - 1][:, :, None] + trans + (scores[on, t] + beta[on, t])[:, None, :] - total[on, None, None]
            d_move += np.exp(np.minimum(pair, 0.0)).sum(axis=0)
            np.subtract.at(d_move, (gold[on, t - 1], gold[on, t]), 1.0)
        for w, d, (m, v) in zip((emit, move), (d_emit, d_move), moments):
            d += ridge * w
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            w -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Field(index, emit[:-1].copy(), move + bar)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


def sound(kind: str, text: str) -> bool:
    """Whether a span of the field can be of its kind."""
    digits = "".join(filter(str.isdigit, text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", text)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ().-]+[0-9]", text)) and not re.search(r"[^0-9 ().+-]", text)
    if kind == "ip":
        parts = text.split(":")[0].split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]+", p) and octet(p) for p in parts)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(?:@|[(\[][aA][tT][)\]])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", text))


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Sound spans of the field in each text, decoded together."""
    places, rows, lengths = [], [], []
    for d, text in enumerate(texts):
        if not _HOT.search(text):
            continue
        spans = [m.span() for m in _WORD.finditer(text)]
        tokens = [text[a:b] for a, b in spans]
        for a, b in hot_runs(tokens):
            places.append((d, spans[a:b]))
            rows += [features(tokens, i) for i in range(a, b)]
            lengths.append(b - a)
    out: list[list[Span]] = [[] for _ in texts]
    labels = field.viterbi(field.scores(rows), np.array(lengths, np.int64))
    at = 0
    for (d, spans), n in zip(places, lengths):
        found: list[list] = []
        for (a, b), label in zip(spans, (LABELS[x] for x in labels[at:at + n])):
            if label[0] == "B":
                found.append([label[2:], a, b])
            elif label[0] == "I" and found:
                found[-1][2] = b
        at += n
        for kind, a, b in found:
            edge = _EDGE.replace("(", "") if kind == "phone" else _EDGE
            inner = texts[d][a:b]
            a += len(inner) - len(inner.lstrip(edge))
            b -= len(inner) - len(inner.rstrip(_EDGE))
            if a < b and sound(kind, texts[d][a:b]):
                out[d].append((kind, a, b))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        new = [s for s in more if not any(s[1] < b[2] and b[1] < s[2] for b in base)] if more else []
        out.append((base, order(base + new)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of touching spans replaced by the first one's kind."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, all spans."""
    field = field or default_field()

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = all_spans([t or "" for t in batch["text"]], field)
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        return pd.DataFrame({
            "doc_id": batch["doc_id"], **counts,
            "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found],
            "spans": [written(spans) for _, spans in found]})

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; null texts stay null."""
    field = field or default_field()

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        texts = batch["text"].tolist()
        found = all_spans([t or "" for t in texts], field)
        return batch.assign(text=[t and redact(t, spans) for t, (_, spans) in zip(texts, found)])

    return map_rows(docs, run, docs.schema)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its personal data replaced and its length counted anew."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op2_pii": op2_pii}
ORACLE: dict[str, str] = {}
