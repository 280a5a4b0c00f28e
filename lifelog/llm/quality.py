"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a row of features of its whole length.  A feature is cut into bins; boosting goes
round the features and each time fits one shallow tree on the gradient over that feature's bins,
adding its steps to the feature's lookup table.  Then the pairs of features whose joint bins still
explain most are boosted the same way into two-way tables.  A score is the sum of the table entries
of a text's bins, through a logistic function, as array additions for a batch at a time.

The model learns from a bounded sample of labelled rows outside the held-out fold; a fifth of it
stops the boosting.

Defined results: null and empty texts have features of their own and a score like any other; with no
label to learn from, or labels of one kind only, every score is the smoothed share of good labels;
null keys are held in; repeated rows stay, repeated labels of a key count once, as the best of them;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import WORD, crc_fold, documents, map_rows, unit
from lifelog.llm.fertility import repeated_words

#: Labelled rows to learn from, about.
SAMPLE = 8_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 300, 150, 0.1, 15

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "accents", "line_words",
            "dup_lines", "distinct", "top_word", "repeated", "short_words", "word_spread", "ends")

_WORDS = re.compile(WORD)
_SPACES = " \t\n\v\f\r"
#: Class of each ASCII byte: 1 upper, 2 lower, 3 digit, 4 symbol, 5 mark; others 0; bytes above are 6.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>{}[]=_~^\\/@+",
                             ".,;:!?'\"()-"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0xC0:] = 6  # first bytes of longer characters


def text_features(text: str | None) -> list[float]:
    text = text or ""
    words = _WORDS.findall(text)
    n = max(len(words), 1)
    counts = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
    chars = max(len(text) - sum(map(text.count, _SPACES)), 1)
    lengths = np.array([len(w) for w in words]) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), counts[1] / chars, counts[3] / chars,
        counts[4] / chars, counts[5] / chars, counts[6] / chars, np.log1p(len(words) / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(seen)) / np.log1p(n), max(seen.values(), default=0) / n,
        repeated_words(words) / n, float((lengths <= 3).mean()), float(lengths.std()),
        sum(line[-1] in ".!?" for line in lines) / max(len(lines), 1),
    ]


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """Steps of the regression tree over ordered bins that fits the Newton direction best."""
    steps = np.zeros(len(gradient))

    def split(a: int, b: int, left: int) -> None:
        g, h = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
        if left and b - a > 1:
            gl, hl = g[:-1], h[:-1]
            gr, hr = g[-1] - gl, h[-1] - hl
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g[-1] * g[-1] / (h[-1] + 1)
            gain[(hl < least) | (hr < least)] = 0
            at = int(gain.argmax())
            if gain[at] > 1e-9:
                split(a, a + at + 1, left - 1)
                split(a + at + 1, b, left - 1)
                return
        steps[a:b] = g[-1] / (h[-1] + 1)

    split(0, len(gradient), depth)
    return steps


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps over a grid from one cut of each axis, the best cross; and what it gains."""
    def corners(x: np.ndarray) -> tuple[np.ndarray, ...]:
        c = x.cumsum(0).cumsum(1)
        a, row, col, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, row - a, col - a, all_ - row - col + a

    gs, hs = corners(gradient), corners(weight)
    gain = sum(g * g / (h + 1) for g, h in zip(gs, hs))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = np.zeros_like(gradient)
    for (g, h), (rows, cols) in zip(zip(gs, hs), ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                                  (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        steps[rows, cols] = g[i, j] / (h[i, j] + 1)
    return steps, float(gain[i, j])


class Additive:
    """Cuts of each feature, one table per feature and per chosen pair, and the intercept."""

    def __init__(self, cuts: list[np.ndarray], pair_cuts: list[np.ndarray], intercept: float):
        self.cuts, self.pair_cuts, self.intercept = cuts, pair_cuts, intercept
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    @staticmethod
    def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if not len(x):
            return out
        bins = self.binned(x, self.cuts)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        if self.pairs:
            coarse = self.binned(x, self.pair_cuts)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                out += table[coarse[:, i], coarse[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def quantile_cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -logits, logits)).mean())


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of single features, then of the best pairs; each stops when the set-aside fifth does."""
    good = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Additive([np.zeros(0)] * width, [np.zeros(0)] * width, float(np.log(good / (1 - good))))
    model = Additive([quantile_cuts(x[:, k], BINS) for k in range(width)],
                     [quantile_cuts(x[:, k], PAIR_BINS) for k in range(width)], float(np.log(good / (1 - good))))
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = ~check
    bins, coarse = model.binned(x, model.cuts), model.binned(x, model.pair_cuts)
    logits = np.full(len(y), model.intercept)

    def boost(tables: list[np.ndarray], places: list[np.ndarray], step, rounds: int) -> None:
        best, kept, late = loss(logits[check], y[check]) if check.any() else np.inf, [t.copy() for t in tables], 0
        for _ in range(rounds):
            for table, at in zip(tables, places):
                p = 1 / (1 + np.exp(-logits))
                g = np.bincount(at[fit], weights=(y - p)[fit], minlength=table.size).reshape(table.shape)
                h = np.bincount(at[fit], weights=(p * (1 - p))[fit], minlength=table.size).reshape(table.shape)
                add = RATE * step(g, h)
                table += add
                logits[:] += add.ravel()[at]
            if check.any():
                now = loss(logits[check], y[check])
                late = 0 if now < best - 1e-5 else late + 1
                if now < best:
                    best, kept = now, [t.copy() for t in tables]
                if late >= PATIENCE:
                    break
        if check.any():
            for table, old, at in zip(tables, kept, places):
                logits[:] += (old - table).ravel()[at]
                table[:] = old

    boost(model.tables, [bins[:, k] for k in range(width)], shallow_tree, ROUNDS)
    p = 1 / (1 + np.exp(-logits))
    gains = []
    for i, j in combinations(range(width), 2):
        shape = (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
        if min(shape) > 1:
            at = (coarse[:, i] * shape[1] + coarse[:, j])[fit]
            g = np.bincount(at, weights=(y - p)[fit], minlength=shape[0] * shape[1]).reshape(shape)
            h = np.bincount(at, weights=(p * (1 - p))[fit], minlength=shape[0] * shape[1]).reshape(shape)
            gains.append((pair_tree(g, h)[1], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    places = [coarse[:, i] * t.shape[1] + coarse[:, j] for (i, j), t in zip(model.pairs, model.pair_tables)]
    boost(model.pair_tables, places, lambda g, h: pair_tree(g, h)[0], PAIR_ROUNDS)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(crc_fold(key, 3) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``sample`` labelled rows outside the held-out fold.

    Keys are chosen by a hash, the share from their count; a limit bounds the result.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = usable.groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("quality"))
    share = min(1.0, sample / max(usable.count(), 1))
    chosen = keyed.where(unit(F.lit(29), F.col("key")) < share).limit(2 * sample)
    # At most 2 x sample keys of a few bytes.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("key")).select("key", "quality", "text")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "quality": batch["quality"],
                             "features": [text_features(t) for t in batch["text"]]})

    kind = dict(docs.dtypes)["doc_id"]
    rows = map_rows(found, run, f"key {kind}, quality int, features array<double>").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["key"], r["features"]))
    rng = np.random.default_rng(7).permutation(len(rows))
    return (np.array([rows[i]["features"] for i in rng]).reshape(len(rows), len(FEATURES)),
            np.array([rows[i]["quality"] for i in rng], np.int64))


def quality_scores(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        x = np.array([text_features(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
        score = model.scores(x)
        return pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = documents(spark, sf_dir)
    model = train(*training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality_scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
