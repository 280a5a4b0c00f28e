"""Language identification by averaged hashed subword embeddings.

A text's letters, lower-cased, with every other character as a gap, give overlapping runs of two to
four characters.  Each run is hashed to a row of an embedding table; the text is the average of its
rows, and a linear softmax over it gives the languages.  Table and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  As the model is linear in
the average, prediction folds both into one table of bucket by language.

Part of the sample is set aside to calibrate.  A temperature makes the probabilities honest; a text is
rejected below the confidence at which the accepted rest of that part would err more often than
``ERROR``.  A softmax is sure of texts it has never seen the like of, so a second score tells strangers:
how common the text's runs are among the texts of the language it is given to, against what that language's
own texts show at that length.  Its bound is calibrated against known strangers - each language scored by
the others alone, and texts with their letters shuffled: it is the one of least loss, where a rightly
labelled text rejected weighs as much as ``WEIGHT`` strangers accepted (shares of either), moved halfway
towards the middle of the strangers.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with
no labelled row to learn from every text is; null keys are held in; repeated rows stay; an empty
table gives no rows; columns other than text and lang are not inputs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import crc_fold, documents, map_rows, unit

BUCKETS_BITS = 15
DIMENSIONS = 16
#: Longest run of characters.
ORDERS = 4
#: Labelled rows of a language to learn from, about; twice that for all languages together at most.
SAMPLE = 300
ERROR, LOST, SMOOTH, WEIGHT = 0.01, 0.001, 0.02, 20
#: Least variance of a language's texts around its mean: a foreign line or two is usual.
BY_TEXT = 0.01
UND = "und"

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each letter's own code point, a space for every other character."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the runs of characters of ``text``."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _letters()[codes]
    mixed = codes * _MIX[0]
    hits = []
    for n in range(2, ORDERS + 1):
        if len(codes) < n:
            break
        mixed = mixed[:-1]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * _MIX[n - 1] + codes[n - 1:]
        hits.append((mixed * np.uint32(2 * n + 1)) >> np.uint32(32 - BUCKETS_BITS))
    return np.bincount(np.concatenate(hits), minlength=1 << BUCKETS_BITS)


class Model:
    """Logits of a text: ``mean of table rows + bias``, divided by ``temperature``.

    ``common`` holds how common each bucket is in each language, as a logarithm; ``usual`` the mean of it
    over a text of the language, its variance by run and its variance by text.
    """

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, least: float,
                 common: np.ndarray | None = None, usual: np.ndarray | None = None, strange: float = -np.inf):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.least = temperature, least
        self.common, self.usual, self.strange = common, usual, strange

    def familiarity(self, hit: np.ndarray, weight: np.ndarray, language: int) -> float:
        """How usual the runs are for the language, in standard deviations of a text of as many runs."""
        if self.common is None:
            return 0.0
        mean, by_run, by_text = self.usual[language]
        runs = 1 / (weight @ weight)  # runs that repeat count less
        return float((weight @ self.common[language, hit] - mean) / np.sqrt(by_run / runs + by_text))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected)."""
        if not self.languages or not has_letter(text):
            return UND, 0.0, True
        counts = subword_counts(text)
        hit = np.flatnonzero(counts)
        weight = counts[hit] / counts[hit].sum()
        p = softmax((weight @ self.table[hit] + self.bias) / self.temperature)
        best = int(p.argmax())
        strange = self.familiarity(hit, weight, best) < self.strange
        return self.languages[best], float(p[best]), bool(p[best] < self.least or strange)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def commonness(fit: list, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(common, usual) of a model: from the number of texts of each language that hold a bucket."""
    common = np.zeros((len(languages), 1 << BUCKETS_BITS))
    usual = np.zeros((len(languages), 3))
    for i, name in enumerate(languages):
        mine = [r for r in fit if r[2] == name]
        for buckets, _, _ in mine:
            common[i, buckets] += 1
        held = common[i].copy()
        common[i] = np.log((held + 0.5) / (len(mine) + 1))
        means, spread, runs = [], [], []
        for buckets, counts, _ in mine:
            weight = counts / counts.sum()
            # A text's own vote is left out, as another text has none.
            value = np.log((np.maximum(held[buckets] - 1, 0) + 0.5) / len(mine))
            means.append(weight @ value)
            spread.append(weight @ (value - means[-1]) ** 2)
            runs.append(1 / (weight @ weight))
        means, spread, runs = np.array(means), np.array(spread), np.array(runs)
        # Medians over the longer half: some texts are partly in another language.
        long_ = runs >= np.median(runs)
        middle, by_run = np.median(means[long_]), max(np.median(spread[long_]), 1e-6)
        by_text = max((1.4826 * np.median(np.abs(means[long_] - middle))) ** 2, BY_TEXT)
        usual[i] = middle, by_run, by_text
    return common, usual


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 20.0, seed: int = 3) -> Model:
    """Fit on (buckets, counts, language) rows; every fifth pair calibrates.  Rows without a language are strangers."""
    shuffled = [r for r in rows if r[2] is None]
    rows = [r for r in rows if r[2] is not None]
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BUCKETS_BITS, DIMENSIONS))
    head, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    label = {name: i for i, name in enumerate(languages)}
    held = [r for i, r in enumerate(rows) if i // 2 % 5 == 4] if len(rows) >= 20 else []
    fit = [r for i, r in enumerate(rows) if i // 2 % 5 != 4] if held else rows
    head += rng.normal(0, 0.1, head.shape)
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            buckets, counts, name = fit[i]
            weight = counts / counts.sum()
            mean = weight @ table[buckets]
            slope = softmax(mean @ head + bias)
            slope[label[name]] -= 1
            step = 1 - steps / total
            table[buckets] -= rate * step * weight[:, None] * (head @ slope)
            head -= 0.5 * step * np.outer(mean, slope)
            bias -= 0.05 * step * slope
            steps += 1
    folded = table @ head
    model = Model(languages, folded, bias, 1.0, 0.0, *commonness(fit, languages))
    if held:
        logits = np.array([(c / c.sum()) @ folded[b] + bias for b, c, _ in held])
        gold = np.array([label[n] for *_, n in held])
        # A smoothed likelihood has its best temperature also where nothing is wrong.
        wish = np.full(logits.shape, SMOOTH / len(languages))
        wish[np.arange(len(gold)), gold] += 1 - SMOOTH
        model.temperature = float(min(np.geomspace(0.05, 200, 201), key=lambda t: -(
            wish * np.log(softmax(logits / t) + 1e-300)).sum()))
        p = softmax(logits / model.temperature)
        sure, right = p.max(axis=1), p.argmax(axis=1) == gold
        by = np.argsort(-sure)
        wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(wrong <= ERROR)
        # Nothing to reject if even the least sure of the accepted keeps the error low.
        least = 0.0 if wrong[-1] <= ERROR else float(sure[by[good[-1]]]) if len(good) else 1.0
        model.least = min(least, float(np.quantile(sure[right], LOST)) if right.any() else 1.0)

        def familiar(buckets, counts, scores):
            weight = counts / counts.sum()
            return model.familiarity(buckets, weight, int(scores.argmax()))

        known = np.array([familiar(b, c, x) for (b, c, _), x in zip(held, logits)])[right]
        strangers = [familiar(b, c, (c / c.sum()) @ folded[b] + bias) for b, c, _ in shuffled]
        if len(languages) > 1:  # each language as if it had not been learnt
            others = np.where(np.arange(len(languages)) == gold[:, None], -np.inf, logits)
            strangers += [familiar(b, c, x) for (b, c, _), x in zip(held, others)]
        if len(known) and strangers:
            known, strangers = np.sort(known), np.sort(strangers)
            bounds = np.r_[known[0] - 1, (known[1:] + known[:-1]) / 2, strangers]
            loss = WEIGHT * np.searchsorted(known, bounds) / len(known) + 1 - np.searchsorted(strangers, bounds) / len(strangers)
            # The sample holds few of the oddest texts, so the bound goes halfway on to the middle of the strangers.
            best = float(bounds[loss <= loss.min() + 1e-12].min())
            model.strange = min(best, (best + float(np.median(strangers))) / 2)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(crc_fold(key, 4) == 2, F.lit(False))


def fragment(text: str, place: float) -> str:
    """One to four words of ``text``, from where ``place`` in [0, 1) points."""
    words = text.split()
    first = int(place * 7919 % 1 * len(words))
    return " ".join(words[first:first + 1 + int(place * 104729 % 1 * 4)])


def shuffled(text: str, place: float) -> str:
    """The characters of the words of ``text`` in another order, words as long as before."""
    words = text.split()
    letters = np.random.default_rng(int(place * 2**53)).permutation(list("".join(words)))
    ends = np.cumsum([len(w) for w in words])
    return " ".join("".join(letters[e - len(w):e]) for w, e in zip(words, ends))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, str | None]]:
    """About ``sample`` labelled rows of each language outside the held-out fold, as bucket counts.

    Each gives its whole text and a few words of it, so that short texts are learnt and calibrated too, and
    those words with their characters shuffled, without a language.
    Rows are chosen by a hash, the share from a count of each language; a limit bounds the result
    where copies share a hash.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, sample / n))])
    place = unit(F.lit(11), F.col("doc_id"), F.col("text"))
    chosen = usable.where(F.col("text").isNotNull() & (place < share[F.col("lang")]))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, at, text in zip(batch["lang"], batch["place"], batch["text"]):
            words = fragment(text, at)
            for label, part in ((name, text), (name, words), (None, shuffled(words, at))):
                if has_letter(part):
                    counts = subword_counts(part)
                    hit = np.flatnonzero(counts)
                    out.append((label, at, hit.astype(np.int32), counts[hit].astype(np.float32)))
        return pd.DataFrame(out, columns=["lang", "place", "buckets", "counts"])

    found = map_rows(chosen.select("lang", place.alias("place"), "text"), run,
                     "lang string, place double, buckets array<int>, counts array<float>")
    rows = found.limit(6 * sample * len(sizes)).collect()
    rows.sort(key=lambda r: (r["place"], r["lang"] is None, r["lang"] or "", sum(r["counts"])))
    return [(np.array(r["buckets"]), np.array(r["counts"], np.float64), r["lang"]) for r in rows]


def identify(docs: DataFrame, model: Model | None = None, carry: list[str] | None = None) -> DataFrame:
    """Carried columns (by default doc_id), lang_pred, score, rejected of every row.

    Without ``model`` one is trained on the labelled rows of ``docs``.
    """
    model = model or train(training_rows(docs))
    carry = ["doc_id"] if carry is None else carry

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = [model.predict(t) for t in batch["text"]]
        out = batch[carry].copy()
        for i, name in enumerate(("lang_pred", "score", "rejected")):
            out[name] = [f[i] for f in found]
        return out

    columns = list(dict.fromkeys([*carry, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return map_rows(docs.select(*columns), run, f"{kinds}, lang_pred string, score double, rejected boolean")


def identified_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is not rejected."""
    model = train(training_rows(docs))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[[not model.predict(t)[2] for t in batch["text"]]]

    return map_rows(docs, run, docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    found = identify(documents(spark, sf_dir))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
