"""Quality rules on tokeniser fertility.

A public vocabulary reads each whole text; characters per token, the share of bytes the vocabulary
falls back to (line ends and tabs, which it always spells so, aside) and the entropy of the tokens
tell how far a text is from the writing the vocabulary knows.  What is usual differs with language
and length, so the bands come from the corpus itself: for each language, or script where the language
is not given, and each doubling of the length, the median of all different texts that pass the base rules and
``WIDTH`` deviations to either side, taken from the quartiles.  Groups of fewer than ``LEAST`` such
texts use the band of the language, then of the corpus.

Defined results: null and empty texts have no words and fail the base rules; null and repeated keys
stay as rows; an empty table gives no rows; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import WORD, documents, map_rows
from lifelog.staging import stage

#: Model file; a cluster names its own place, or ships the file with the job.
VOCABULARY = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
WIDTH = 4.5
LEAST = 30
#: Metric and the least deviation that its band is given.
METRICS = {"chars_per_token": 0.03, "byte_share": 0.01, "token_entropy": 0.1}

_WORDS = re.compile(WORD)
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
#: First and last code point of scripts.
_SCRIPTS = (("Latn", 0x41, 0x24F), ("Grek", 0x370, 0x3FF), ("Cyrl", 0x400, 0x52F), ("Hebr", 0x590, 0x5FF),
            ("Arab", 0x600, 0x6FF), ("Deva", 0x900, 0x97F), ("Thai", 0xE00, 0xE7F), ("Kana", 0x3040, 0x30FF),
            ("Hani", 0x4E00, 0x9FFF), ("Hang", 0xAC00, 0xD7AF))


def script(text: str) -> str:
    """The script of most letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = [int(((codes >= a) & (codes <= b)).sum()) for _, a, b in _SCRIPTS]
    return _SCRIPTS[int(np.argmax(counts))][0] if max(counts) else "Zyyy"


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = _WORDS.findall(text)
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(
        model_file=path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


def token_metrics(text: str, path: str) -> tuple[int, float, float, float]:
    """(n_tokens, chars_per_token, byte_share, token_entropy in bits)."""
    sp, is_byte = _processor(path)
    ids = np.array(sp.encode(text), dtype=np.int64)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids, minlength=len(is_byte))
    spelt = int(counts[is_byte].sum()) - text.count("\n") - text.count("\t")
    p = counts[counts > 0] / n
    return n, len(text) / n, max(spelt, 0) / n, float(-(p * np.log2(p)).sum())


def measure(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_key, group, octave, the five counts, base_failed, n_tokens, the metrics) of every row."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, same, text, lang in zip(batch["doc_id"], batch["text_key"], batch["text"], batch["lang"]):
            text = text or ""
            counts = base_counts(text)
            n, cpt, spelt, entropy = token_metrics(text, vocabulary)
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            rows.append((key, same, lang if isinstance(lang, str) else f"script {script(text)}", int(n).bit_length(),
                         *counts, failed, n, cpt, spelt, entropy))
        return pd.DataFrame(rows, columns=["doc_id", "text_key", "group", "octave", *COUNTS, "base_failed", "n_tokens", *METRICS])

    kind = dict(docs.dtypes)["doc_id"]
    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", "lang")
    return map_rows(read, run, f"doc_id {kind}, text_key long, group string, octave int, "
                    + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, n_tokens long, "
                    + ", ".join(f"{m} double" for m in METRICS))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bands(measured: DataFrame, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """(group, octave, low and high of each metric): one row for each group and octave of the rows.

    Each text counts once, so copies neither fill a group nor move its quartiles.
    """
    texts = measured.groupBy("group", "octave", "text_key").agg(
        *[F.first(c).alias(c) for c in ("base_failed", *METRICS)])
    clean = ~F.col("base_failed")
    quartiles = [F.percentile_approx(F.when(clean, F.col(m)), [0.25, 0.5, 0.75], 1000).alias(m) for m in METRICS]
    levels = stage(texts.rollup("group", "octave").agg(
        F.grouping_id().alias("level"), F.count_if(clean).alias("n"), *quartiles), "fertility-quartiles")

    def level(k: int, keys: list[str]) -> DataFrame:
        at = levels.where((F.col("level") == k) & (F.col("n") >= least * k))
        return at.select(*keys, F.col("n").alias(f"n{k}"), *[F.col(m).alias(f"{m}_{k}") for m in METRICS])

    joined = level(0, ["group", "octave"]).join(level(1, ["group"]), "group", "left")
    corpus = levels.where(F.col("level") == 3).first()  # one row; none for an empty table
    out = []
    for m, floor in METRICS.items():
        whole = F.array(*[F.lit(x) for x in corpus[m]]) if corpus and corpus[m] else F.lit(None).cast("array<double>")
        q = F.when(F.col("n0") >= least, F.col(f"{m}_0")).otherwise(F.coalesce(F.col(f"{m}_1"), whole))
        deviation = [F.greatest(q[i + 1] - q[i], F.lit(floor)) / 0.6745 for i in (0, 1)]
        out += [(q[1] - width * deviation[0]).alias(f"{m}_low"), (q[1] + width * deviation[1]).alias(f"{m}_high")]
    return joined.select("group", "octave", *out)


def quality_rules(docs: DataFrame, vocabulary: str = VOCABULARY, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """Counts, metrics, base_failed and kept of every row."""
    measured = stage(measure(docs, vocabulary), "fertility")
    limits = stage(bands(measured, width, least), "fertility-bands")
    inside = ~F.col("base_failed")
    for m in METRICS:
        inside &= F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return measured.join(limits, ["group", "octave"]).select(
        "doc_id", *COUNTS, "base_failed", inside.alias("kept"), "n_tokens", *METRICS)


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text of ``documents``."""
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op4_fertility": op4_fertility}
ORACLE: dict[str, str] = {}
