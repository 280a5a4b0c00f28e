"""Benchmark decontamination by winnowing.

A shared span is a run of ``SPAN`` words that a document and a benchmark item have in common.  Hashes
of all ``GRAM``-word grams are winnowed: of the grams in every span the one with the least hash is the
span's fingerprint.  It depends on the span alone, so a document that holds a span of an item holds the
item's fingerprint too: every shared span of ``SPAN`` words or more is found, wherever it lies.  An item
of fewer words is one span of its own length, whose only gram is the item itself.

One pass over the texts makes the fingerprints, a slice of a batch at a time in numpy.  A table of bits
made of the item fingerprints (a bounded number of bits, set by their count) sifts them there, so only
spans whose fingerprint may be an item's leave the pass, each with a 128-bit hash of its words.  Document
and item fingerprints then meet in an equi-join on fingerprint and words; hits that overlap are extended
to maximal spans.  With more item fingerprints than the bits can tell apart the pass lets more spans
through, and the join does the rest.

Defined results: a null text has no words and no hit, nor does an empty or blank one; an item without
words is never met; every row of ``docs`` gives one row, also repeated ones and those of a null key; items
are told apart by id, and an item without an id marks words but is not listed; an empty table of
documents gives no rows, an empty benchmark no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifelog.llm.common import documents, ship_package
from lifelog.staging import stage

SPAN = 10
#: Words of a gram; a fingerprint is the least of ``SPAN - GRAM + 1`` gram hashes.
GRAM = 6
#: Bytes of text that numpy takes at once.
SLICE_BYTES = 1 << 20
#: Least and greatest size of the table of bits, as powers of two, and bits for each item fingerprint.
SIEVE_LOW, SIEVE_HIGH, SIEVE_SPREAD = 16, 26, 64
#: Item spans that may be broadcast; more are joined by key, hot ones dealt over ``SALTS``.
BROADCAST_SPANS = 200_000
SALTS = 16

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Digits, letters and all bytes of characters beyond ASCII.
_IN_WORD = _UPPER | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` of each at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(1 << n.bit_length(), np.uint64(base))
            table[0] = 1
            _POWERS[k] = np.cumprod(table)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts: hashes, the text each is of, and the texts' bytes with single spaces."""

    def __init__(self, texts: pa.Array, in_word: np.ndarray = _IN_WORD):
        # A space behind each text keeps its last word from the next text's first one.
        spaced = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ")
        ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset:spaced.offset + len(spaced) + 1].astype(np.int64)
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        inside = in_word[data]
        edge = np.flatnonzero(np.diff(np.r_[False, inside]))
        starts, stops = edge[::2], edge[1::2]
        low = np.where(inside, _LOWER[data], np.uint8(32))
        self.of = np.searchsorted(ends, starts, "right") - 1
        self.first = np.searchsorted(starts, ends[:-1], "left")
        self.count = np.searchsorted(starts, ends[1:], "left") - self.first
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[low] * power[:len(data)], out=total[1:])
        self.hash = _mix((total[stops] - total[starts]) * inverse[starts])
        # Every word keeps one separator, so equal words at equal places are equal bytes.
        keep = inside.copy()
        keep[stops] = True
        place = np.cumsum(keep)
        self.bytes = low[keep].tobytes()
        self.start, self.stop = place[starts] - 1, place[stops] - 1

    def grams(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on; those that run into the next text are to be left out."""
        last = max(0, len(self.hash) - n + 1)
        total = self.hash[:last].copy()
        for k in range(1, n):
            total = total * _STEP + self.hash[k:k + last]
        return _mix(total + np.uint64(n))

    def spans(self, length: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of all runs of ``length`` words inside a text."""
        if length < span:
            least = self.grams(length)
        else:
            grams = self.grams(gram)
            last = max(0, len(self.hash) - span + 1)
            least = reduce(np.minimum, (grams[k:k + last] for k in range(span - gram + 1)))
        whole = np.flatnonzero(self.of[:len(least)] == self.of[length - 1:length - 1 + len(least)])
        return whole, least[whole]

    def identities(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Two longs for the words of each run."""
        data, digest = self.bytes, xxhash.xxh3_128_digest
        runs = zip(self.start[first].tolist(), self.stop[first + length - 1].tolist())
        return np.frombuffer(b"".join([digest(data[a:b]) for a, b in runs]), "<i8").reshape(-1, 2)


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first row, rows) of ranges of about ``most`` bytes, ``SLICE_BYTES`` by default."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = int(total[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + (most or SLICE_BYTES), "right")))
        yield at, stop - at
        at = stop


_RUN = pa.struct([("length", pa.int32()), ("first", pa.int32()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def _runs(words: Words, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Array:
    """A list of runs for each text from (length, first words, fingerprints)."""
    length = np.concatenate([np.full(len(f), n, np.int64) for n, f, _ in found] or [np.zeros(0, np.int64)])
    first = np.concatenate([f for _, f, _ in found] or [np.zeros(0, np.int64)])
    fp = np.concatenate([p for _, _, p in found] or [np.zeros(0, np.uint64)])
    by = np.argsort(first, kind="stable")
    length, first, fp = length[by], first[by], fp[by]
    same = words.identities(first, length)
    of = words.of[first]
    offsets = np.searchsorted(of, np.arange(len(words.count) + 1), "left")
    arrays = [length.astype(np.int32), (first - words.first[of]).astype(np.int32), fp.view(np.int64),
              np.ascontiguousarray(same[:, 0]), np.ascontiguousarray(same[:, 1])]
    runs = pa.StructArray.from_arrays([pa.array(a) for a in arrays], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def _texts(df: DataFrame, read) -> DataFrame:
    """(row, n_words, runs) of every (row, text); ``read`` gives (length, first words, fingerprints) of some words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch.column("text")):
                part = batch.slice(at, rows)
                words = Words(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(words.count, pa.int64()), _runs(words, read(words))], ["row", "n_words", "runs"])

    ship_package(df.sparkSession)
    kind = df.schema["row"].dataType.simpleString()
    return df.select("row", "text").mapInArrow(
        run, f"row {kind}, n_words long, runs array<struct<length:int,first:int,fp:long,h1:long,h2:long>>")


def item_spans(items: DataFrame, item: Column, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(item, length, fp, h1, h2): the different spans of each item."""

    def read(words: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        found = [(span, *words.spans(span, span, gram))]
        for length in range(1, span):
            short = words.first[words.count == length]
            if len(short):
                first, fp = words.spans(length, span, gram)
                found.append((length, short, fp[np.searchsorted(first, short)]))
        return found

    runs = _texts(items.select(item.alias("row"), F.col("text")), read)
    return runs.select(F.col("row").alias("item"), F.inline("runs")).drop("first").distinct()


def sieve(spans: DataFrame) -> np.ndarray:
    """Bits, as 64-bit words, that are set where the upper bits of some fingerprint point."""
    size = spans.count() * SIEVE_SPREAD
    bits = min(max(size - 1, 1).bit_length(), SIEVE_HIGH)
    bits = max(bits, SIEVE_LOW)
    slot = F.shiftrightunsigned("fp", 64 - bits)
    marked = spans.groupBy((slot / 64).cast("long").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("mask"))
    rows = marked.toArrow()  # 2^(SIEVE_HIGH - 6) rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return table.view(np.uint64)


def _sifted(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = fp >> np.uint64(65 - (len(table) * 64).bit_length())
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _met(runs: DataFrame, spans: DataFrame, small: bool, how: str) -> DataFrame:
    """``runs`` joined with ``spans`` of the same words; a run that many documents hold is dealt over salts."""
    same = ["fp", "length", "h1", "h2"]
    if small:
        return runs.join(F.broadcast(spans), same, how)
    salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return runs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [*same, "salt"], how).drop("salt")


def contamination(docs: DataFrame, items: DataFrame, keys: Sequence[str] = ("doc_id",), item: str = "item_id",
                  span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``keys``, n_words, n_hit, spans, items of every row of ``docs``.

    ``spans`` are the maximal runs of words, as (first, stop) counted from 0, made of overlapping spans of
    items; ``n_hit`` counts their words.  ``items`` are the ids met, as text, in order.  ``docs`` and
    ``items`` have a column text.
    """
    wanted = stage(item_spans(items, F.col(item), span, gram), "winnowing-items")
    table = sieve(wanted)
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())  # ``span`` different ones at most

    def read(words: Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        found = []
        for length in lengths:
            first, fp = words.spans(length, span, gram)
            pick = _sifted(fp, table)
            found.append((length, first[pick], fp[pick]))
        return found

    keyed = F.struct(F.monotonically_increasing_id().alias("row"), *keys)
    read_docs = stage(_texts(docs.select(keyed.alias("row"), "text"), read).select("row.*", "n_words", "runs"), "winnowing-documents")

    known = wanted.select("fp", "length", "h1", "h2").distinct()
    small = wanted.count() <= BROADCAST_SPANS
    hits = stage(_met(read_docs.select("row", F.inline("runs")), known, small, "left_semi"), "winnowing-hits")
    order = Window.partitionBy("row").orderBy("first", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > reach, F.lit(True)).cast("int")
    spans = (
        hits.select("row", "first", (F.col("first") + F.col("length")).alias("stop")).withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(order))
        .groupBy("row", "island").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
        .groupBy("row").agg(F.sum(F.col("stop") - F.col("first")).alias("n_hit"),
                            F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("spans"))
    )
    met = (
        _met(hits.select("row", "fp", "length", "h1", "h2").distinct(), wanted, small, "inner")
        .select("row", F.col("item").cast("string").alias("item"))
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast("array<struct<first:int,stop:int>>")
    return (
        read_docs.drop("runs").join(spans, "row", "left").join(met, "row", "left")
        .select(*keys, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """``docs`` without those of which more than ``most`` of the words are hit; rows and columns as given."""
    marked = docs.select(F.struct(*docs.columns).alias("kept_row"), "text")
    found = contamination(marked, items, ["kept_row"])
    return found.where(F.col("n_hit") <= F.lit(most) * F.col("n_words")).select("kept_row.*")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every whole text of ``documents``."""
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
     i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
     j AS (SELECT item_id, w, least(len(w), {SPAN}) AS n FROM i WHERE len(w) > 0),
     k AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM j),
     wanted AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM k),
     lengths AS (SELECT DISTINCT n FROM wanted),
     e AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
     f AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM e),
     met AS (SELECT r, f.n, s, item_id FROM f JOIN wanted ON f.n = wanted.n AND f.g = wanted.g),
     words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM met) AS x GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
               FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met WHERE item_id IS NOT NULL) AS x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {"op11_winnowing": op11_winnowing}
ORACLE = {"op11_winnowing": _SQL}
