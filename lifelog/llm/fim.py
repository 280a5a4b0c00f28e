"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as zstandard frames that decompress independently.  Each frame carries how many bytes,
characters and units (a run of ASCII letters or any other character) begin before it, so the frame of a
cut is found from the counts alone and only that frame is decompressed to place the cut.  The transformed
text is written as frames again, each made from pieces of input frames as they pass; a digest streams over
the frames in order, and the original text comes back by reading the ranges between the marks out of the
output frames.  Never more than a frame or two of a text is decompressed at once, however long it is.

A row holds all frames of its text, so nothing is shuffled; the store of the texts is a written table.

Defined results: a null text is an empty one, which stays plain; a null key draws as the empty number;
repeated rows give equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import documents, ship_package
from lifelog.staging import stage

#: Bytes of a frame, compressed alone; the last character may go beyond.
FRAME_BYTES = 1 << 15
LEVEL = 3
#: Marks before the parts; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SPM = 10, 20
#: Rows that leave a task at once.
OUT_BYTES = 1 << 23

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes that begin a character.
_LEAD = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)

FRAME = pa.struct([("first_byte", pa.int64()), ("first_char", pa.int64()), ("first_unit", pa.int64()),
                   ("in_run", pa.bool_()), ("data", pa.binary())])
_FRAMES = "array<struct<first_byte:long,first_char:long,first_unit:long,in_run:boolean,data:binary>>"


def unit_starts(data: bytes, in_run: bool) -> np.ndarray:
    """Places of the bytes that begin a unit; ``in_run`` tells that a letter came before."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    after = np.empty(len(raw), bool)
    after[:1] = in_run
    after[1:] = letter[:-1]
    return np.flatnonzero(_LEAD[raw] & ~(letter & after))


class Frames:
    """A text as frames with running counts, written in order and read by ranges of bytes."""

    def __init__(self, frame_bytes: int | None = None):
        self.size = frame_bytes or FRAME_BYTES
        self.rows: list[tuple[int, int, int, bool, bytes]] = []
        self.bytes = self.chars = self.units = 0
        self.in_run = False
        self.open = bytearray()
        self.writer = _COMPRESSOR

    @classmethod
    def of(cls, rows: list[dict], total: tuple[int, int, int]) -> "Frames":
        """Frames read back from a stored row."""
        self = cls()
        self.rows = [(r["first_byte"], r["first_char"], r["first_unit"], r["in_run"], r["data"]) for r in rows]
        self.bytes, self.chars, self.units = total
        return self

    def write(self, piece: bytes) -> None:
        self.open += piece
        while len(self.open) >= self.size + 4:
            cut = self.size
            while not _LEAD[self.open[cut]]:  # a frame ends with a whole character
                cut += 1
            self._frame(bytes(self.open[:cut]))
            del self.open[:cut]

    def close(self) -> "Frames":
        if self.open:
            self._frame(bytes(self.open))
            self.open.clear()
        return self

    def _frame(self, data: bytes) -> None:
        self.rows.append((self.bytes, self.chars, self.units, self.in_run, self.writer.compress(data)))
        self.units += len(unit_starts(data, self.in_run))
        self.chars += int(np.count_nonzero(_LEAD[np.frombuffer(data, np.uint8)]))
        self.bytes += len(data)
        self.in_run = bool(_LETTER[data[-1]])

    def _data(self, number: int) -> bytes:
        return _DECOMPRESSOR.decompress(self.rows[number][4])

    def read(self, start: int, stop: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``stop``, frame by frame; frames outside are not decompressed."""
        if start >= stop:
            return
        number = _last(self.rows, 0, start)
        while number < len(self.rows) and self.rows[number][0] < stop:
            first = self.rows[number][0]
            yield self._data(number)[max(0, start - first):stop - first]
            number += 1

    def seek_unit(self, unit: int) -> tuple[int, int]:
        """(byte, character) at which a unit begins; the end for the number of units."""
        if unit >= self.units:
            return self.bytes, self.chars
        number = _last(self.rows, 2, unit)
        first_byte, first_char, first_unit, in_run, _ = self.rows[number]
        data = self._data(number)
        at = int(unit_starts(data, in_run)[unit - first_unit])
        return first_byte + at, first_char + int(np.count_nonzero(_LEAD[np.frombuffer(data, np.uint8, at)]))

    def find(self, mark: bytes, start: int = 0) -> int:
        """The first byte of ``mark`` from ``start`` on, also across frames; -1 without one."""
        tail, at = b"", start
        for piece in self.read(start, self.bytes):
            joined = tail + piece
            found = joined.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = joined[len(joined) - len(mark) + 1:] if len(joined) >= len(mark) else joined
        return -1


def _last(rows: list[tuple], part: int, value: int) -> int:
    """The last row whose ``part`` does not exceed ``value``."""
    low, high = 0, len(rows)
    while high - low > 1:
        middle = (low + high) // 2
        if rows[middle][part] <= value:
            low = middle
        else:
            high = middle
    return low


_COMPRESSOR = zstandard.ZstdCompressor(level=LEVEL)
_DECOMPRESSOR = zstandard.ZstdDecompressor()


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (row, bytes it takes), of about ``OUT_BYTES``."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 64
        if size >= OUT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stored(frames: Frames) -> tuple[list[dict], int]:
    names = [f.name for f in FRAME]
    return [dict(zip(names, r)) for r in frames.rows], sum(len(r[4]) for r in frames.rows)


def frame_store(docs: DataFrame, key: Column) -> DataFrame:
    """(key, n_bytes, n_chars, n_units, marked, frames) of every row; ``marked`` tells that the text holds a mark."""
    kind = docs.select(key.alias("key")).schema["key"].dataType
    schema = pa.schema([("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_units", pa.int64()), ("marked", pa.bool_()),
                        ("frames", pa.list_(FRAME))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column("key"), 0
            texts = batch.column("text").cast(pa.binary())

            def rows():
                for text in texts:
                    data = text.as_buffer() if text.is_valid else b""
                    store = Frames()
                    for start in range(0, len(data), store.size):
                        store.write(bytes(data[start:start + store.size]))
                    store.close()
                    frames, size = _stored(store)
                    marked = any(store.find(m) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)) if len(data) else False
                    yield (store.bytes, store.chars, store.units, marked, frames), size

            for out in _batches(rows(), schema):
                part = keys.slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([part, *out.columns], ["key", *schema.names])

    ship_package(docs.sparkSession)
    return docs.select(key.alias("key"), "text").mapInArrow(
        run, f"key {kind.simpleString()}, n_bytes long, n_chars long, n_units long, marked boolean, frames {_FRAMES}")


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers drawn from a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def planned(store: DataFrame, plain: int = PLAIN, spm: int = SPM, seed: int = 1) -> DataFrame:
    """``store`` with form, cut_low and cut_high (units; null if plain), from the keys and counts alone."""
    h1, h2, h3, h4 = draws(F.col("key"), seed)
    form = (
        F.when((F.col("n_bytes") == 0) | F.col("marked") | (h3 % 100 >= 100 - plain), "plain")
        .when(h4 % 100 < spm, "spm").otherwise("psm")
    )
    one, two = h1 % (F.col("n_units") + 1), h2 % (F.col("n_units") + 1)
    return store.withColumn("form", form).withColumns({
        "cut_low": F.when(F.col("form") != "plain", F.least(one, two)),
        "cut_high": F.when(F.col("form") != "plain", F.greatest(one, two)),
    })


def assemble(store: Frames, form: str, low: int | None, high: int | None) -> tuple[Frames, int | None, int | None]:
    """(output frames, characters of the prefix, characters of the middle)."""
    out = Frames()
    if form == "plain":
        for piece in store.read(0, store.bytes):
            out.write(piece)
        return out.close(), None, None
    (a, chars_a), (b, chars_b) = store.seek_unit(low), store.seek_unit(high)
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, store.bytes)
    for mark, start, stop in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        out.write(mark)
        for piece in store.read(start, stop):
            out.write(piece)
    return out.close(), chars_a, chars_b - chars_a


def restore(out: Frames, form: str) -> Iterator[bytes]:
    """The original text, in pieces, from the output and its form: the marks are found and the ranges between them read."""
    if form == "plain":
        yield from out.read(0, out.bytes)
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one = len(first)
    two = out.find(second, one)
    three = out.find(MIDDLE, two + len(second))
    ranges = {first: (one, two), second: (two + len(second), three), MIDDLE: (three + len(MIDDLE), out.bytes)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from out.read(*ranges[mark])


def digest(pieces: Iterator[bytes]) -> str:
    sha = hashlib.sha256()
    for piece in pieces:
        sha.update(piece)
    return sha.hexdigest()


def _read(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch of stores, one at a time."""
    columns = [batch.column(n) for n in ("frames", "n_bytes", "n_chars", "n_units", *names)]
    for row in range(batch.num_rows):
        frames, n_bytes, n_chars, n_units, *rest = (c[row].as_py() for c in columns)
        yield Frames.of(frames, (n_bytes, n_chars, n_units)), *rest


def transformed(plan: DataFrame) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, n_bytes, n_chars, n_units, frames) of a planned store.

    The frames and their counts are those of the output; ``n`` counts the units of the text.
    """
    kind = plan.schema["key"].dataType.simpleString()
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                        ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_units", pa.int64()), ("frames", pa.list_(FRAME))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0

            def rows():
                for store, form, low, high in _read(batch, "form", "cut_low", "cut_high"):
                    out, prefix, middle = assemble(store, form, low, high)
                    frames, size = _stored(out)
                    yield (store.units, form, prefix, middle, out.bytes, out.chars, out.units, frames), size

            for out in _batches(rows(), schema):
                part = batch.column("key").slice(at, out.num_rows)
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([part, *out.columns], ["key", *schema.names])

    ship_package(plan.sparkSession)
    return plan.select("key", "n_bytes", "n_chars", "n_units", "frames", "form", "cut_low", "cut_high").mapInArrow(
        run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, n_bytes long, n_chars long, n_units long, "
             f"frames {_FRAMES}")


def digests(output: DataFrame) -> DataFrame:
    """``output`` without its frames, with the digests of the output and of the text restored from it."""
    kept = [c for c in output.columns if c != "frames"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in output.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [], []
            for out, form in _read(batch, "form"):
                one.append(digest(out.read(0, out.bytes)))
                two.append(digest(restore(out, form)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(one, pa.string()), pa.array(two, pa.string())],
                                             [*kept, "output_sha256", "restored_sha256"])

    ship_package(output.sparkSession)
    return output.mapInArrow(run, f"{types}, output_sha256 string, restored_sha256 string")


def fill_in_middle(docs: DataFrame, key: Column, plain: int = PLAIN, spm: int = SPM, seed: int = 1) -> DataFrame:
    """The transformed texts of ``docs`` as frames, see ``transformed``; the store of the texts is a written table.

    The output is made frame by frame where it is read, so a caller that reads it once need not write it.
    """
    store = stage(frame_store(docs, key), "fim-frames")
    return transformed(planned(store, plain, spm, seed))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, cuts and digests of every whole text of ``documents``."""
    done = digests(fill_in_middle(documents(spark, sf_dir), F.col("doc_id")))
    return done.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
                  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
                  ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN}
                       THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM t),
     p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
                  array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op12_fim": op12_fim}
ORACLE = {"op12_fim": _SQL}
