"""Near copies of whole texts: SimHash trees, then an exact join, then one document of each group.

Rows are numbered and written first.  One map-only pass gives each row a 128-bit identity of its text, a
SimHash fingerprint, the size of its set of word shingles, parity bits of the set and the set's rarest
shingles; texts are not shuffled for that.  Equal texts become one node, named by the row that stands for
them.  Two nodes are linked if the Jaccard coefficient of their sets reaches a bound.  BK-trees over shards
of agreeing bit ranges link most copies at little cost; what they leave apart meets in a join on the rarest
shingles, which leaves out no pair.  Parity bits cut pairs that cannot reach the bound before the sets of
the rest are read from the texts and compared.

A shard that a sample shows to be large is split by further bit ranges, all choices of them, so that no
pair is lost and no task gets a template family whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import ship_package, small_batches, unit
from lifelog.llm.simhash import SHARD_FINGERPRINTS, components, fingerprint, shard_links
from lifelog.llm.winnowing import Words, slices
from lifelog.staging import stage, unstage

SIMILARITY, SHINGLE = 0.8, 5
#: Bits in which fingerprints of copies that the trees look for differ at most, and ranges of bits.
RADIUS, BLOCKS = 10, 8
#: Members of a shard that one task takes; larger shards are split.
SHARD_MOST = 200_000
#: Bytes of text that numpy takes at once.
SLICE_BYTES = 1 << 18
#: Texts that tell which shingles are common: a share of all, but no fewer than so many; and the most such shingles kept.
SHARE, SAMPLED, COMMON = 1 / 8, 4000, 1_000_000
#: Bits for each shingle that tell sets apart before they are compared, and the least number of bits of a set.
PARITIES, LEAST_BITS = 2, 256

_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def sets(texts: pa.Array, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): the different hashes of each text's word shingles, one text after the other.

    A shorter text is one shingle, also a text without words.
    """
    read = Words(texts, _IN_WORD)
    of, found = [], []
    for length in range(words + 1):
        if length == words:
            first, value = read.spans(length, length, length)
        elif length:
            first = read.first[read.count == length]
            starts, value = read.spans(length, length, length)
            value = value[np.searchsorted(starts, first)]
        if length:
            of.append(read.of[first])
            found.append(value)
        else:
            of.append(np.flatnonzero(read.count == 0))
            found.append(np.zeros(len(of[0]), np.uint64))
    of, found = np.concatenate(of), np.concatenate(found).view(np.int64)
    by = np.lexsort((found, of))
    of, found = of[by], found[by]
    new = np.r_[True, (of[1:] != of[:-1]) | (found[1:] != found[:-1])][:len(of)]
    of, found = of[new], found[new]
    return found, np.searchsorted(of, np.arange(len(texts) + 1), "left")


def prefixes(found: np.ndarray, bounds: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): the first of each set, rarest first; sets that reach ``similarity`` share one of them."""
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    size = np.diff(bounds)
    of = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((found, rank, of))
    kept = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    place = np.arange(len(found)) - bounds[:-1][of]
    return found[by][place < kept[of]], np.r_[0, np.cumsum(kept)]


def parities(found: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bits for each set, each the parity of the shingles that fall to it: sets differ in as many at least.

    The number of bits is a power of two that grows with the set; half as many are the two halves added.
    """
    size = np.diff(bounds)
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(size * PARITIES, 1))).astype(np.int64))
    ends = np.r_[0, np.cumsum(bits)]
    of = np.repeat(np.arange(len(size)), size)
    place = ends[of] + (found.view(np.uint64) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=ends[-1]) & 1
    return _lists(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), ends // 64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _by_slices(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` on slices of the batches of ``df``, cut by the bytes of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in slices(batch.column("text"), SLICE_BYTES):
                yield function(batch.slice(at, rows))
            del batch
            pa.default_memory_pool().release_unused()

    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): the shingles that a sample of the texts repeats, ascending; at most ``COMMON``, the most frequent.

    They only decide the order of a set's shingles, so no pair depends on the sample.  It is a share of the texts: of a
    fixed number, a shingle could be in ever more texts unseen, and these all meet in it.
    """
    share = min(1.0, max(SHARE, SAMPLED / max(1, texts.count())))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sets(part.column("text"), words)[0])], ["shingle"])

    some = _by_slices(texts.where(unit(F.lit(17), F.col("row")) < share).select("text"), run, "shingle long")
    often = stage(some.groupBy("shingle").count().where("count > 1"), "copies-common")
    least, kept = 1, 0
    for r in sorted(often.groupBy("count").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["count"]):
        kept += r["n"]
        if kept > COMMON:
            least = r["count"]
            break
    found = often.where(F.col("count") > least).select("shingle", F.least("count", F.lit(2**31 - 1)).cast("int").alias("count")).toArrow()
    unstage(often)
    shingles, counts = (found.column(c).to_numpy() for c in ("shingle", "count"))
    by = np.argsort(shingles)
    return shingles[by], counts[by]


def sketched(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(row, id, h1, h2, fp, size, parities, prefix) of every (row, id, text).

    The prefix holds 32 bits of each shingle: it only brings pairs together.
    """
    common, counts = common_shingles(texts, words)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("text")
        same = [xxhash.xxh3_128_digest(t.as_buffer()) if t.is_valid else bytes(16) for t in column]
        same = np.frombuffer(b"".join(same), "<i8").reshape(-1, 2)
        fps = np.array([fingerprint(t.as_py()) for t in column], np.uint64).view(np.int64)
        found, bounds = sets(column, words)
        first, cut = prefixes(found, bounds, similarity, common, counts)
        arrays = [np.ascontiguousarray(same[:, 0]), np.ascontiguousarray(same[:, 1]), fps, np.diff(bounds)]
        return pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("id"), *[pa.array(a, pa.int64()) for a in arrays],
             parities(found, bounds), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(first.astype(np.int32)))],
            ["row", "id", "h1", "h2", "fp", "size", "parities", "prefix"])

    kind = texts.schema["id"].dataType.simpleString()
    return _by_slices(texts.select("row", "id", "text"), run,
                      f"row long, id {kind}, h1 long, h2 long, fp long, size long, parities array<long>, prefix array<int>")


def tree_plan(count: int, blocks: int = BLOCKS) -> int:
    """Ranges that must agree, so that a shard is expected to stay small."""
    for same in range(2, blocks):
        if count * 2.0 ** -(64 * same // blocks) <= SHARD_FINGERPRINTS:
            break
    return same


def tree_shards(nodes: DataFrame, count: int, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(shard, fp, node): nodes under every choice of agreeing ranges; large shards split by all further ranges.

    Two fingerprints of a shard within ``radius`` bits agree in one of ``radius + 1`` ranges of the bits
    that the shard leaves free, so a split loses no pair.
    """
    same = tree_plan(count, blocks)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks, finer = [], []
    for chosen in combinations(range(blocks), same):
        fixed = [b for i in chosen for b in range(edges[i], edges[i + 1])]
        free = [b for b in range(64) if b not in fixed]
        masks.append(_signed(fixed))
        finer.append([_signed(free[k * len(free) // (radius + 1):(k + 1) * len(free) // (radius + 1)]) for k in range(radius + 1)])
    keys = F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))).alias("shard"), F.lit(k).alias("choice"))
                     for k, m in enumerate(masks)])
    keyed = nodes.select(F.inline(keys), "fp", "node")
    if count <= SHARD_MOST:
        return keyed.drop("choice")
    share = 2000 / SHARD_MOST
    large = (
        keyed.where(unit(F.lit(23), F.col("node")) < share).groupBy("shard").count()
        .where(F.col("count") > 1000).select(F.col("shard").alias("large"))
    )
    marked = keyed.join(stage(large, "copies-large"), F.col("shard") == F.col("large"), "left")
    table = F.array(*[F.array(*[F.lit(m) for m in row]) for row in finer])
    split = F.transform(table[F.col("choice")], lambda m, k: F.xxhash64(F.col("shard"), k, F.col("fp").bitwiseAND(m)))
    return marked.select(F.explode(F.when(F.col("large").isNull(), F.array("shard")).otherwise(split)).alias("shard"), "fp", "node")


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _span(size: Column, similarity: float) -> Column:
    return F.floor(F.log(size) / -np.log(similarity) + 1e-9)


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sizes and parity bits allow ``similarity``."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("parities").alias(f"p{c}")) for c in "ab")

    def folded(bits: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(bits) > half, F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
                      ).otherwise(bits)

    p, q = F.col("pa"), F.col("pb")  # sizes within 0.5 of each other are at most one power of two apart; others stay
    differ = F.aggregate(F.zip_with(folded(p, q), folded(q, p), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6
    return (
        pairs.join(one, "a").join(two, "b")
        .where(F.when(F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9, F.coalesce(differ <= most, F.lit(True)))).select("a", "b")
    )


def alike(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(node, other) of the pairs (a, b) whose sets reach ``similarity``; nodes are rows of ``texts``."""
    asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("row"), _lists(*sets(part.column("text"), words))], ["row", "shingles"])

    read = stage(_by_slices(texts.select("row", "text").join(asked, "row", "left_semi"), run, "row long, shingles array<long>"),
                 "copies-shingles")
    one, two = (read.select(F.col("row").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(one, "a").join(two, "b").where(
        common >= (F.size("sa") + F.size("sb") - common) * (similarity - 1e-12))
    links = stage(found.select(F.col("a").alias("node"), F.col("b").alias("other")), "copies-links")
    unstage(read)
    return links


def apart(nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of nodes that may reach ``similarity`` and are of different roots.

    Every such pair shares a shingle of both prefixes and is met there; ``roots`` holds linked nodes only.
    Shingles of one root leave before the join, so groups that are linked already cost nothing.  Before the first shingle that
    two sets share, each holds only what the other lacks, so that shingle comes early in both if they are alike.  Parity bits,
    folded to the least number, tell most others of a large group apart within the join.
    """
    named = roots.withColumnRenamed("node", "__of")
    folds = LEAST_BITS // 64
    folded = [F.aggregate(F.filter("parities", lambda x, k: k % folds == i), F.lit(0).cast("long"), lambda n, x: n.bitwiseXOR(x)).alias(f"p{i}")
              for i in range(folds)]
    rooted = nodes.select("node", "size", "prefix", *folded).join(named, F.col("node") == F.col("__of"), "left").withColumn("root", F.coalesce("root", "node"))
    met = rooted.select("root", F.explode("prefix").alias("met")).groupBy("met").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    read = nodes.select("node", F.posexplode("prefix").alias("place", "shingle"))
    few = read.join(met.where("low <> high").select("met"), F.col("shingle") == F.col("met"), "left_semi")
    own = ["node", "root", "size", *[f"p{i}" for i in range(folds)]]
    # A set meets those of its own and of the next range of lengths.
    kept = stage(few.join(rooted.drop("prefix", "__of"), "node").select(
        "shingle", *own, "place", _span(F.col("size"), similarity).alias("span")), "copies-mixed")
    # The smaller set of a pair lacks the least of the other.
    early = F.col("place") <= F.col("size") * ((1 - similarity) / (1 + similarity)) + 1e-9
    left = kept.where(early).select("shingle", "span", *[F.col(c).alias(f"{c}1") for c in (*own, "place")])
    right = kept.select("shingle", F.explode(F.array("span", F.col("span") - 1)).alias("span"),
                        *[F.col(c).alias(f"{c}2") for c in (*own, "place")])
    least = similarity / (1 + similarity) * (F.col("size1") + F.col("size2")) - 1e-9
    differ = sum((F.bit_count(F.col(f"p{i}1").bitwiseXOR(F.col(f"p{i}2"))) for i in range(folds)), F.lit(0))
    met = left.join(right, ["shingle", "span"]).where(
        (F.col("root1") != F.col("root2"))
        & ((F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("node1") < F.col("node2"))))
        & (F.col("size1") >= F.col("size2") * similarity - 1e-9)
        & (F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2")) >= least)
        & (differ <= (1 - similarity) / (1 + similarity) * (F.col("size1") + F.col("size2")) + 1e-6))
    pairs = stage(met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct(), "copies-met")
    unstage(kept)
    return pairs


def near_copies(texts: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """(row, id, n, root, stays) of every different text of (row, id, text): one of each group of near copies stays.

    ``row`` and ``id`` are those of the row that stands for ``n`` equal texts, ``root`` names the group.  Two
    texts are linked if the Jaccard coefficient of their ``words``-word shingles (A-Z lower-cased) reaches
    ``similarity``, and all links count, also over others.  The row of the smallest id stands and stays, of
    the smallest row number among equal ids; rows without an id come last.

    Defined results: null, empty and blank texts are alike (they have no word); repeated rows and copies
    under other ids are one text; ties are settled by the row number; an empty table gives no rows; other
    columns are not read.  ``row`` is a long without repeats; ``texts`` is a written table.
    """
    sketches = stage(sketched(texts, similarity, words), "copies-sketches")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    named = sketches.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    named = stage(named.select(F.col("first.row").alias("node"), "first", "n"), "copies-named")
    nodes = stage(
        sketches.select(F.col("row").alias("node"), "fp", "size", "parities", "prefix").join(named.select("node"), "node", "left_semi"),
        "copies-nodes")
    unstage(sketches)

    keyed = tree_shards(nodes, nodes.count())
    near = stage(shard_links(keyed, RADIUS, edges=True).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
                 .where("a <> b").distinct(), "copies-candidates")
    likely = stage(possible(near, nodes, similarity), "copies-possible")
    unstage(near)
    links = alike(likely, texts, similarity, words)
    met = apart(nodes, components(links), similarity)
    left = stage(possible(met, nodes, similarity), "copies-possible")
    unstage(nodes, likely, met)
    more = alike(left, texts, similarity, words)
    roots = components(links.union(more))
    grouped = named.join(roots, "node", "left").select("first", "n", F.coalesce("root", "node").alias("root"))
    chosen = grouped.groupBy("root").agg(F.min("first").alias("chosen"))
    out = stage(grouped.join(chosen, "root").select(
        "first.row", "first.id", "n", "root", (F.col("first.row") == F.col("chosen.row")).alias("stays")), "copies-texts")
    unstage(named, left, links, more)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc) of every row, written; ``doc`` holds all columns as given, so no name clashes."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "copies-documents")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, the one of the smallest id."""
    rows = numbered(docs)
    kept = near_copies(rows.select("row", F.col("doc")["doc_id"].alias("id"), F.col("doc")["text"].alias("text"))).where("stays")
    # Fewer rows go than stay, and numbers alone tell which: texts meet the smaller side.
    gone = stage(rows.select("row").join(kept.select("row"), "row", "left_anti"), "copies-gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")
