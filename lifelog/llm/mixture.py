"""Mixing sources to target weights.

The words of a source form one stream: its documents, ordered by a seeded hash, one after the
other.  The stream is cut into blocks of equal length, which the hash order has already permuted.
A source's target is an exact quota of blocks; a quota above one epoch starts the stream again.

A splitting tree deals the quotas to the output shards.  Each node halves its number of blocks and
draws how many blocks of each source go to the left from the multivariate hypergeometric law, so a
shard gets what a uniform shuffle of all blocks would give it and the quotas stay exact.  A leaf
then owns a run of each source's permuted blocks.  The runs are disjoint.  The final order within
a shard is local: rows sort by ``shuffle_key``.

Everything is DataFrame operations.  Documents are shuffled once, by (source, hash slice), so a
source that holds a third of the rows is spread over 4,096 slices.  The tree holds sources x shards
numbers, whatever the corpus.  Sources are mixture components: their number must stay in the
thousands, as each node of the tree holds one number for each.

Defined results: a null source is a source of its own and the last; null and empty texts have size
0 and nothing is taken of them; repeated rows are documents of their own; an empty table gives no
rows; columns of the input only appear inside ``row``, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifelog.llm.common import WORD, documents, let, unit
from lifelog.staging import stage

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Words to mix, in parts of all words.
SHARE = 1.5
#: Most that is taken of a source, in parts of its words.
CAP = 2.0
#: log2 of the number of output shards.
SHARD_BITS = 6
#: A source is cut into at least this many blocks, and no block exceeds ``BLOCK_WORDS``.
MIN_BLOCKS = 1024
BLOCK_WORDS = 4096


def sized(docs: DataFrame, carry: list[str], seed: int) -> DataFrame:
    """Size, source, hash key and hash slice of each document, and the carried columns as ``row``."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.select(
        F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"), F.shiftright(key, 52).alias("slice"), F.struct(*carry).alias("row"),
    )


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target words of each (source, source_size).

    Targets are ``min(cap x size, weight x level)`` at the one level where they sum to the share:
    what resharing the excess by weight ends in.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * cap
    everything = Window.partitionBy()
    # Sources are filled in the order in which a rising level reaches their caps.
    filling = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(filling), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0)))
    return (
        ranked.withColumn("weight", weight).withColumn("limit", limit)
        .withColumn("full_at", F.col("limit") / F.col("weight"))
        .withColumn("level_here", level)
        .withColumn("level", F.min_by("level_here", F.when(F.col("level_here") <= F.col("full_at"), F.col("full_at")))
                    .over(everything))
        .withColumn("target", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))))
        .select("source", "rank", "source_size", "target")
    )


def hypergeometric(u: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` items from ``population`` are among the ``marked``: inverse of ``u``.

    The law is summed over twelve standard deviations about the mean, beyond which it holds less
    than a double can tell.
    """
    mean = drawn * marked / population
    spread = F.sqrt(F.greatest(mean * (1 - marked / population) * (population - drawn)
                               / F.greatest(population - 1, F.lit(1)), F.lit(0.0))) * 12 + 12
    low = F.greatest(drawn + marked - population, F.floor(mean - spread), F.lit(0))
    high = F.least(drawn, marked, F.ceil(mean + spread))

    def pick(xs: Column) -> Column:
        def ratio(x: Column) -> Column:
            return ((marked - x) * (drawn - x)).cast("double") / ((x + 1) * (population - marked - drawn + x + 1))

        total = F.aggregate(
            xs, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w")),
            lambda a, x: F.struct((a["sum"] + a["w"]).alias("sum"), (a["w"] * ratio(x)).alias("w")), lambda a: a["sum"])
        return let(total * u, lambda goal: F.aggregate(
            xs, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"), xs[0].alias("x")),
            lambda a, x: F.struct(
                (a["sum"] + a["w"]).alias("sum"), (a["w"] * ratio(x)).alias("w"),
                F.when(a["sum"] <= goal, x).otherwise(a["x"]).alias("x")),
            lambda a: a["x"]))

    return F.when(population > 0, let(F.sequence(low, high), pick)).otherwise(F.lit(0).cast("long"))


def split_quotas(root: DataFrame, bits: int, seed: int) -> DataFrame:
    """(node, quotas) of the ``2 ** bits`` leaves under the one row (node 0, quotas)."""
    nodes = root
    for level in range(bits):
        node, quotas = F.col("node"), F.col("quotas")

        def draw(acc: Column, item: Column) -> Column:
            u = unit(F.lit(seed), F.lit(level), acc["node"], item["rank"])
            marked = item["quota"]
            return let(hypergeometric(u, acc["population"], marked, acc["drawn"]), lambda got: F.struct(
                acc["node"].alias("node"), (acc["population"] - marked).alias("population"),
                (acc["drawn"] - got).alias("drawn"), F.concat(acc["left"], F.array(got)).alias("left")))

        total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
        items = F.transform(quotas, lambda q, i: F.struct(i.cast("long").alias("rank"), q.alias("quota")))
        start = F.struct(node.alias("node"), total.alias("population"), F.floor(total / 2).alias("drawn"),
                         F.array().cast("array<bigint>").alias("left"))
        left = F.aggregate(items, start, draw, lambda a: a["left"])
        children = let(left, lambda go: F.array(
            F.struct((node * 2).alias("node"), go.alias("quotas")),
            F.struct((node * 2 + 1).alias("node"), F.zip_with(quotas, go, lambda q, g: q - g).alias("quotas"))))
        nodes = nodes.select(F.inline(children))
    return nodes


def shard_runs(targets: DataFrame, bits: int, seed: int, cap: float) -> DataFrame:
    """Per source: ``runs``, what each shard owns of its stream as (shard, epoch, start, stop) in words."""
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"source_size div {MIN_BLOCKS}")))
    blocks = F.ceil(F.col("source_size") / F.col("block"))
    whole = F.floor(F.try_divide("target", "source_size"))
    rest = F.round((F.col("target") - whole * F.col("source_size")) / F.col("block"))
    planned = (
        targets.withColumn("block", block.cast("long")).withColumn("blocks", blocks)
        .withColumn("quota", F.coalesce(whole * F.col("blocks") + F.least(rest, F.col("blocks")), F.lit(0)).cast("long"))
    )
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda s: s["quota"])
    root = planned.agg(quotas.alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    leaves = split_quotas(root, bits, seed).select("node", F.posexplode("quotas").alias("rank", "quota"))
    before = Window.partitionBy("rank").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    owned = leaves.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    positions = owned.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("node", "first", "quota"))).alias("owned"))

    def run(o: Column, epoch: Column) -> Column:
        start = F.greatest(o["first"] - epoch * F.col("blocks"), F.lit(0)) * F.col("block")
        stop = F.least(o["first"] + o["quota"] - epoch * F.col("blocks"), F.col("blocks")) * F.col("block")
        return F.struct(o["node"].cast("int").alias("shard"), epoch.cast("int").alias("epoch"), start.alias("start"),
                        F.least(stop, F.col("source_size")).alias("stop"))

    epochs = F.sequence(F.lit(0).cast("long"), F.lit(int(-(-cap // 1)) - 1).cast("long"))
    runs = F.filter(F.flatten(F.transform(F.col("owned"), lambda o: F.transform(epochs, lambda e: run(o, e)))),
                    lambda r: r["start"] < r["stop"])
    return planned.join(positions, "rank").select("source", "source_size", "target", runs.alias("runs"))


def mix(docs: DataFrame, carry: list[str] | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        shard_bits: int = SHARD_BITS, seed: int = 17, whole: bool = False) -> DataFrame:
    """One row per document: ``row`` (carried columns), size, source, source_size, target, pieces.

    A piece (shard, epoch, start, stop, shuffle_key) is what a shard takes of the document, in words
    counted from its start.  With ``whole`` a document goes to the shard that owns its first word and
    is taken as it is; sources then miss their targets by part of one document.
    """
    carry = docs.columns if carry is None else carry
    narrow = "text" not in carry
    rows = sized(docs, carry, seed)
    if narrow:
        rows = stage(rows, "mixture")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    slices = stage(slices, "mixture-slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    runs = stage(shard_runs(targets, shard_bits, seed, cap), "mixture-runs")

    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    joined = placed.join(runs.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # An empty document at the end of a slice reads as its last word.
    near = F.filter("runs", lambda r: (r["start"] < F.col("offset") + F.greatest("words", F.lit(1)))
                    & (r["stop"] > F.col("offset") - 1))
    table = joined.select(F.col("source").alias("in_source"), F.col("slice").alias("in_slice"), "source_size", "target",
                          "offset", near.alias("runs"))

    here = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("within", F.coalesce(F.sum("size").over(here), F.lit(0)))
    at = at.join(table, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("slice") == F.col("in_slice")))
    first = F.col("offset") + F.col("within")

    def piece(r: Column, start: Column, stop: Column) -> Column:
        return F.struct(r["shard"].alias("shard"), r["epoch"].alias("epoch"), start.alias("start"), stop.alias("stop"),
                        F.xxhash64(F.lit(seed), r["shard"], r["epoch"], F.col("key"), start).alias("shuffle_key"))

    if whole:
        word = F.least(first, F.col("source_size") - 1)
        hit = F.filter("runs", lambda r: (r["start"] <= word) & (word < r["stop"]))
        pieces = F.transform(hit, lambda r: piece(r, F.lit(0).cast("long"), F.col("size")))
    else:
        hit = F.filter("runs", lambda r: (r["start"] < first + F.col("size")) & (first < r["stop"]))
        pieces = F.filter(F.transform(hit, lambda r: piece(
            r, F.greatest(r["start"] - first, F.lit(0)), F.least(r["stop"] - first, F.col("size")))),
            lambda p: p["start"] < p["stop"])
    return at.select("row", "size", "source", "source_size", "target", pieces.alias("pieces"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write the pieces of ``mix`` by shard, each file in its shard's final order."""
    pieces = mixed.select("row", F.inline("pieces"))
    (pieces.repartition("shard", F.pmod("shuffle_key", F.lit(16))).sortWithinPartitions("shard", "shuffle_key")
     .write.partitionBy("shard").parquet(path))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, whole."""
    mixed = mix(docs, whole=True)
    return mixed.select(F.explode("pieces"), "row").select("row.*")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["stop"] - p["start"])
    return mix(documents(spark, sf_dir), carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


QUERIES = {"op1_mixture": op1_mixture}
ORACLE: dict[str, str] = {}
