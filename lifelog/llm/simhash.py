"""SimHash near-duplicates through BK-trees.

A fingerprint is the bitwise majority over the hashes of a text's word shingles.  Equal fingerprints
are folded into one row first, so copies cost one aggregate, whatever their number.  Two different
fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit ranges, so
they meet in a shard keyed by some choice of that many ranges and their values.  Every shard holds
one BK-tree: its root is a fingerprint, children are keyed by their integer Hamming distance to the
parent, and a search follows the edges within ``radius`` of its own distance only.  All shards of an
Arrow batch are built and searched together, level by level, in numpy.

A broadcast of all trees would grow with the corpus, so each shard's tree goes to the task that holds
the shard instead.  The number of blocks follows the number of fingerprints, so that a shard is
expected to hold a few of them; every choice finds all pairs.

Links leave a task as stars over its shards' members, never as all pairs of a group, and members that
the tree's own edges connect are not searched for again, so a large group of close texts stays linear.  Components
are then the fixed point of neighbour and pointer minima over tables in the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifelog.llm.common import WORD, documents, map_rows, ship_package
from lifelog.staging import stage

RADIUS = 3
SHINGLE = 3
#: Fingerprints a shard is expected to hold before another block is added.
SHARD_FINGERPRINTS = 8
#: Search steps that numpy takes at once.
FRONTIER = 1 << 18

_WORDS = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without a word."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    data = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist() + [len(data)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], 42) for a, b in zip(starts, ends[last:])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at:at + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: Column, shingle: int = SHINGLE) -> DataFrame:
    """(doc_key, fp) of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        values = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
        return pd.DataFrame({"doc_key": batch["doc_key"], "fp": values.view(np.int64)})

    kind = docs.select(key.alias("doc_key")).dtypes[0][1]
    return map_rows(docs.select(key.alias("doc_key"), "text"), run, f"doc_key {kind}, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """One BK-tree for each shard of a batch, as arrays.

    ``order`` lists the members so that a node's children of one distance follow each other; a node
    is the first member of its range, and the rest of the range hangs below it.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        n = len(fp)
        self.child_of = np.full(n, -1, np.int64)  # parent of each node
        self.edge = np.zeros(n, np.int64)  # distance to the parent
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        group = np.cumsum(first) - 1 if n else np.zeros(0, np.int64)
        self.root_of = self.roots[group] if n else np.zeros(0, np.int64)
        # Members that still look for their place, and the node they hang below.
        members = np.flatnonzero(~first)
        below = self.root_of[members]
        self.levels: list[np.ndarray] = []
        while len(members):
            distance = popcount(fp[members] ^ fp[below]).astype(np.int64)
            by = np.lexsort((members, distance, below))
            members, below, distance = members[by], below[by], distance[by]
            head = np.r_[True, (below[1:] != below[:-1]) | (distance[1:] != distance[:-1])]
            heads = members[head]
            self.child_of[heads], self.edge[heads] = below[head], distance[head]
            self.levels.append(heads)
            below = heads[np.cumsum(head) - 1][~head]
            members = members[~head]
        kids = np.flatnonzero(self.child_of >= 0)
        kids = kids[np.lexsort((self.edge[kids], self.child_of[kids]))]
        self.kids = kids
        # Children of one node sorted by edge: a range of edges is a range of ``kids``.
        self.kid_key = self.child_of[kids] * 128 + self.edge[kids]

    def steps(self, queries: np.ndarray, radius: int, open_=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, nodes, distances) of the searches from ``queries``, a bounded number at a time.

        ``open_(queries, nodes)`` tells which subtrees are still worth a visit; all without it.
        """
        stack = [(queries, self.root_of[queries])]
        while stack:
            queries, nodes = stack.pop()
            if open_ is not None:
                keep = open_(queries, nodes)
                queries, nodes = queries[keep], nodes[keep]
            if not len(queries):
                continue
            distance = popcount(self.fp[queries] ^ self.fp[nodes]).astype(np.int64)
            yield queries, nodes, distance
            low = np.searchsorted(self.kid_key, nodes * 128 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.kid_key, nodes * 128 + distance + radius, "right")
            width = high - low
            some = width > 0
            queries, low, width = queries[some], low[some], width[some]
            if not len(queries):
                continue
            # A slice at a time, so that memory is bounded by the frontier and the deepest level.
            for at in _cuts(width, FRONTIER):
                w = width[at]
                index = np.repeat(low[at] - np.r_[0, np.cumsum(w)[:-1]], w) + np.arange(w.sum())
                stack.append((np.repeat(queries[at], w), self.kids[index]))

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(member, node) for every pair of a shard within ``radius``, node before member."""
        for at in range(0, len(self.fp), FRONTIER):
            for queries, nodes, distance in self.steps(np.arange(at, min(len(self.fp), at + FRONTIER)), radius):
                hit = (distance <= radius) & (nodes < queries)
                yield queries[hit], nodes[hit]

    def groups(self, radius: int) -> np.ndarray:
        """The smallest member connected to each over links within ``radius``.

        Edges of the tree within the radius are links already, so a group of close fingerprints is
        one before any search; a search then leaves out subtrees that are all of its own group.
        """
        label = np.arange(len(self.fp))
        close = np.flatnonzero((self.child_of >= 0) & (self.edge <= radius))
        label = _united(label, close, self.child_of[close])
        for at in range(0, len(self.fp), FRONTIER):
            whole = np.ones(len(self.fp), bool)  # subtrees of one group; groups only grow, so they stay so
            for heads in reversed(self.levels):
                above = self.child_of[heads]
                whole[above[~whole[heads] | (label[heads] != label[above])]] = False
            queries = np.arange(at, min(len(self.fp), at + FRONTIER))
            for q, nodes, distance in self.steps(queries, radius, lambda q, n: ~whole[n] | (label[q] != label[n])):
                hit = distance <= radius
                label = _united(label, q[hit], nodes[hit])
        return label


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after the groups of each pair of ``a`` and ``b`` are one."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _cuts(width: np.ndarray, most: int) -> list[slice]:
    """Slices of ``width`` that sum to about ``most`` each."""
    total = np.cumsum(width)
    marks = np.unique(np.r_[0, np.searchsorted(total, np.arange(most, total[-1] + most, most), "left") + 1, len(width)])
    marks = marks[marks <= len(width)]
    return [slice(a, b) for a, b in zip(marks[:-1], marks[1:])]


def shard_links(keyed: DataFrame, radius: int, edges: bool = False) -> DataFrame:
    """(node, other) links in each shard of (shard, fp, node): each member of a group with its first one.

    With ``edges`` each member comes with its parent in the tree too, if that is within the radius.
    """

    def links(batch: pd.DataFrame) -> pd.DataFrame:
        shard, fp, node = (batch[c].to_numpy() for c in ("shard", "fp", "node"))
        forest = Forest(shard, fp.view(np.uint64))
        first = forest.groups(radius)
        a = np.flatnonzero(first != np.arange(len(fp)))
        b = first[a]
        if edges:
            close = np.flatnonzero((forest.child_of >= 0) & (forest.edge <= radius))
            a, b = np.r_[a, close], np.r_[b, forest.child_of[close]]
        return pd.DataFrame({"node": node[a], "other": node[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the last shard of a batch may go on in the next
        for batch in batches:
            if not len(batch):
                continue
            last = batch["shard"].iat[-1]
            if kept and batch["shard"].iat[0] == last == kept[-1]["shard"].iat[-1]:
                kept.append(batch)
                continue
            cut = int(np.searchsorted(batch["shard"].to_numpy(), last, "left"))
            whole = pd.concat([*kept, batch.iloc[:cut]])
            if len(whole):
                yield links(whole)
            kept = [batch.iloc[cut:]]
        if kept:
            yield links(pd.concat(kept))

    ship_package(keyed.sparkSession)
    return (keyed.select("shard", "fp", "node").repartition("shard").sortWithinPartitions("shard", "fp", "node")
            .mapInPandas(run, "node long, other long"))


def block_plan(count: int, radius: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): the fewest whose shards are expected to stay small."""
    for blocks in range(radius + 1, 2 * radius + 4):
        same = blocks - radius
        if count * 2.0 ** -(64 * same // blocks) <= SHARD_FINGERPRINTS:
            break
    return blocks, same


def shard_keys(fps: DataFrame, blocks: int, same: int) -> DataFrame:
    """(shard, fp, node): each (fp, node) under every choice of ``same`` of ``blocks`` bit ranges."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
             for chosen in combinations(range(blocks), same)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    return fps.select(F.explode(keys).alias("shard"), "fp", "node")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over (node, other), for linked nodes.

    Each round takes the smallest label beside each node and beside its tree, and halves the paths.
    """
    edges = links.where("node <> other").distinct()
    both = stage(edges.union(edges.select("other", "node")).distinct(), "simhash-edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "simhash-labels")
    while True:
        beside = (
            both.join(labels.withColumnsRenamed({"node": "n", "root": "near"}), F.col("other") == F.col("n"))
            .groupBy("node").agg(F.min("near").alias("near"))
        )
        told = labels.join(beside, "node").select("node", "root", F.least("root", "near").alias("own"))
        trees = told.groupBy(F.col("root").alias("r")).agg(F.min("own").alias("low"))
        joined = stage(
            told.join(trees, F.col("root") == F.col("r"), "left").select("node", "root", F.least("own", "low").alias("low")),
            "simhash-labels")
        jump = joined.select(F.col("node").alias("v"), F.col("low").alias("far"))
        moved = stage(
            joined.join(jump, F.col("low") == F.col("v"), "left")
            .select("node", "root", F.least("low", F.coalesce("far", "low")).alias("low")), "simhash-labels")
        changed = moved.where("low <> root").limit(1).count()
        labels = moved.select("node", F.col("low").alias("root"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, key: Column, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_key, fp, component): the smallest ``doc_key`` reachable over links of ``radius`` bits.

    Defined results: null, empty and blank texts have fingerprint 0 and link like any other; null keys
    get the smallest key of their component, or null if it has none; repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    marked = stage(fingerprints(docs, key, shingle), "simhash-fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_key").alias("least_key")), "simhash-classes")
    blocks, same = block_plan(classes.count(), radius)
    keyed = shard_keys(classes.select("fp", F.col("fp").alias("node")), blocks, same)
    roots = components(stage(shard_links(keyed, radius), "simhash-links")).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least_key", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_key").alias("component"))
    named = rooted.join(least, "root").select(F.col("fp").alias("class_fp"), "component")
    return marked.join(named, F.col("fp") == F.col("class_fp")).select("doc_key", "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(documents(spark, sf_dir), F.col("doc_id"))
    return found.select(F.col("doc_key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE: dict[str, str] = {}
