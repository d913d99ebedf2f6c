"""Exact n-gram Jaccard join by pivots, Voronoi regions, triangle-inequality windows and recursion.

Sets with J(x, y) >= 9/10 are at Jaccard distance <= r = 1/10, and this holds
just when 19 |x - y| <= |x| + |y|, where x - y is the symmetric difference.
Documents with equal sets are one node.

*First division.* Almost all documents share no shingle, so they are at
distance 1 from any pivot, and no choice of pivots could part them. So nodes
are first divided by shingles: in one order of all shingles, linked sets share
one of the first |x| - ceil(9/10 |x|) + 1 of each, and those that share such a
shingle are a region. More exactly, a linked pair shares at least
min over both of (ceil(9/19 (|x| + |y|)) - ceil(9/10 |x|) + 1) of them, and
pairs are counted on that. Any order is exact; rare shingles first keep regions small.
Shingles in the lowest part of the hash range (twice as wide as the prefixes)
are counted over all documents. Those that stand in more than ``RARE``
documents are listed, the most frequent ``LISTED`` if there are more, and come
after the other counted ones, by count; shingles beyond that part come last.
A region of up to ``DIRECT`` nodes is joined directly. The nodes of larger ones
are divided once more, now with all their shingles ordered by how many of these
nodes hold them, in narrow bands of sizes, so that prefixes are shorter.

*Voronoi regions.* A region that is still larger gets ``PIVOTS`` pivots: its first nodes in an order of all nodes, by
how many large regions hold them. Exact distances to all of them are measured.
Each node belongs to the Voronoi region of its nearest pivot.

*Windows.* If y's nearest pivot is q and d(x, y) <= r, then d(x, q) <= d(y, q) + r
<= d(y, p) + r <= d(x, p) + 2 r, where p is x's nearest. So x is replicated to
the regions of all pivots q with d(x, q) <= d(x, p) + 2 r, and each linked pair
meets in a region. Nodes within r of the pivot link with it; they are one
component, so no pair among them needs a look.

*Recursion.* Let D(x) be the symmetric difference of x and the region's pivot p.
A linked pair has at least (|D(x)| + |D(y)| - (|x| + |y|) / 19) / 2 elements of
D in common, and one at least unless both are within r of p. So nodes stand in
rings of |D|; x goes on in its ring and in the inner ones in which a linked set
can be, with the first |D| - o + 1 elements of D(x), elements that few nodes
around p have in D first, where o is the least common part for that ring.
Nodes that share (pivot, ring, element) are a region of the next round.
Regions whose nodes are one component by now are done. Where up to ``OUTSIDE``
nodes are outside a region's main component, these are joined with all others
directly, pairs whose common element comes too late for a link left out, and
those that meet before: in the ring of the inner one of the two, at an earlier
element. Other regions get new pivots. All nodes of a pivot's region come after it in the order
of pivots, so the recursion ends, and a node has one row for each pivot, ring
and element however many regions they come from. A group of near copies costs a
star, not its pairs, and no step holds a region in one task.

A set's name has 64 bits, checked against 64 more: names that two sets share
are replaced. Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, cut, drop_cut, limit_batches
from .shingles import U, mix, shingle_hashes, text_buffers, word_hashes

MAX_BROADCAST_ROWS = 500_000
DIRECT, OUTSIDE = 32, 128
PIVOTS = 3
RARE, LISTED = 8, 1_000_000
#: Of how many first elements a row in a ring knows that they come before its own.
BEFORE = 32


class Threshold:
    """Jaccard >= num / den, with the exact bounds that follow from it."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the threshold lies between 0 and 1")
        self.num, self.den = num, den
        # J >= num/den just when (den + num) * |x - y| <= (den - num) * (|x| + |y|)
        self.a, self.b = den + num, den - num

    def linked(self, both: int, x: int, y: int) -> bool:
        return self.den * both >= self.num * (x + y - both)

    def alone(self, n: int) -> bool:
        """Whether a set of n elements can link with no other set than itself."""
        return self.b * n < self.num

    def prefix(self, n: int) -> int:
        """Of how many first elements linked sets share one."""
        return n + 1 - -(-self.num * n // self.den)

    def prefix_of(self, x: Column) -> Column:
        return x.cast("long") + 1 - _up(self.num * x.cast("long"), self.den)

    def both(self, x: Column, y: Column) -> Column:
        """How many elements linked sets of x and y elements share at least."""
        return _up(self.num * (x.cast("long") + y.cast("long")), self.a)

    def shared_prefix(self, x: Column, y: Column) -> Column:
        """How many elements the prefixes of linked sets of x and y elements share at least."""
        return self.both(x, y) - F.greatest(x.cast("long") - self.prefix_of(x), y.cast("long") - self.prefix_of(y))

    def early(self, x: Column, at: Column, y: Column) -> Column:
        """Whether the first element that a set of x elements shares with a linked one of y can have the place ``at``, from 0."""
        return x.cast("long") - at >= self.both(x, y)

    def sizes_fit(self, x: Column, y: Column) -> Column:
        x, y = x.cast("long"), y.cast("long")
        return (self.den * x >= self.num * y) & (self.den * y >= self.num * x)

    def apart(self, x: Column, y: Column) -> Column:
        """The greatest symmetric difference of linked sets of x and y elements."""
        return F.floor(self.b * (x.cast("long") + y.cast("long")) / self.a)

    def common(self, d: Column, x: Column, p: Column, ball: Column, least: Column) -> Column:
        """How many elements of D(x), of d elements, a linked set y has in D(y) too, if that has ``least`` or more and, where x is in the ball, y is not."""
        a, b = self.a, self.b
        outside = _up(F.when(ball, a * d + b * (p - x) + 1).otherwise(a * d - b * (x + p) + a - b), 2 * a)
        # y has at most |p| + |D(y)| and at most den / num |x| elements.
        by_pivot = _up(a * d - b * (x + p) + (a - b) * least, 2 * a)
        by_size = _up(a * (d + least) - b * (x + F.floor(self.den * x / self.num)), 2 * a)
        return F.greatest(F.lit(1), outside, by_pivot, by_size)

    def common_of_pair(self, dx: Column, x: Column, dy: Column, y: Column) -> Column:
        return _up(self.a * (dx + dy) - self.b * (x + y), 2 * self.a)


def _up(top: Column, by: int) -> Column:
    """top / by, rounded up, in whole numbers."""
    return ((top + by - 1 - F.pmod(top + by - 1, F.lit(by))) / by).cast("long")


def _sets(batch: pa.RecordBatch, k: int, name_bits: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """The distinct shingles of each text, in order, and the two halves of the set's name."""
    data, ends = text_buffers(batch.column("text"))
    words, offsets = word_hashes(data, ends)
    for i in range(len(offsets) - 1):
        own = np.unique(shingle_hashes(words[offsets[i] : offsets[i + 1]], k))
        with np.errstate(over="ignore"):
            one, two = (int(mix(own ^ U(seed)).sum(dtype=np.uint64).astype(np.int64)) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
        yield own, one >> (64 - name_bits), two


def describe(docs: DataFrame, k: int, t: Threshold, name_bits: int) -> DataFrame:
    """(doc_id, text_hash, h1, h2, n, low): low holds the elements in the lowest part of the hash range, the prefix at least, only where a task meets a set first."""
    top = U(_counted(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ones, twos, sizes, low, ends = [], [], [], [], [0]
            for own, one, two in _sets(batch, k, name_bits):
                ones.append(one)
                twos.append(two)
                sizes.append(len(own))
                keep = 0 if t.alone(len(own)) or (one, two) in seen else max(int(np.searchsorted(own, top, "right")), t.prefix(len(own)))
                seen.add((one, two))
                low.append(own[:keep])
                ends.append(ends[-1] + keep)
            flat = np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "text_hash", "h1", "h2", "n", "low"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, h1 long, h2 long, n int, low array<long>")


def _counted(t: Threshold) -> int:
    """The greatest hash of the part of the range in which shingles are counted."""
    return min((1 << 64) - 1, (2 * t.b << 64) // t.den)


def clashes(described: DataFrame) -> DataFrame | None:
    """(h1, h2, other): sets that share h1 with another set, and another name for each; None if there are none."""
    held = described.groupBy("h1").agg(F.min("h2").alias("_lo"), F.max("h2").alias("_hi")).where("_lo <> _hi").select("h1")
    found = cut(described.select("h1", "h2").join(held, "h1", "left_semi").distinct().withColumn("other", F.xxhash64("h1", "h2")), "clashes")
    if found.limit(1).count():
        return found
    drop_cut(found)
    return None


def named(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """h1 and h2 give way to node."""
    if clash is not None:
        rows = rows.join(clash, ["h1", "h2"], "left").withColumn("h1", F.coalesce("other", "h1")).drop("other")
    return rows.withColumnRenamed("h1", "node").drop("h2")


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than ``RARE`` documents, sorted, and their counts; of more than a power of two where these would exceed ``LISTED``."""
    sizes = {r["_b"]: r["_n"] for r in counts.where(F.col("c") > RARE).groupBy(F.ceil(F.log2("c")).alias("_b")).agg(F.count("*").alias("_n")).collect()}
    least, total = RARE, 0
    for b in sorted(sizes, reverse=True):  # c is above 2 ** (b - 1)
        total += sizes[b]
        if total > LISTED:
            least = max(RARE, 1 << int(b))
            break
    got = counts.where(F.col("c") > least).toArrow()
    hashes, n = got.column("element").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefixes(described: DataFrame, t: Threshold, listed: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h1, h2, n, keys): the first elements of each set in the order of all shingles."""
    sent, top = described.sparkSession.sparkContext.broadcast(listed), U(_counted(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = sent.value
        for batch in batches:
            column, sizes, keys, ends = batch.column("low"), batch.column("n").to_pylist(), [], [0]
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            rank = np.zeros(len(flat), np.int64)
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                rank = np.where(hashes[place] == flat, counts[place], 0)
            rank[flat > top] = 1 << 62
            for i, n in enumerate(sizes):
                own, by = flat[at[i] : at[i + 1]], rank[at[i] : at[i + 1]]
                if by.any():
                    own = own[np.argsort(by, kind="stable")]
                keys.append(own[: t.prefix(n)])
                ends.append(ends[-1] + len(keys[-1]))
            joined = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("n"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined))], names=["h1", "h2", "n", "keys"])

    return described.where(F.size("low") > 0).select("h1", "h2", "n", "low").mapInArrow(run, "h1 long, h2 long, n int, keys array<long>")


def sets_of(docs: DataFrame, k: int, name_bits: int, clash: DataFrame | None) -> DataFrame:
    """(node, shingles): sorted 64-bit hashes as bytes; a task gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            got = []
            for own, one, two in _sets(batch, k, name_bits):
                if (one, two) not in seen:
                    seen.add((one, two))
                    got.append((one, two, own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["h1", "h2", "shingles"])

    return named(docs.mapInArrow(run, "h1 long, h2 long, shingles binary"), clash)


def measure(pairs: DataFrame, sets: DataFrame, t: Threshold, differences: bool = False) -> DataFrame:
    """(node, pivot) to (node, pivot, linked, d, n, p): whether they link, |D|, |x| and |pivot|; with ``differences`` the elements of D as well."""
    left = sets.withColumnRenamed("shingles", "x")
    right = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("p"))
    full = pairs.join(left, "node").join(right, "pivot").select("node", "pivot", "x", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, ds, ns, ps, elements = [], [], [], [], []
            for bx, bp in zip(batch.column("x"), batch.column("p"), strict=True):
                x, p = np.frombuffer(bx.as_py(), np.uint64), np.frombuffer(bp.as_py(), np.uint64)
                at = np.searchsorted(p, x)
                there = p[np.minimum(at, len(p) - 1)] == x
                both = int(there.sum())
                linked.append(t.linked(both, len(x), len(p)))
                ds.append(len(x) + len(p) - 2 * both)
                ns.append(len(x))
                ps.append(len(p))
                if differences:
                    gone = np.ones(len(p), bool)
                    gone[at[there]] = False
                    elements.append(np.concatenate([x[~there], p[gone]]).view(np.int64))
            out = [batch.column("node"), batch.column("pivot"), pa.array(linked, pa.bool_()), pa.array(ds, pa.int64()), pa.array(ns, pa.int64()), pa.array(ps, pa.int64())]
            names = ["node", "pivot", "linked", "d", "n", "p"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(elements, pa.list_(pa.int64()))], names=[*names, "elements"]) if differences else pa.RecordBatch.from_arrays(out, names=names)

    return full.mapInArrow(run, "node long, pivot long, linked boolean, d long, n long, p long" + ", elements array<long>" * differences)


def small_pairs(regions: DataFrame, large: DataFrame | None, t: Threshold) -> DataFrame:
    """(node, pivot): pairs of regions of at most ``DIRECT`` nodes that share as many prefix elements as a link needs, and one of them early enough.

    Elements of large regions, which are not joined here, count as shared; pairs without an early one outside these are found there.
    """
    pairs = _met(regions, t).groupBy("node", "pivot").agg(F.count("*").alias("_c"), F.first(t.shared_prefix(F.col("n"), F.col("m"))).alias("_need"), F.bool_or(_early(t)).alias("_early")).where("_early")
    if large is None:
        return pairs.where("_c >= _need").select("node", "pivot")
    held = cut(large.groupBy("node").agg(F.count("*").alias("_h")), "held")
    few = held.count() <= MAX_BROADCAST_ROWS
    one, two = held.withColumnRenamed("_h", "_h1"), held.select(F.col("node").alias("pivot"), F.col("_h").alias("_h2"))
    pairs = pairs.join(F.broadcast(one) if few else one, "node", "left").join(F.broadcast(two) if few else two, "pivot", "left")
    return pairs.where(F.col("_c") + F.least(F.coalesce("_h1", F.lit(0)), F.coalesce("_h2", F.lit(0))) >= F.col("_need")).select("node", "pivot")


def _met(regions: DataFrame, t: Threshold) -> DataFrame:
    """(node, n, at, pivot, m, pivot_at): the pairs of each small region whose sizes allow a link."""
    small = regions.where(F.col("size") <= DIRECT)
    other = small.select("region", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("at").alias("pivot_at"))
    return small.join(other, (small["region"] == other["region"]) & (F.col("node") < F.col("pivot")) & t.sizes_fit(F.col("n"), F.col("m")))


def _early(t: Threshold) -> Column:
    return t.early(F.col("n"), F.col("at"), F.col("m")) & t.early(F.col("m"), F.col("pivot_at"), F.col("n"))


def banded_regions(sets: DataFrame, nodes: DataFrame, t: Threshold) -> DataFrame:
    """(region, node, n, at, size) of ``nodes``, with shingles ordered by how many of these nodes hold them.

    A region is a shingle in a band of sizes. A set stands in its own band and
    in the lower ones that linked sets can have, with the shingles that come
    early enough for the smallest size of that band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b.as_py(), np.int64) for b in batch.column("shingles")]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in own], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "n", "elements"])

    known = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_ROWS else nodes
    rows = sets.join(known, "node", "left_semi").mapInArrow(run, "node long, n int, elements array<long>").select("node", "n", F.explode("elements").alias("element"))
    rows = cut(rows, "elements")
    counts = rows.groupBy("element").agg(F.count("*").alias("c")).where("c > 1")
    held = rows.join(counts, "element").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "element"))).alias("_e"))
    # Shingles of one node alone come first.
    placed = held.select("node", "n", F.posexplode("_e").alias("_i", "_x"), (F.col("n") - F.size("_e")).alias("_alone")).select("node", "n", F.col("_x.element").alias("element"), (F.col("_alone") + F.col("_i")).alias("at"))
    ratio = (t.den / t.num) ** 0.25
    band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(ratio))).cast("int")
    least = F.greatest(F.lit(1), F.floor(F.pow(F.lit(ratio), F.col("_band")) - 1e-6))
    banded = placed.where(F.col("at") < t.prefix_of(F.col("n"))).withColumn("_band", F.explode(F.sequence(band(_up(t.num * F.col("n").cast("long"), t.den)), band(F.col("n")))))
    early = cut(banded.where(t.early(F.col("n"), F.col("at"), least)).select(F.xxhash64("element", "_band").alias("region"), "node", "n", "at"), "early")
    drop_cut(rows)
    sizes = early.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    regions = cut(early.join(sizes, "region"), "banded")
    drop_cut(early)
    return regions


def pivots_of(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(region, pivot): the ``PIVOTS`` nodes of most weight, then of greatest number; a task keeps no more of a region before rows are dealt out."""
    known = F.broadcast(weights) if weights.count() <= MAX_BROADCAST_ROWS else weights
    order = Window.partitionBy("region").orderBy(F.desc("weight"), F.desc("node"))
    ranked = rows.select("region", "node").join(known, "node").withColumn("_k", F.row_number().over(order))
    return ranked.where(F.col("_k") <= PIVOTS).select("region", F.col("node").alias("pivot"))


def voronoi(rows: DataFrame, sets: DataFrame, weights: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Links of large regions with their pivots, and (region, node, d, n, at, home, before) of the next round.

    Each node is measured with all pivots of its regions and goes on in the
    Voronoi regions of its nearest pivot and of those within the window. A
    Voronoi region all of whose nodes link with its pivot is done. The next
    regions are named by (pivot, ring, element), whatever region the pivot was
    chosen in; all their nodes come after the pivot in the order of weights.
    """
    chosen = cut(pivots_of(rows, weights), "pivots")
    known = F.broadcast(chosen) if chosen.count() <= MAX_BROADCAST_ROWS else chosen
    placed = cut(rows.select("region", "node").join(known, "region").where("node <> pivot"), "placed")
    stars = cut(measure(placed.select("node", "pivot").distinct(), sets, t), "stars")
    apart = 2 * F.col("d") / (F.col("n") + F.col("p") + F.col("d"))
    near = placed.join(stars.select("node", "pivot", "linked", apart.alias("apart")), ["node", "pivot"])
    home = near.groupBy("region", "node").agg(F.min("apart").alias("home"))
    within = near.join(home, ["region", "node"]).where(F.col("apart") <= F.col("home") + 2 * t.b / t.den + 1e-9)
    rest = cut(within.join(chosen.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti"), "cells")
    unlinked = rest.groupBy("region", "pivot").agg(F.bool_and("linked").alias("_done")).where("NOT _done").select("region", "pivot")
    divided = measure(rest.join(unlinked, ["region", "pivot"], "left_semi").select("node", "pivot").distinct(), sets, t, differences=True)
    spread = cut(ringed(cut(divided, "divided"), t), "rings")
    for used in (chosen, placed, rest):
        drop_cut(used)
    return stars, spread


def ringed(divided: DataFrame, t: Threshold) -> DataFrame:
    """(region, node, d, n, at, home, before): the nodes around each pivot by ring of |D| and element of D, elements that few nodes have in D first.

    A node stands in its own ring (``home``) and in the inner ones in which
    linked sets can be, with the elements that come early enough for the least
    |D| there. ``before``: which of its first ``BEFORE`` elements in the ring
    come before this one.
    """
    rows = divided.select("pivot", "node", "d", "n", "p", "linked", F.explode("elements").alias("element"))
    counts = divided.select("pivot", F.explode("elements").alias("element")).groupBy("pivot", "element").agg(F.count("*").alias("c")).where("c > 1")
    held = rows.join(counts, ["pivot", "element"]).groupBy("pivot", "node", "d", "n", "p", "linked").agg(F.sort_array(F.collect_list(F.struct("c", "element"))).alias("_e"))
    width = F.greatest(F.lit(1), F.floor(t.b * F.col("p") / (2 * t.a))).cast("long")
    ring = lambda d: F.floor(d / width).cast("int")
    inner = F.greatest(F.lit(0), F.col("d") - t.apart(F.col("n"), F.floor(t.den * F.col("n") / t.num)))
    spans = held.withColumn("_ring", F.explode(F.sequence(ring(inner), ring(F.col("d")))))
    most = F.col("d") - t.common(F.col("d"), F.col("n"), F.col("p"), F.col("linked"), F.col("_ring") * width) + 1
    alone = F.col("d") - F.size("_e")
    kept = F.slice("_e", 1, F.greatest(F.lit(0), most - alone).cast("int"))
    placed = spans.select("pivot", "_ring", "node", "d", "n", alone.alias("_alone"), (F.col("_ring") == ring(F.col("d"))).alias("home"), F.slice("_e.element", 1, BEFORE).alias("_first"), F.posexplode(kept).alias("_i", "_x"))
    return placed.select(F.xxhash64("pivot", "_ring", "_x.element").alias("region"), "node", "d", "n", (F.col("_alone") + F.col("_i")).alias("at"), "home", F.slice("_first", F.lit(1), F.col("_i")).alias("before"))


def open_regions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(region, node, d, n, at, home, before) to the same with component, size and outside, in regions of several components.

    outside: whether the node is not of the region's largest component; size:
    how many such nodes there are.
    """
    small = labels.count() <= MAX_BROADCAST_ROWS
    known = cut(rows.join(F.broadcast(labels) if small else labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    parts = known.groupBy("region", "component").agg(F.count("*").alias("_c"))
    mixed = parts.groupBy("region").agg(F.sum("_c").alias("_all"), F.max(F.struct("_c", "component")).alias("_top"))
    mixed = mixed.where(F.col("_all") > F.col("_top._c")).select("region", (F.col("_all") - F.col("_top._c")).alias("size"), F.col("_top.component").alias("_main"))
    out = cut(known.join(mixed, "region").withColumn("outside", F.col("component") != F.col("_main")).drop("_main"), "regions")
    drop_cut(known)
    return out


def direct_pairs(regions: DataFrame, t: Threshold) -> DataFrame:
    """(node, pivot): the pairs of ``meetings``, each once; several pivots can have one."""
    return meetings(regions, t).distinct()


def meetings(regions: DataFrame, t: Threshold) -> DataFrame:
    """(node, pivot): pairs of different components, whose first common element comes early enough for a link, in regions of at most ``OUTSIDE`` nodes outside the main component.

    Only these meet all others, so a node has at most as many pairs in a region.
    Where two nodes share several elements, all but the first (as far as
    ``before`` tells) are passed over, as are rings in which neither is at
    home: the two meet in the ring of the inner one, and at the first element
    that they share. If the region of that is large, its pivots part them.
    """
    small = regions.where(F.col("size") <= OUTSIDE)
    other = small.select("region", F.col("node").alias("pivot"), F.col("component").alias("_c"), F.col("d").alias("_d"), F.col("n").alias("_n"), F.col("at").alias("_at"), F.col("outside").alias("_o"), F.col("home").alias("_home"), F.col("before").alias("_before"))
    need = t.common_of_pair(F.col("d"), F.col("n"), F.col("_d"), F.col("_n"))
    near = (F.col("d") - F.col("at") >= need) & (F.col("_d") - F.col("_at") >= need)
    once = ~F.col("_o") | (F.col("node") < F.col("pivot"))
    first = (F.col("home") | F.col("_home")) & ~F.arrays_overlap("before", "_before")
    met = small.where("outside").join(other, (small["region"] == other["region"]) & once & (F.col("component") != F.col("_c")) & near & first)
    return met.select(F.least("node", "pivot").alias("node"), F.greatest("node", "pivot").alias("pivot"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, by hooking on smaller labels and jumping."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    edges = cut(both, "edges")
    labels = cut(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    # A short list of labels is sent to the edges instead of both being shuffled each time.
    sent = F.broadcast if labels.count() <= MAX_BROADCAST_ROWS else (lambda df: df)
    while True:
        near = edges.join(sent(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        hooked = near.join(sent(labels), "node").select("node", F.col("component").alias("was"), F.least("component", "theirs").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("above"))
        stepped = cut(hooked.join(sent(up), "new", "left").select("node", "was", F.least("new", F.coalesce("above", "new")).alias("component")), "labels")
        moved = stepped.where("was <> component").limit(1).count()
        drop_cut(labels)
        if not moved:
            drop_cut(edges)
            return stepped.select("node", "component")
        labels = stepped.select("node", "component")
        labels._graphloom_path = stepped._graphloom_path


def fetch_sets(own: DataFrame, table: DataFrame, active: DataFrame, k: int, name_bits: int, clash: DataFrame | None) -> DataFrame:
    """(node, shingles) of the active nodes, in buckets of node, from one document of each."""
    least = cut(table.join(active, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "representatives")
    reps = least.where("doc_id IS NOT NULL").select("doc_id").distinct()
    wanted = F.broadcast(reps) if reps.count() <= MAX_BROADCAST_ROWS else reps
    fetched = sets_of(own.join(wanted, "doc_id", "left_semi"), k, name_bits, clash)
    # Nodes that stand under null ids only are fetched by node: no id finds them.
    nameless = least.where("doc_id IS NULL").select("node")
    if n_nameless := nameless.count():
        missing = F.broadcast(nameless) if n_nameless <= MAX_BROADCAST_ROWS else nameless
        fetched = fetched.unionByName(sets_of(own.where("doc_id IS NULL"), k, name_bits, clash).join(missing, "node", "left_semi"))
    sets = bucket(fetched, "node", "shingles")
    drop_cut(least)
    return sets


def join_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 9, den: int = 10, name_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node, n) of every document and links (a, b) between nodes.

    ``links`` connect the same nodes as all pairs of Jaccard >= num / den would.
    """
    limit_batches(docs.sparkSession)
    t = Threshold(num, den)
    body = F.col(f"`{text}`")
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    described = cut(describe(own, k, t, name_bits), "described")
    clash = clashes(described)
    table = cut(named(described.select("doc_id", "text_hash", "h1", "h2", "n"), clash), "nodes")
    counts = cut(described.select(F.explode("low").alias("element")).groupBy("element").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    first = named(prefixes(described, t, frequent(counts)), clash).select(F.posexplode("keys").alias("at", "element"), "node", "n")
    met = cut(first.join(counts.select("element"), "element").select(F.col("element").alias("region"), "node", "n", "at").distinct(), "met")
    drop_cut(described)
    drop_cut(counts)
    sizes = met.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    regions = cut(met.join(sizes, "region"), "regions")
    drop_cut(met)
    large = regions.where(F.col("size") > DIRECT)
    any_large = large.limit(1).count() > 0
    pairs = cut(small_pairs(regions, large if any_large else None, t), "pairs")
    active = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).unionByName(large.select("node")).distinct()
    sets = fetch_sets(own.select("doc_id", "text"), table, active, k, name_bits, clash)
    as_links = lambda rows: rows.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = as_links(cut(measure(pairs, sets, t), "direct"))
    drop_cut(pairs)
    spread = None
    if any_large:
        crowd = cut(large.select("node").distinct(), "crowd")
        drop_cut(regions)
        regions = banded_regions(sets, crowd, t)
        links = links.unionByName(as_links(cut(measure(_met(regions, t).where(_early(t)).select("node", "pivot").distinct(), sets, t), "direct")))
        large = regions.where(F.col("size") > DIRECT)
        if large.limit(1).count():
            weights = cut(large.groupBy("node").agg(F.count("*").alias("weight")), "weights")
            stars, spread = voronoi(large, sets, weights, t)
            links = links.unionByName(as_links(stars))
    drop_cut(regions)
    while spread is not None:
        regions = open_regions(spread, components(links))
        kinds = {r["big"] for r in regions.select((F.col("size") > OUTSIDE).alias("big")).distinct().collect()}
        if False in kinds:
            links = links.unionByName(as_links(cut(measure(direct_pairs(regions, t), sets, t).drop("elements"), "direct")))
        spread = None
        if True in kinds:
            stars, spread = voronoi(regions.where(F.col("size") > OUTSIDE), sets, weights, t)
            links = links.unionByName(as_links(stars))
    drop_cut(sets)
    return table, links


def group_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 9, den: int = 10, name_bits: int = 64) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, component, n_links) of every document; component: the least node that links reach, null for empty sets."""
    table, links = join_sets(docs, key, text, k, num, den, name_bits)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = cut(components(links).join(ends, "node"), "linked")
    known = F.broadcast(linked) if linked.count() <= MAX_BROADCAST_ROWS else linked
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component")
    return table.join(known, "node", "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "node", component, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 9, den: int = 10, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every document.

    Words are runs of characters other than ASCII white space, A-Z
    lower-cased; the set holds distinct k-word shingles, or the whole sequence
    if it is shorter. Null texts and texts without words have empty sets and
    link with nothing, not even with each other. component_id: the smallest
    key that links reach; class_id: that of documents with an equal set.
    n_links: links found from the class to other classes (enough to connect
    all that link). Repeated rows each get a row; other columns are dropped;
    an empty table gives none. A null key is never the smallest, but its text
    links as any other; where all keys are null, component_id and class_id are.
    """
    grouped = cut(group_documents(docs, key, text, k, num, den, name_bits), "grouped")
    full = grouped.where("component IS NOT NULL")
    classes = full.groupBy("component", "node").agg(F.min("doc_id").alias("class_id"))
    smallest = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_rows = full.join(classes, ["component", "node"]).join(smallest, "component").select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
    empty = grouped.where("component IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), "n_links")
    return named_rows.unionByName(empty)
