"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, buckets with probes, verified pairs.

A vector is rotated by signs and Hadamard transforms, three times over; its
hash is the axis, with its sign, that it then lies closest to. A table joins
several such hashes, and a vector also looks into the buckets of the next
closest axes (probes). Vectors that meet in a bucket are candidates, and each
is verified by its cosine in double precision.

Equal directions are one node. A crowded bucket is cut into blocks and every
two blocks meet in a task of their own; a task gives counts and a spanning
forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, limit_batches
from .jaccard_join import components

SEED = 20_231
#: Nodes of a bucket that meet in one task; more are cut into blocks of this size.
BLOCK = 1024
#: Pairs whose cosines are taken at a time.
PART = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    y, h = x.copy(), 1
    while h < d:
        y = y.reshape(n, d // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return y / np.sqrt(d)


class CrossPolytope:
    """``tables`` x ``width`` cross-polytope hashes of vectors of ``dim`` components, and the probes of each table."""

    def __init__(self, dim: int, tables: int, width: int, probes: int, seed: int = SEED):
        self.dim, self.d, self.tables, self.width, self.probes = dim, 1 << max(1, (dim - 1).bit_length()), tables, width, probes
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, width, 3, self.d))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """[n, tables, probes] bucket numbers, a vector's own first, the others those that it misses least.

        Choices of axes cost the squared differences of their coordinates from
        the greatest; the cheapest combinations over the table's hashes are probed.
        """
        padded = np.zeros((len(unit), self.d))
        padded[:, : self.dim] = unit
        out = np.empty((len(unit), self.tables, self.probes), np.int64)
        some = min(2 * self.d, self.probes)
        for t in range(self.tables):
            cost, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
            for signs in self.signs[t]:
                y = padded
                for s in signs:
                    y = hadamard(y * s)
                both = np.concatenate([y, -y], axis=1)
                axes = np.argpartition(-both, some - 1, axis=1)[:, :some]
                miss = (both.max(axis=1)[:, None] - np.take_along_axis(both, axes, 1)) ** 2
                cost = (cost[:, :, None] + miss[:, None, :]).reshape(len(unit), -1)
                code = (code[:, :, None] * (2 * self.d) + axes[:, None, :]).reshape(len(unit), -1)
                if cost.shape[1] > self.probes:
                    best = np.argpartition(cost, self.probes - 1, axis=1)[:, : self.probes]
                    cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            first = cost.argmin(axis=1)
            row = np.arange(len(unit))
            code[row, 0], code[row, first] = code[row, first], code[row, 0].copy()
            out[:, t] = code
        return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; the greatest component is divided out first, so no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _first_meeting(own: np.ndarray, other: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs of nodes, given by their codes [n, tables, probes], meet in this table's bucket and in none before it."""
    mine, theirs = own[:, :, 0], other[:, :, 0]
    at_theirs, at_mine = (own == theirs[:, :, None]).any(axis=2), (other == mine[:, :, None]).any(axis=2)
    meets = at_theirs | at_mine
    row, far = np.arange(len(own)), np.iinfo(np.int64).max
    least = np.minimum(np.where(at_theirs, theirs, far), np.where(at_mine, mine, far))
    return (meets.argmax(axis=1) == table) & (least[row, table] == bucket)


def _connect(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that pairs (a, b) reach from each of ``n``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs_in_groups(starts: np.ndarray, n: int, side: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups of rows (``starts``: where each begins), of different blocks or of one met with itself, one of both in its own bucket; in parts of bounded size."""
    group = np.searchsorted(starts, np.arange(n), "right")
    later = np.append(starts[1:], n)[group - 1] - np.arange(n) - 1
    ends = np.cumsum(later)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        some = later[at:to]
        i = np.repeat(np.arange(at, to), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        wanted = (own[i] | own[j]) & ((side[i] < 0) | (side[i] != side[j]))
        yield i[wanted], j[wanted]
        at = to


def _usable(v: Column) -> Column:
    """Vectors of finite components of which one is not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def bucket_rows(nodes: DataFrame, tables: int, width: int, probes: int) -> DataFrame:
    """(slot, code, node, own): the buckets of each of (node, v); slot names the table and the vectors' length, own the node's first choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, CrossPolytope] = {}
        for batch in batches:
            dims = pc.list_value_length(batch.column(1)).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, len(part), 1024):
                    some = part.slice(at, 1024)
                    h = hashes.setdefault(dim, CrossPolytope(dim, tables, width, probes))
                    codes = h.codes(unit_rows(_matrix(some.column(1))))
                    node = np.repeat(some.column(0).to_numpy(), tables * codes.shape[2])
                    slot = np.tile(np.repeat(np.arange(tables) + tables * dim, codes.shape[2]), len(some))
                    own = np.tile(np.arange(codes.shape[2]) == 0, len(some) * tables)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(codes.ravel()), pa.array(node), pa.array(own)], names=["slot", "code", "node", "own"])

    return nodes.select("node", "v").mapInArrow(run, "slot long, code long, node long, own boolean")


def verified(met: DataFrame, tables: int, width: int, probes: int, least: float) -> DataFrame:
    """(node, root, links): what a node links with in the groups of a batch, by number of rows, and the least node that these links reach there.

    ``met``: (slot, code, i, j, block, node, size, own, v), sorted by slot,
    code, i, j and not divided within such a group. A pair counts where it
    meets first, so in one group of one table.
    """

    def judge(rows: pa.RecordBatch, hashes: dict[int, CrossPolytope]) -> Iterator[pa.RecordBatch]:
        slot, code, i, j, block, node, size, own = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        # Rows are sorted by slot, so vectors of one length lie together.
        for dim in np.unique(slot // tables).tolist():
            at = np.flatnonzero(slot // tables == dim)
            unit = unit_rows(_matrix(rows.column(8).slice(int(at[0]), len(at))))
            keys = np.stack([x[at] for x in (slot, code, i, j)], 1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            side = np.where(i[at] == j[at], -1, block[at])
            found = []
            for a, b in _pairs_in_groups(starts, len(at), side, own[at]):
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                found.append((a[near], b[near]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            if not len(a):
                continue
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            h = hashes.setdefault(dim, CrossPolytope(dim, tables, width, probes))
            codes = np.concatenate([h.codes(unit[used[k : k + 1024]]) for k in range(0, len(used), 1024)])
            x, y = back[: len(a)], back[len(a) :]
            first = np.concatenate([_first_meeting(codes[x[k : k + 4096]], codes[y[k : k + 4096]], slot[at][a[k : k + 4096]] % tables, code[at][a[k : k + 4096]]) for k in range(0, len(a), 4096)])
            names, place = np.unique(node[at], return_inverse=True)
            sizes = np.zeros(len(names), np.int64)
            sizes[place] = size[at]
            p, q = place[a[first]], place[b[first]]
            links = np.zeros(len(names), np.int64)
            np.add.at(links, p, sizes[q])
            np.add.at(links, q, sizes[p])
            root = _connect(p, q, len(names))
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]]), pa.array(links[some])], names=["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, CrossPolytope] = {}
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = [rows.column(k).to_numpy() for k in range(4)]
            same = np.logical_and.reduce([x == x[-1] for x in keys])
            last = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from judge(rows.slice(0, last), hashes)
            held = rows.slice(last)
        if held is not None and len(held):
            yield from judge(held, hashes)

    return met.mapInArrow(run, "node long, root long, links long")


def hash_width(n: int, dim: int) -> int:
    """As many hashes a table as make eight buckets or more for each of ``n`` nodes."""
    axes, width = 2 << max(1, (dim - 1).bit_length()), 1
    while axes**width < 8 * n:
        width += 1
    return width


def near_duplicates(
    vectors: DataFrame, num: int = 9, den: int = 10, key: str = "vec_id", vector: str = "embedding",
    tables: int = 6, width: int | None = None, probes: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept): rows linked with others at cosine >= ``num`` / ``den``, in double precision.

    n_links counts other rows, equal ones too; component_id is the smallest
    key that links reach, itself included; kept marks the rows whose key it
    is. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, nor do vectors of different lengths. Rows
    of null keys are left out. Repeated keys are rows of their own. An empty
    table gives an empty table; other columns play no part.

    A bucket takes ``width`` hashes, by default enough for eight buckets a
    node, and a node looks into ``probes`` buckets of each table, by default
    twice as many for each hash more, as wider buckets are missed more often.
    Pairs whose cosine is the threshold itself may meet in no table; a test
    measures their share.
    """
    spark = vectors.sparkSession
    limit_batches(spark, 4096)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id IS NOT NULL")
    named = rows.select("id", "v", F.when(_usable(F.col("v")), F.xxhash64("v")).alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))
    distinct = named.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    n, dim = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = width or hash_width(n, dim)
    probes = probes or 2 << width

    looked = cut(bucket_rows(nodes, tables, width, probes), "looked")
    lived = looked.where("own").groupBy("slot", "code").agg(F.lit(True).alias("_lived"))
    met = cut(looked.join(lived.drop("_lived"), ["slot", "code"], "left_semi"), "met")
    sizes = met.groupBy("slot", "code").agg(F.count("*").alias("m")).where("m > 1")
    # A bucket of m nodes is m / block blocks, and a node goes to the meetings of its own block with each.
    blocks = F.ceil(F.col("m") / block)
    crowd = met.join(sizes, ["slot", "code"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    each = crowd.select("slot", "code", "node", "own", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other"))
    dealt = each.select("slot", "code", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "node", "own")
    full = dealt.join(nodes.select("node", "size", "v"), "node").select("slot", "code", "i", "j", "block", "node", "size", "own", "v")
    placed = full.repartition("slot", "code", "i", "j").sortWithinPartitions("slot", "code", "i", "j")
    found = cut(verified(placed, tables, width, probes, num / den), "vector-links")
    for step in (looked, met):
        drop_cut(step)

    parts = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "h1", "h2", "first", "size").join(links, "node", "left").join(parts, "node", "left")
    least = known.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    judged = known.join(least, "component", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    own = named.select("id", "h1", "h2").join(judged, ["h1", "h2"], "left")
    out = own.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", key)


ORACLE_OP11 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)"""
