"""Hard-negative mining: ball trees whose nodes bound inner products from both sides.

Rows are dealt into cells around pivots, so that near rows share a tree.
Anchors meet every cell in slices, a task for each cell and slice. There a
ball tree of the cell gives, for a query q and a ball of centre c and radius
r, that all scores lie within q.c - |q| r and q.c + |q| r. A ball is passed
over if that range misses the window of scores, or if it lies strictly
beneath the query's k-th best score so far. First each anchor's positives are
found (same label, no window), then for each positive its window's negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, limit_batches

LEAF = 64
#: Rows of a cell and of a slice of anchors: what one task holds.
CELL_ROWS = 65_536
#: Small tables are cut into as many cells as this, for more tasks.
LEAST_CELLS = 64
#: Pivots are rows of the least key hashes, so many at most; they decide where rows lie, not what is found.
MAX_PIVOTS = 256
NONE = np.iinfo(np.int64).min
FAR = np.iinfo(np.int64).max


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers (as doubles) as 64-bit integers, exact; beyond 64 bits they are an error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return exact.astype(np.int64)


class BallTree:
    """Balls over rows of whole numbers, halved along the line between two far rows until ``LEAF`` are left."""

    def __init__(self, points: np.ndarray):
        self.order, self.nodes = np.arange(len(points)), []
        stack = [(0, len(points), -1, 0)]
        while stack:
            start, end, parent, which = stack.pop()
            own = points[self.order[start:end]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append([start, end, centre, float(away.max()), -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + which] = me
            if end - start <= LEAF or away.max() == 0:
                continue
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (end - start) // 2
            side = np.argpartition(own @ (other - one), half)
            self.order[start:end] = self.order[start:end][side]
            stack += [(start, start + half, me, 0), (start + half, end, me, 1)]

    def best(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, own: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) [queries, k] of the best rows whose label is the query's (``same``) or is not, with scores from ``low`` to ``high`` and another id than ``own``; ties go to the smaller id, empty places hold ``NONE``."""
        top, who = np.full((len(queries), k), NONE), np.full((len(queries), k), FAR)
        length = np.sqrt((queries * queries).sum(axis=1))
        stack = [(0, np.arange(len(queries)))]
        while stack:
            number, asked = stack.pop()
            start, end, centre, radius, left, right = self.nodes[number]
            middle, reach = queries[asked] @ centre, length[asked] * radius
            slack = 1 + 1e-9 * (np.abs(middle) + reach)
            upper, lower = middle + reach + slack, middle - reach - slack
            alive = (upper >= low[asked]) & (lower <= high[asked]) & (upper >= top[asked, -1])
            asked = asked[alive]
            if not len(asked):
                continue
            if left >= 0:
                closer = queries[asked] @ (self.nodes[left][2] - self.nodes[right][2]) >= 0
                stack += [(right, asked[closer]), (left, asked[closer]), (left, asked[~closer]), (right, asked[~closer])]
                continue
            rows = self.order[start:end]
            for at in range(0, len(asked), 1024):
                some = asked[at : at + 1024]
                score = whole_scores(queries[some], points[rows])
                fits = ((labels[rows][None, :] == label[some][:, None]) == same) & (ids[rows][None, :] != own[some][:, None])
                fits &= (score >= low[some][:, None]) & (score <= high[some][:, None]) & (score >= top[some, -1][:, None])
                hit = fits.any(axis=1)
                some, fits = some[hit], fits[hit]
                all_s = np.concatenate([top[some], np.where(fits, score[hit], NONE)], axis=1)
                all_i = np.concatenate([who[some], np.where(fits, ids[rows][None, :], FAR)], axis=1)
                # -1 - score turns the order round and keeps the least 64-bit number in range.
                first = np.lexsort((all_i, -1 - all_s), axis=1)[:, :k]
                top[some], who[some] = np.take_along_axis(all_s, first, 1), np.take_along_axis(all_i, first, 1)
        return top, who


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _near_pivots(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (id, label, v) with the number of the nearest pivot among those of the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(len(batch), np.int32)
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for dim, table in pivots.items():
                at = np.flatnonzero(dims == dim)
                if len(at) and dim:
                    v = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                    near[at] = ((table * table).sum(axis=1)[None, :] - 2 * v @ table.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=["id", "label", "v", "pivot"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<double>, pivot int")


def deal_cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``cell``, (cell, dim)): rows of one pivot and length are a cell, or several of at most about ``CELL_ROWS``."""
    n = rows.count()
    size = max(512, min(CELL_ROWS, -(-n // LEAST_CELLS)))
    wanted = max(1, min(MAX_PIVOTS, -(-n // size)))
    found = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots: dict[int, list] = {}
    for r in found:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    near = _near_pivots(rows, {d: np.array(v) for d, v in pivots.items()}).withColumn("dim", F.size("v"))
    placed = cut(near, "cells")
    counts = placed.groupBy("dim", "pivot").agg(F.count("*").alias("_n"))
    parts = counts.select("dim", "pivot", F.ceil(F.col("_n") / size).alias("_parts"))
    cell = F.xxhash64("dim", "pivot", F.pmod(F.xxhash64("id", "v"), F.col("_parts")))
    dealt = placed.join(parts, ["dim", "pivot"]).select("id", "label", "v", "dim", cell.alias("cell"))
    cells = cut(dealt.select("cell", "dim").distinct(), "cell-list")
    return dealt, cells


def _meet(dealt: DataFrame, cells: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, ask, id, score): the ``k`` best rows of every cell for each of ``asked``: (anchor, own, label, v, asks: array of (ask, low, high))."""
    number = asked.count()
    slices = max(1, -(-number // CELL_ROWS))
    queries = asked.withColumn("dim", F.size("v")).join(cells, "dim").withColumn("slice", F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int"))
    rows = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def search(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"anchor": pa.array([], pa.int64()), "ask": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return empty
        points = _matrix(left["v"])
        ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
        asks = right["asks"].combine_chunks()
        many = np.diff(asks.offsets.to_numpy())
        ask, low, high = (asks.flatten().field(i).to_numpy() for i in range(3))
        at = np.repeat(np.arange(len(right)), many)
        tree = BallTree(points)
        anchor, own, label = (right[c].to_numpy()[at] for c in ("anchor", "own", "label"))
        queries = _matrix(right["v"])[at]
        top, who = tree.best(points, ids, labels, queries, own, label, same, low, high, k)
        row, place = np.nonzero(top != NONE)
        return pa.table({"anchor": anchor[row], "ask": ask[row], "id": who[row, place], "score": top[row, place]})

    left = rows.select("cell", "slice", "id", "label", "v").groupBy("cell", "slice")
    right = queries.select("cell", "slice", "anchor", "own", "label", "v", "asks").groupBy("cell", "slice")
    return left.cogroup(right).applyInArrow(search, "anchor long, ask int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives, the first negatives between ``low`` and ``high`` hundredths of the positive's score.

    ``anchors``: which rows are anchors, a condition on the key as ``id``.
    A score is the inner product of the vectors' components floor(scale x), in whole
    numbers. Positives are the anchor's best other rows of its label,
    negatives rows of other labels; higher scores come first, ties go to the
    smaller key. Rows with a null key or label, a null vector or a null or
    non-finite component take no part; empty vectors and vectors of different
    lengths have no score. Repeated keys are rows of their own, but none is
    another's positive or negative; each repeated anchor gives its own rows.
    An empty table gives an empty table; other columns play no part.
    """
    spark = vectors.sparkSession
    limit_batches(spark, 4096)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    usable = plain.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(finite)
    dealt, cells = deal_cells(_scaled(usable, scale))
    some = cut(dealt.where(anchors).select(F.col("id").alias("own"), "label", "v").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    every = F.array(F.struct(F.lit(0).alias("ask"), F.lit(NONE + 1).alias("low"), F.lit(FAR - 1).alias("high")))
    first = cut(_best(_meet(dealt, cells, some.withColumn("asks", every), True, positives), positives), "positives")
    # 100 n >= low p and 100 n <= high p, in whole numbers; scores of 58 bits and fewer leave room for the factors.
    p = F.col("score")
    window = F.struct(F.col("rank").cast("int").alias("ask"), _ceil_div(low * p, 100).alias("low"), _floor_div(high * p, 100).alias("high"))
    asks = first.select("anchor", window.alias("w")).where("w.low <= w.high").groupBy("anchor").agg(F.collect_list("w").alias("asks"))
    second = _best(_meet(dealt, cells, some.join(asks, "anchor"), False, negatives), negatives)
    named = some.select("anchor", F.col("own").alias("anchor_id"))
    positive = first.select("anchor", F.col("rank").cast("int").alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["anchor", "ask"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _ceil_div(a: Column, b: int) -> Column:
    return -_floor_div(-a, b)


def _scaled(rows: DataFrame, scale: int) -> DataFrame:
    """Components as whole numbers, kept as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            whole = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            offsets = v.offsets.to_numpy() - v.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole))], names=["id", "label", "v"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<double>")


ORACLE_OP13 = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id AND a.id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
