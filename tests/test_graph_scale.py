"""Hubs, searches from both ends, and cycles of many proposals, against brute force."""

from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from graphloom.operators import graph


def test_a_star_of_many_leaves_runs_in_bounded_parts(spark):
    n = 100_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("from_id"), F.col("id").alias("to_id"), F.lit(500).cast("long").alias("weight_milli"))
    dealt, heavy = graph.deal(graph.undirected(star).select("src", "dst").distinct())
    sizes = [r["count"] for r in dealt.groupBy("src", "part").count().where("count > 100").collect()]
    assert [(r.src, r.parts) for r in heavy.collect()] == [(0, 10)] and sum(sizes) == n and max(sizes) < 1.1 * graph.HEAVY
    seeds = spark.createDataFrame([(5,), (0,)], "id long")
    got = graph.k_hop(star, seeds, 2).groupBy("seed", "depth").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    total = n * (n + 1) // 2
    assert {(r.seed, r.depth): (r.n, r.s) for r in got} == {(5, 0): (1, 5), (5, 1): (1, 0), (5, 2): (n - 1, total - 5), (0, 0): (1, 0), (0, 1): (n, total)}
    near = graph.weighted_neighbors(star, spark.createDataFrame([(7,)], "id long"), 2)
    assert near.count() == n + 1 and near.where("depth = 2").agg(F.sum("id")).first()[0] == total


def by_force(arcs, a, b):
    """The least of the shortest paths."""
    near = {}
    for x, y in arcs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    far, todo = {b: 0}, deque([b])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    if a not in far:
        return None
    path = [a]
    while path[-1] != b:
        path.append(min(y for y in near[path[-1]] if far.get(y) == far[path[-1]] - 1))
    return path


def test_searches_from_both_ends_find_the_least_shortest_paths_with_less_work(spark):
    random.seed(3)
    arcs = [(i, (i + 1) % 400) for i in range(400)] + [(random.randrange(400), random.randrange(400)) for _ in range(500)] + [(900, 901)]
    edges = spark.createDataFrame(arcs, "from_id long, to_id long")
    asked = [(random.randrange(400), random.randrange(400)) for _ in range(8)] + [(5, 5), (1, 900), (900, 901), (7000, 1)]
    pairs = spark.createDataFrame(asked, "from_id long, to_id long")
    both, one = [], []
    for ends, work in ((True, both), (False, one)):
        got = {(r.from_id, r.to_id): (r.path, r.length) for r in graph.shortest_paths(edges, pairs, both_ends=ends, work=work).collect()}
        want = {(a, b): by_force(arcs, a, b) if a != b else [a] for a, b in asked}
        assert got == {k: (p, len(p) - 1 if p else None) for k, p in want.items()}
    assert sum(both) < sum(one) / 2, (both, one)
    short = {(r.from_id, r.to_id): r.length for r in graph.shortest_paths(edges, pairs, longest=2).collect()}
    assert all(n == (len(want[k]) - 1 if want[k] and len(want[k]) <= 3 else None) for k, n in short.items())


def test_cycles_of_many_proposals(spark):
    random.seed(6)
    arcs = [(i, random.randrange(i + 1, min(i + 9, 300))) for i in range(299) for _ in range(2)] + [(500, 501), (501, 500)]
    asked = [(random.randrange(300), random.randrange(300)) for _ in range(300)] + [(600, 601), (500, 500), (3, 3)]
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return b in seen

    got = graph.cycles(spark.createDataFrame(arcs, "id long, dep long"), spark.createDataFrame(asked, "id long, dep long"))
    assert {(r.id, r.dep): r.closes for r in got.collect()} == {(i, d): reaches(d, i) for i, d in asked}
    assert graph.cycles(spark.createDataFrame([], "id long, dep long"), spark.createDataFrame([(1, 2), (1, 1)], "id long, dep long").limit(2)).where("closes").count() == 1
