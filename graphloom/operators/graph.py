"""Graph operators over edge tables (src, dst, ...): neighbours, traversal, paths, components, statistics.

Traversals are loops over frontiers: each step is a join of the frontier with
the edges and an anti-join with what was seen. Every step is cut to the
shared folder, so lineage stays short and a lost executor repeats one step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids that are sent to all tasks at most.
FEW = 500_000

_local: list[str] = []
_scopes: list[list[str]] = []


def shared_steps(spark) -> str:
    """The folder for steps below ``spark.checkpoint.dir``; only a session on one machine may go without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="graphloom-steps-"))
        root = _local[0]
    return f"{root.rstrip('/')}/steps"


def cut(df: DataFrame) -> DataFrame:
    """Writes a step to the folder that the cluster shares (``spark.checkpoint.dir``) and reads it again."""
    spark = df.sparkSession
    path = f"{shared_steps(spark)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps_removed(spark) -> Iterator[None]:
    """Removes the steps that were cut within it, for work whose results are stored when it ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join in a loop, both sides of which are shuffled: what each step broadcasts passes through the driver, and steps add up."""
    return df.hint("merge")


def numbered(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of a unique ``key``, without one task seeing all rows.

    Rows are dealt out by ranges of the key and sorted within them; each
    range begins after the sizes of those before, one number a partition.
    """
    placed = cut(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (F.col("_start") + place + 1).cast("long").alias(name))


def undirected(edges: DataFrame, a: str = "from_id", b: str = "to_id", *carry: str) -> DataFrame:
    there = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *carry)
    return there.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *carry))


def neighbors(edges: DataFrame, of: DataFrame | None = None, edge_type: str | None = None) -> DataFrame:
    """(id, neighbor), distinct, in either direction; ``of``: (id) to restrict to."""
    kept = edges.where(F.col("edge_type") == edge_type) if edge_type else edges
    both = undirected(kept).select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).distinct()
    return both.join(of, "id", "left_semi") if of is not None else both


#: Arcs of a vertex that one part of a join holds; vertices with more are heavy.
HEAVY = 10_000


def deal(steps: DataFrame, heavy_at: int = HEAVY, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(steps with ``part``, (src, parts)): the arcs of heavy vertices are dealt out over parts of about ``heavy_at``; the list holds heavy ones only. Without ``keep`` the steps are not written, as they are read once from a table that is."""
    many = steps.groupBy("src").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_at)
    heavy = cut(many.select("src", F.ceil(F.col("_n") / heavy_at).cast("int").alias("parts")))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("parts"))).cast("int")
    if not keep and heavy.limit(1).count() == 0:
        return steps.withColumn("part", F.lit(0)), heavy
    dealt = steps.join(heavy, "src", "left").withColumn("part", part).drop("parts")
    return cut(dealt) if keep else dealt, heavy


def follow(frontier: DataFrame, steps: DataFrame, heavy: DataFrame, rows: int | None = None) -> DataFrame:
    """``frontier`` (src, ...) joined with the dealt steps: a heavy vertex meets each part of its arcs in another task. With ``rows``, many rows are made by so many tasks that one makes about as many, or fewer."""
    spread = frontier.join(heavy, "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    if rows:
        ours, theirs = (df.groupBy("src").agg(F.count("*").alias(n)) for df, n in ((frontier, "_a"), (steps, "_b")))
        total = ours.join(apart(theirs), "src").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
        if (tasks := -(-total // rows)) > steps.sparkSession.sparkContext.defaultParallelism:
            spread, steps = spread.repartition(tasks, "src", "part"), steps.repartition(tasks, "src", "part")
    return spread.join(apart(steps), ["src", "part"]).drop("part")


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, both_ways: bool = True, known: DataFrame | None = None, heavy_at: int = HEAVY) -> DataFrame:
    """(seed, id, depth): least depth of everything within ``depth`` steps, seeds included at 0.

    ``known``: (id); other ends are neither returned nor passed through.
    """
    steps = (undirected(edges) if both_ways else edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))).select("src", "dst").distinct()
    if known is not None:
        steps = steps.join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    seen = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)))
    if depth < 1:
        return seen
    dealt, heavy = deal(steps, heavy_at)
    frontier = seen
    for d in range(1, depth + 1):
        reached = follow(frontier.select("seed", F.col("id").alias("src")), dealt, heavy).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def weighted_neighbors(links: DataFrame, seeds: DataFrame, depth: int = 1, min_weight: int = 0, heavy_at: int = HEAVY, keep: bool = True) -> DataFrame:
    """(seed, via, id, weight_milli, depth): a row for each link of at least ``min_weight`` from a node nearer than ``depth``; weight 0 and null are left out."""
    useful = links.where((F.coalesce("weight_milli", F.lit(0)) > 0) & (F.col("weight_milli") >= min_weight))
    near = k_hop(useful.select("from_id", "to_id"), seeds, depth - 1, heavy_at=heavy_at)
    steps, heavy = deal(undirected(useful, "from_id", "to_id", "weight_milli"), heavy_at, keep)
    return follow(near.withColumnRenamed("id", "src"), steps, heavy).select("seed", F.col("src").alias("via"), F.col("dst").alias("id"), "weight_milli", (F.col("depth") + 1).alias("depth"))


def subgraph(links: DataFrame, seeds: DataFrame, depth: int = 2, min_weight: int = 200) -> DataFrame:
    """(seed, source, target, weight_milli): distinct directed steps of the neighbourhood, with the greatest weight of parallel links."""
    # The greatest weight is taken of the steps, once each, and not of all seeds' rows.
    swap = F.col("from_id") > F.col("to_id")
    low, high = F.when(swap, F.col("to_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(swap, F.col("from_id")).otherwise(F.col("to_id")).alias("to_id")
    useful = links.where((F.coalesce("weight_milli", F.lit(0)) > 0) & (F.col("weight_milli") >= min_weight))
    best = cut(useful.groupBy(low, high).agg(F.max("weight_milli").alias("weight_milli")))
    rows = weighted_neighbors(best, seeds, depth, min_weight, keep=False)
    return rows.where("via <> id").unionByName(rows.where("via = id").dropDuplicates(["seed", "via"])).select("seed", F.col("via").alias("source"), F.col("id").alias("target"), "weight_milli")


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int | None = None, both_ends: bool = True, work: list[int] | None = None) -> DataFrame:
    """(from_id, to_id, length, path): fewest steps between the ends of each pair, in either direction; of equal ones the least array. Unreached pairs have nulls, as have those further apart than ``longest``, if it is given.

    Searches from both ends, each time from the side whose frontier is
    smaller, until the frontiers of a pair meet: every shortest path then has
    a vertex in both, and the least of them is the least beginning with the
    least rest. ``both_ends=False`` searches from the first ends alone.
    ``work`` gets the number of rows that each step has met.
    """
    dealt, heavy = deal(undirected(edges).select("src", "dst").distinct())
    ends = cut(pairs.select("from_id", "to_id").distinct())
    open_ = ends

    def start(end: str) -> DataFrame:
        return cut(ends.select(F.col(end).alias("end")).distinct().select("end", F.col("end").alias("id"), F.array("end").alias("path")))

    seen = {"from_id": start("from_id"), "to_id": start("to_id")}
    frontier, steps, found = dict(seen), 0, None
    few_starts = seen["from_id"].count() <= seen["to_id"].count()
    while True:
        ours, theirs = (frontier[e].select(F.col("end").alias(e), "id", F.col("path").alias(f"_{e}")) for e in ("from_id", "to_id"))
        # The pairs come in at the side that has more ends, so a row has few of them.
        met = theirs.join(apart(open_), "to_id").join(apart(ours), ["from_id", "id"]) if few_starts else ours.join(apart(open_), "from_id").join(apart(theirs), ["to_id", "id"])
        whole = F.concat("_from_id", F.slice("_to_id", F.lit(2), F.size("_to_id")))
        done = cut(met.select("from_id", "to_id", whole.alias("path")).groupBy("from_id", "to_id").agg(F.min("path").alias("path")))
        found = done if found is None else found.unionByName(done)
        rest = open_.join(apart(done), ["from_id", "to_id"], "left_anti")
        for e in ("from_id", "to_id"):
            rest = rest.join(apart(frontier[e].select(F.col("end").alias(e))), e, "left_semi")
        open_ = cut(rest.select("from_id", "to_id"))
        if open_.limit(1).count() == 0 or (longest is not None and steps >= longest):
            break
        alive = {e: frontier[e].join(apart(open_.select(F.col(e).alias("end"))), "end", "left_semi") for e in frontier}
        side = "from_id" if not both_ends or alive["from_id"].count() <= alive["to_id"].count() else "to_id"
        grown = follow(alive[side].withColumnRenamed("id", "src"), dealt, heavy)
        if work is not None:
            work.append(grown.count())
        longer = F.array_append("path", F.col("dst")) if side == "from_id" else F.array_prepend("path", F.col("dst"))
        fresh = grown.select("end", F.col("dst").alias("id"), longer.alias("path")).join(apart(seen[side].select("end", "id")), ["end", "id"], "left_anti")
        frontier[side] = cut(fresh.groupBy("end", "id").agg(F.min("path").alias("path")))
        seen[side] = seen[side].unionByName(frontier[side])
        steps += 1
    out = ends.join(apart(found), ["from_id", "to_id"], "left")
    return out.select("from_id", "to_id", F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("length"), "path")


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the least id that undirected edges reach, for every vertex; hooking on smaller labels and jumping."""
    steps = cut(undirected(edges).select("src", "dst").where("src <> dst").distinct())
    labels = cut(vertices.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = steps.join(apart(labels.select(F.col("id").alias("dst"), "component")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("theirs"))
        hooked = labels.join(apart(near), "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("theirs", "component")).alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("above"))
        stepped = cut(hooked.join(apart(up), "new", "left").select("id", "was", F.least("new", F.coalesce("above", "new")).alias("component")))
        if stepped.where("was <> component").limit(1).count() == 0:
            return stepped.select("id", "component")
        labels = stepped.select("id", "component")


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, triangles, and the sum of local clustering coefficients over all vertices (mean_milli: in thousandths a vertex).

    Undirected, without loops and parallel edges. Edges point from the end of
    lower degree, so no vertex has more than sqrt(2 E) of them to pair.
    """
    e = cut(edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct())
    degree = cut(undirected(e, "a", "b").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")))
    da = e.join(degree.select(F.col("id").alias("a"), F.col("deg").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("deg").alias("db")), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    arcs = cut(da.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = arcs.join(arcs.withColumnRenamed("y", "z"), "x").where("y < z")
    triangles = wedge.join(e, (F.col("y") == F.col("a")) & (F.col("z") == F.col("b"))).select("x", "y", "z")
    corners = triangles.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    local = degree.where("deg >= 2").join(corners, "id", "left").select((F.coalesce("t", F.lit(0)) * 2 / (F.col("deg") * (F.col("deg") - 1))).alias("c"))
    zero = F.lit(0).cast("long")
    rows = vertices.select(F.lit(1).cast("long").alias("v"), zero.alias("t"), F.lit(0.0).alias("c"))
    rows = rows.unionByName(triangles.select(zero.alias("v"), F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("c"))).unionByName(local.select(zero.alias("v"), zero.alias("t"), "c"))
    out = rows.agg(F.sum("v").alias("vertices"), F.sum("t").alias("triangles"), F.sum("c").alias("c"))
    return out.select("vertices", "triangles", F.round(1000 * F.col("c") / F.col("vertices"), 6).alias("mean_milli"))


def graph_stats(edges: DataFrame, vertices: DataFrame, types: list[str]) -> DataFrame:
    """(metric, value): counts of nodes, edges, components and edges of each type, zeros included, and the mean clustering coefficient in thousandths, rounded."""
    spark = edges.sparkSession
    # Edges may come from joins, and each of the counts reads them.
    edges = cut(edges.select("from_id", "to_id", "edge_type"))
    named = spark.createDataFrame([(t,) for t in types], "edge_type string")
    by_type = named.join(edges.groupBy("edge_type").count(), "edge_type", "left").select(F.concat(F.lit("edges:"), "edge_type").alias("metric"), F.coalesce("count", F.lit(0)).alias("value"))
    n = vertices.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), "value")
    m = edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("metric"), "value")
    c = components(edges, vertices).agg(F.countDistinct("component").alias("value")).select(F.lit("clusters").alias("metric"), "value")
    mean = clustering(edges, vertices).select(F.lit("clustering_milli").alias("metric"), F.coalesce(F.round("mean_milli"), F.lit(0.0)).cast("long").alias("value"))
    return n.unionByName(m).unionByName(c).unionByName(by_type).unionByName(mean)


def rank_neighbors(links: DataFrame, by: str = "weight_milli") -> DataFrame:
    """(id, neighbor, weight_milli, confidence_milli, rank) by weight, or confidence; null counts as 0, ties go to the smaller neighbour."""
    # Both ways in one pass, so that links that are still to be found are found once.
    ends = F.inline(F.array(F.struct(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), F.struct(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))))
    both = links.select(ends, "weight_milli", "confidence_milli")
    order = Window.partitionBy("src").orderBy(F.desc(F.coalesce(by, F.lit(0))), "dst")
    return both.withColumn("rank", F.row_number().over(order)).select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "weight_milli", "confidence_milli", "rank")


def cyclic_core(arcs: DataFrame, rounds: int = 4) -> DataFrame:
    """``arcs`` (src, dst) without those at ends that no cycle holds, peeled ``rounds`` times: vertices that nothing leads to or that lead nowhere."""
    for _ in range(rounds):
        out, in_ = arcs.select(F.col("src").alias("dst")).distinct(), arcs.select(F.col("dst").alias("src")).distinct()
        peeled = cut(arcs.join(out, "dst", "left_semi").join(in_, "src", "left_semi").select("src", "dst"))
        if peeled.count() == arcs.count():
            break
        arcs = peeled
    return arcs


def chains(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, between) of ``arcs`` (src, dst), which may hold an arc twice but no nulls.

    An arc of a chain is the only one out of its source and the only one into
    its target, so all other arcs (``between``) lead from the last vertex of a
    chain to the first of one. ``places``: (id, chain, rest), with the last
    vertex of the chain as its name and the steps to it, for all but last
    vertices; on a ring that no other arc meets the name is the least vertex,
    and ``rest`` is 0. A pointer goes twice as far with each step, so steps
    follow the logarithm of the longest chain.
    """
    outs = arcs.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("_last")).where("dst = _last").drop("_last")
    ins = arcs.groupBy("dst").agg(F.min("src").alias("src"), F.max("src").alias("_last")).where("src = _last")
    # A source with one target is the source of that target alone, if it is that of any.
    links = cut(outs.join(apart(ins.select("src").distinct()), "src", "left_semi"))
    between = cut(arcs.join(apart(links), ["src", "dst"], "left_anti"))
    going, arrived = links.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("end")), []
    while True:
        ahead = going
        for df in arrived:
            ahead = ahead.unionByName(df)
        ahead = ahead.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("end").alias("_end"))
        there = going.select("id", "to", "steps").join(apart(ahead), "to", "left")
        jumped = cut(there.select("id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_end", F.lit(True)).alias("end")))
        ended, going = jumped.where("end"), jumped.where("NOT end")
        rows = {r["end"]: r["count"] for r in jumped.groupBy("end").count().collect()}
        # Every chain that goes on has a vertex that ends with this step; what goes on without any is rings.
        if True in rows:
            arrived.append(ended)
        if len(rows) < 2:
            break
    rings = going.select("id")
    if False in rows:
        circles = links.join(apart(rings.withColumnRenamed("id", "src")), "src", "left_semi").select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
        places = components(circles, rings).select("id", F.col("component").alias("chain"), F.lit(0).cast("long").alias("rest"))
    else:
        places = rings.select("id", F.col("id").alias("chain"), F.lit(0).cast("long").alias("rest"))
    for df in arrived:
        places = places.unionByName(df.select("id", F.col("to").alias("chain"), F.col("steps").alias("rest")))
    return places, between


def reached(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, dst), distinct, whose ``src`` is reached from ``dst`` by one arc or more, so that the pair closes a cycle.

    A cycle of a pair lies in what is left once ends that no cycle holds are
    peeled off both lists together; there one closure answers all pairs.
    """
    core = cut(cyclic_core(cut(arcs.unionByName(pairs).distinct())))
    steps, heavy = deal(arcs.distinct().join(core, ["src", "dst"], "left_semi").select("src", "dst"))
    able = cut(pairs.join(core, ["src", "dst"], "left_semi").select("src", "dst"))
    frontier, seen = able.select(F.col("dst").alias("start"), F.col("dst").alias("at")).distinct(), None
    while True:
        grown = follow(frontier.withColumnRenamed("at", "src"), steps, heavy).select("start", F.col("dst").alias("at")).distinct()
        frontier = cut(grown if seen is None else grown.join(seen, ["start", "at"], "left_anti"))
        seen = frontier if seen is None else seen.unionByName(frontier)
        if frontier.limit(1).count() == 0:
            return able.join(seen.select(F.col("at").alias("src"), F.col("start").alias("dst")), ["src", "dst"], "left_semi").select("src", "dst")


def cycles(dependencies: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, dep, closes): whether giving ``id`` the dependency ``dep`` closes a cycle.

    ``dependencies``: (id, dep). Only existing dependencies are walked. Places
    on chains answer proposals within a chain; the others are answered by
    walks from chain to chain.
    """
    arcs = cut(dependencies.select(F.col("id").alias("src"), F.col("dep").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))
    places, between = chains(arcs)
    placed = proposed.select("id", "dep").distinct()
    for end in ("id", "dep"):
        at = places.select(F.col("id").alias(end), F.col("chain").alias("_chain"), F.col("rest").alias("_rest"))
        placed = placed.join(apart(at), end, "left").withColumns({f"{end}_chain": F.coalesce("_chain", end), f"{end}_rest": F.coalesce("_rest", F.lit(0))}).drop("_chain", "_rest")
    closes = F.coalesce((F.col("id_chain") == F.col("dep_chain")) & (F.col("dep_rest") >= F.col("id_rest")), F.lit(False))
    far = (F.when(~closes, F.col(f"{end}_chain")).alias(f"{end}_chain") for end in ("id", "dep"))
    asked = cut(placed.select("id", "dep", *far, closes.alias("closes")))
    rest = asked.where("NOT closes")
    if rest.limit(1).count() == 0 or between.limit(1).count() == 0:
        return asked.select("id", "dep", "closes")
    first = places.select(F.col("id").alias("dst"), "chain")
    steps = cut(between.join(apart(first), "dst", "left").select("src", F.coalesce("chain", "dst").alias("dst")))
    hit = reached(steps, cut(rest.select(F.col("id_chain").alias("src"), F.col("dep_chain").alias("dst")).distinct()))
    hit = hit.select(F.col("src").alias("id_chain"), F.col("dst").alias("dep_chain"), F.lit(True).alias("_hit"))
    walked = rest.join(apart(hit), ["id_chain", "dep_chain"], "left").select("id", "dep", F.coalesce("_hit", F.lit(False)).alias("closes"))
    return asked.where("closes").select("id", "dep", "closes").unionByName(walked)
