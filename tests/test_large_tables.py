"""What showed on larger tables only: queries on small made tables of the shapes that large ones have."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join
from graphloom.operators import code, fulltext, graph, memory, similarity
from graphloom.plans.queries import ORACLES, QUERIES
from graphloom.sources import brace_code, fixtures, schemas


def _tables(spark, path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _same(spark, name, path, *tables):
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        wanted = sorted(map(repr, db.execute(ORACLES[name]).fetchall()))
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, path).collect())
    assert got == wanted
    return got


def test_path_lengths_end_where_their_sql_ends(spark, tmp_path):
    """A chain of calls longer than 20: ends beyond are not reached, as in the SQL."""
    part = spark.range(30).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(1).alias("p_size"))
    ends = spark.range(29).select(F.col("id").alias("l_orderkey"), F.inline(F.array(*[F.struct(F.lit(i + 1).alias("l_linenumber"), (F.col("id") + i).alias("l_partkey")) for i in (0, 1)])))
    path = _tables(spark, tmp_path, part=part, lineitem=ends.withColumn("l_returnflag", F.lit("R")))
    got = _same(spark, "shortest_path_len", path, "part", "lineitem")
    assert sum("None" in r for r in got) == 9


def test_loosely_related_notes_meet_in_blocks(spark):
    """All pairs of groups over several blocks, of small groups that share a unit, and of null and short texts; no candidates are moved."""
    rng = random.Random(3)
    words = ["".join(rng.choices("bcdfg", k=4)) for _ in range(60)]
    rows = [(i, rng.choice(["big", "big", "s1", "s2", None]), None if i % 41 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(300)]
    notes = spark.createDataFrame(rows, "id long, topic string, content string")
    sets = {i: (g, set(t.split())) for i, g, t in rows if g and t and len(set(t.split())) >= 3}
    want = {(g, a, b, len(x & y), len(x | y)) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h and 10 * len(x & y) >= len(x | y)}
    named = notes.select("id", F.col("topic").alias("grp"), F.col("content").alias("text"))
    for block, shared in ((1500, 2500), (32_000_000, 1_000_000), (700, 100)):
        got = [tuple(r) for r in similarity.block_pairs(named, 1, 10, block=block, shared=shared).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    plan = similarity.jaccard_pairs(notes, 1, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan


def test_rows_of_impact_are_made_last(spark):
    """Depths are found on pairs of names; the rows come from one join and are not written or told apart again."""
    symbols = spark.createDataFrame([(i, f"f{i % 7}", "a.py") for i in range(1, 40)], "id long, symbol_name string, file_path string")
    pairs = sorted({(i, (i * i + k) % 7) for i in range(1, 40) for k in (1, 3)})
    edges = spark.createDataFrame([("calls", i, f"f{t}") for i, t in pairs], "edge_type string, from_symbol_id long, to_name string")
    one = {(f"f{t}", i) for i, t in pairs}
    want = {}
    frontier = {(n, n) for n, _ in one}
    for depth in (1, 2, 3):
        rows = {(n, i, f"f{i % 7}", via) for n, via in frontier for v, i in one if v == via}
        for r in rows:
            want.setdefault(r, depth)
        frontier = {(n, name) for n, _, name, _ in rows}
    out = code.impact(symbols, edges, edges.select("to_name").distinct(), 3)
    got = [((r["name"], r["id"], r["symbol_name"], r["via"]), r["depth"]) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_script_is_read_in_time_that_follows_its_length(spark):
    """No window looks at all that follows each row anew, and no definition meets its whole file."""
    one = "// über {0} 😀\nclass C{0} {{\n  make(a) {{ return f{0}(\"" + "ü" * 300 + "\"); }}\n}}\n"
    body = "".join(one.format(i) for i in range(300))
    files = spark.createDataFrame([("a.js", body, "javascript"), ("b.js", "const open = (x) => {", "javascript"), ("c.js", None, "javascript")], "path string, content string, language string")
    out = brace_code.extract_braces(files)
    got = {(r.path, r.name, r.type, r.start_line, r.end_line): (r.signature, r.content_hash) for r in out.where("what = 'symbol' AND name <> 'make'").collect()}
    short = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    want = {("a.js", f"C{i}", "class", 4 * i + 2, 4 * i + 4): (f"class C{i} {{", short(one.format(i).split("\n", 1)[1].rstrip("\n"))) for i in range(300)}
    assert got == want | {("b.js", "open", "arrow", 1, 1): ("const open = (x) => {", short("open"))}
    tokens = brace_code.around(brace_code.code_tokens(files.where("content IS NOT NULL")))
    plan = brace_code.definitions(tokens, brace_code.blocks_of(tokens, "(", ")", "p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_steps_of_graph_loops_do_not_pass_through_the_driver(spark, monkeypatch):
    plans, cut = [], graph.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", watched)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "from_id long, to_id long")
    vertices = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {r.id: r.component for r in graph.components(edges, vertices).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    loops = len(plans)
    pairs = vertices.select(F.lit(1).cast("long").alias("from_id"), F.col("id").alias("to_id"))
    assert {r.to_id: r.length for r in graph.shortest_paths(edges, pairs).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}
    # The list of heavy vertices alone may be broadcast.
    assert loops > 3 and not [p for p in plans[:loops] if "BroadcastHashJoin" in p] and not [p for p in plans[loops:] if "BroadcastHashJoin" in p and "parts" not in p]


def test_a_subgraph_is_not_told_apart_row_by_row(spark):
    """Parallel links, either way round, and loops: the greatest weight of each step, found before the seeds' rows are made."""
    links = spark.createDataFrame([(1, 2, 300), (2, 1, 700), (1, 2, 500), (2, 3, 400), (3, 3, 900), (3, 3, 950), (3, 4, 100)], "from_id long, to_id long, weight_milli long")
    out = graph.subgraph(links, spark.createDataFrame([(1,), (3,)], "id long"), 2, 200)
    want = {(1, 1, 2, 700), (1, 2, 1, 700), (1, 2, 3, 400), (3, 3, 3, 950), (3, 3, 2, 400), (3, 2, 3, 400), (3, 2, 1, 700)}
    got = [tuple(r) for r in out.select("seed", "source", "target", "weight_milli").collect()]
    assert set(got) == want and len(got) == len(want)
    steps = out.where("source <> target")._jdf.queryExecution().optimizedPlan().toString()
    assert "max(weight_milli" not in steps


def test_sets_that_move_are_packed(spark):
    """Frequent tokens move as numbers and others as words, and any division between the two gives the same pairs; the rows are much shorter than the tokens."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(400)]
    rows = [(i, rng.choice("xy"), " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(120)] + [(200, "x", None), (201, "x", "")]
    notes = spark.createDataFrame(rows, "id long, grp string, text string")
    sets = {i: (g, set(t.split())) for i, g, t in rows if t and len(set(t.split())) >= 3}
    want = {(g, a, b, len(x & y), len(x | y)) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h and 10 * len(x & y) >= len(x | y)}
    for coded in (1, 130, 1 << 16):
        for shared in (10, 1_000_000):
            got = [tuple(r) for r in similarity.block_pairs(notes, 1, 10, block=9_000, shared=shared, coded=coded).collect()]
            assert len(got) == len(set(got)) and set(got) == want and want
    tokens = notes.where("length(text) > 400").select("id", F.array_distinct(F.split("text", " ")).alias("tokens"))
    moved = similarity._packed(tokens, sorted(words), 3).collect()
    spelled = sum(len(" ".join(r["tokens"])) for r in tokens.collect())
    assert len(moved) > 20 and 6 * sum(len(r["codes"]) + len(r["words"]) for r in moved) < spelled


def test_links_are_found_once(spark):
    """What reads links to rank them, or to pick those of some notes, meets their source once and does not move them for a short list."""
    links = spark.range(50).select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.lit(5).alias("weight_milli"), F.lit(6).alias("confidence_milli"))
    plan = graph.rank_neighbors(links)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    ids = spark.createDataFrame([(3,), (3,), (4,), (90,)], "id long")
    out = memory.touching(links, ids, "from_id", "to_id")
    assert sorted(r["from_id"] for r in out.collect()) == [2, 3, 4]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("strategy=broadcast") == 2


def test_nodes_of_a_region_meet_once(spark):
    """Near copies that share many elements around a pivot, over several rings, meet in one region only; no pair that links is lost."""
    rng = random.Random(5)
    pivot = set(range(200))
    middles = [(pivot - set(rng.sample(range(200), 22 + f))) | set(rng.sample(range(300, 330), 12)) for f in range(6)]
    sets = {i: middles[i % 6] ^ set(rng.sample(range(330), rng.randint(1, 14))) for i in range(1, 40)}
    t = jaccard_join.Threshold(9, 10)
    rows = [(0, i, len(x ^ pivot), len(x), len(pivot), t.linked(len(x & pivot), len(x), len(pivot)), sorted(x ^ pivot)) for i, x in sets.items()]
    divided = spark.createDataFrame(rows, "pivot long, node long, d long, n long, p long, linked boolean, elements array<long>")
    spread = jaccard_join.ringed(divided, t).withColumns({"component": F.col("node"), "size": F.lit(len(sets)), "outside": F.lit(True)})
    got = [tuple(r) for r in jaccard_join.meetings(spread, t).collect()]
    linked = {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and 10 * len(x & y) >= 9 * len(x | y)}
    # Pairs in the ball of the pivot are one component by way of it.
    ball = {r[1] for r in rows if r[5]}
    assert {p for p in linked if not set(p) <= ball} <= set(got) and len([p for p in linked if not set(p) <= ball]) > 20
    assert len(got) <= 1.2 * len(set(got))


def test_texts_are_not_moved_to_meet_labels(spark, tmp_path):
    """Links read documents without a join with their labels; documents with several labels still stand there as often as in ``doc_notes``."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 2}", 6) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    once = _tables(spark, tmp_path / "once", documents=docs, labels=spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int"))
    twice = _tables(spark, tmp_path / "twice", documents=docs, labels=spark.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 0, 0), (3, 1, 1), (9, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int"))
    for path, n in ((once, 6), (twice, 8)):
        got = sorted(tuple(r) for r in fixtures.doc_texts(spark, path).collect())
        assert len(got) == n and got == sorted(tuple(r) for r in fixtures.doc_notes(spark, path).select("id", "topic", "content").collect())
    for name in ("jaccard_auto_link", "link_decay"):
        plan = QUERIES[name](spark, once)._jdf.queryExecution().optimizedPlan().toString()
        assert "toxic" not in plan


def test_a_unit_of_sets_is_held_in_few_bytes(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, "g", rng.sample(words, 100)) for i in range(2500)]
    moved = similarity._packed(spark.createDataFrame(rows, "id long, grp string, tokens array<string>"), words[:1500], 3).toArrow()
    moved = moved.append_column("side", pa.array([0] * len(rows), pa.int32()))
    tracemalloc.start()
    try:
        assert not list(similarity._unit_pairs(moved.to_batches(), 1, 1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45 * sum(len(r[2]) for r in rows)


def test_an_index_is_written_without_moving_texts_or_postings(spark, tmp_path):
    """Postings are made beside their rows: only rows of keys that stand there twice are moved."""
    docs = spark.createDataFrame([(i, "a b a" if i % 2 else "Über a", ["b c", "a"]) for i in range(20)], "id long, x string, y array<string>")
    plan = fulltext.post(fulltext.one_text(docs, "id"), "id", ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    got = {(r.term, r.col, tuple(r.positions), r.length) for r in fulltext.post(docs, "id", ["x", "y"]).collect()}
    assert got == {("a", "x", (0, 2), 6), ("b", "x", (1,), 6), ("uber", "x", (0,), 5), ("a", "x", (1,), 5), *((t, "y", (i,), n) for n in (5, 6) for i, t in enumerate("bca"))}
    twice = docs.unionByName(docs.where("id = 3").withColumn("x", F.lit("z")))
    one = fulltext.one_text(twice, "id")
    assert one.count() == 20 and [r.x for r in one.where("id = 3").collect()] == ["z"]


def test_new_tasks_do_not_move_the_tasks_that_are_there(spark):
    tasks = schemas.migrate("tasks", spark.createDataFrame([(i, f"t{i % 3}") for i in range(1, 9)], "id long, topic string"))
    batch = spark.createDataFrame([("New Work", "a", "high", [2, 1, 2, 99], [], [], 1), ("New Work", "b", "odd", None, [], [], 2)], "topic string, title string, priority string, depends_on array<long>, files array<string>, notes array<long>, ord int")
    now = F.lit("2030-01-01").cast("timestamp")
    new = memory.new_tasks(tasks, batch, now)
    assert [(r.id, r.topic, r.priority, r.depends_on) for r in new.orderBy("id").collect()] == [(9, "new-work", "high", [1, 2]), (10, "new-work", "medium", [])]
    assert memory.create_tasks(tasks, batch, now).count() == 10
    joins = [x for x in new._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftSemi" in x]
    assert any("strategy=broadcast" in x for x in joins)


def test_edges_of_statistics_are_made_once(spark):
    """Counts, components and clustering read a written list of edges, so a join that makes edges runs once."""
    x = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (1, 3, "R"), (5, 6, "A")], "from_id long, to_id long, edge_type string")
    edges = x.join(spark.range(1, 9).withColumnRenamed("id", "from_id"), "from_id")
    out = graph.graph_stats(edges, spark.range(1, 7).toDF("id"), ["A", "N", "R"])
    assert "Range (1, 9" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.metric: r.value for r in out.collect()} == {"nodes": 6, "edges": 4, "clusters": 3, "edges:A": 3, "edges:N": 0, "edges:R": 1, "clustering_milli": 500}


def test_a_step_is_dealt_by_the_rows_it_makes(spark):
    """More rows to a step make more tasks, not larger ones."""
    steps, heavy = graph.deal(spark.range(60).select((F.col("id") % 20).alias("src"), F.col("id").alias("dst")))
    frontier = spark.range(400).select(F.col("id").alias("name"), (F.col("id") % 20).alias("src"))
    wide = graph.follow(frontier, steps, heavy, 20)
    assert wide.count() == 1200 and "hashpartitioning(src" in wide._jdf.queryExecution().executedPlan().toString()
    assert wide.rdd.getNumPartitions() == 60


def test_chains_of_tasks_are_not_walked_step_by_step(spark, tmp_path, monkeypatch):
    """Steps follow the logarithm of the longest chain: 6 of 100 tasks and 200 tasks of single customers, equal to SQL."""
    steps = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(1) or cut(df))
    customer = F.when(F.col("id") < 600, F.col("id") % 6).otherwise(F.col("id"))
    orders = spark.range(800).select(F.col("id").alias("o_orderkey"), customer.alias("o_custkey"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 31).cast("int")).alias("o_orderdate"), F.lit("F").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    got = _same(spark, "task_cycle_check", _tables(spark, tmp_path, orders=orders), "orders")
    assert len(got) == 594 and all("True" in r for r in got)
    assert len(steps) <= 16, len(steps)


def test_cycles_on_chains_rings_and_branches(spark):
    """Proposals within chains both ways, on rings, between chains that meet, at loops, of unknown tasks and of nulls."""
    rng = random.Random(11)
    arcs = [(i, i + 1) for i in range(20)] + [(30 + i, 30 + (i + 1) % 7) for i in range(7)] + [(40, 40), (41, 42), (42, 41)]
    # A chain that leads into another's middle, a chain back to its own first, a diamond, a ring with a tail.
    arcs += [(50, 51), (51, 52), (52, 10), (60, 61), (61, 62), (62, 60), (62, 63), (63, 64), (70, 71), (70, 72), (71, 73), (72, 73), (73, 74), (80, 81), (81, 82), (82, 80), (83, 80)]
    arcs += [(rng.randrange(90, 120), rng.randrange(90, 120)) for _ in range(25)]
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, todo = {a}, [a]
        while todo:
            fresh = near.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        return b in seen

    ends = sorted({x for arc in arcs for x in arc}) + [500]
    asked = [(a, b) for a in ends for b in ends]
    proposed = spark.createDataFrame(asked + [(None, 3), (3, None), (3, 3)], "id long, dep long")
    got = graph.cycles(spark.createDataFrame(arcs + arcs[:9] + [(3, None), (None, 3)], "id long, dep long"), proposed).collect()
    want = {(a, b): reaches(b, a) for a, b in asked} | {(None, 3): False, (3, None): False}
    assert len(got) == len(want) and {(r.id, r.dep): r.closes for r in got} == want


def test_equal_nodes_meet_once(spark, monkeypatch):
    """Sets of keywords and words meet, not the nodes that hold them; ties, a node's own copies and empty texts come out as by brute force."""
    rng = random.Random(12)
    met, pairs = [], similarity.set_pairs
    monkeypatch.setattr(similarity, "set_pairs", lambda table, *a: met.append(table.count()) or pairs(table, *a))
    names = [rng.sample("abcdefgh", rng.randint(1, 4)) for _ in range(14)]
    rows = [(str(i), rng.choice(["", "x", "x y", "p q r s"]), rng.choice(["", "x z", "t u v w"]), rng.choice(names)) for i in range(160)]
    rows += [("900", "lone", "", ["A", "b", None]), ("901", "lone", "one", ["b", "a"]), ("902", "x", "y", []), ("903", "x", "y", None), ("904", "x", "y", [None])]
    sets = [(i, {w.lower() if w else None for w in kw}, set(f"{t} {c}".split())) for i, t, c, kw in rows if kw]
    nodes = spark.createDataFrame(rows, "id string, title string, content string, keywords array<string>")
    for k, threshold in ((3, 0.3), (1, 0.6), (7, 0.9)):
        want = set()
        for i, kw, tx in sets:
            near = []
            for j, kw2, tx2 in sets:
                if i != j and (kw & kw2) - {None}:
                    ku, tu = len(kw | kw2), max(1, len(tx | tx2))
                    near.append((-((1600 * len(kw & kw2) * tu + 400 * len(tx & tx2) * ku + ku * tu) // (2 * ku * tu)), j))
            want |= {(i, j, -s, r) for r, (s, j) in enumerate(sorted(x for x in near if -x[0] >= 1000 * threshold)[:k], 1)}
        got = [tuple(r) for r in similarity.hybrid_links(nodes, threshold, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert max(met) <= len(names) + 3


def test_a_script_is_cut_into_parts_of_whole_tokens(spark):
    """Tokens, their places and neighbours are those of the whole text, wherever parts end: in strings, comments and expressions over several lines, and among slashes."""
    rng = random.Random(13)
    bits = ["/", "*", "//", "/*", "*/", '"', "'", "`", "\n", " ", "\\", "=", "(", ")", "{", "}", "a", "b1", 'r#"', '"#', "=>", "/x/g", ";", "ü", "😀", "9.x", "::", " /re[/]x/ "]
    files = spark.createDataFrame([(f"f{i}", "".join(rng.choices(bits, k=rng.randint(0, 300))), rng.choice(["javascript", "rust"])) for i in range(60)], "path string, content string, language string")
    whole = sorted(map(repr, brace_code.code_tokens(files).collect()))
    assert len(whole) > 2000
    for part in (4, 9):
        assert sorted(map(repr, brace_code.code_tokens(files, part).collect())) == whole
    texts = {(r.path, i, x) for r in files.collect() for i, x in enumerate(r.content.split("\n"), 1)}
    for size in (1, 3):
        got = [tuple(r) for r in brace_code.lines_of(files, size).collect()]
        assert len(got) == len(set(got)) and {r for r in got if r[2]} == {r for r in texts if r[2]}


def test_no_task_explodes_a_whole_script(spark):
    """Arrays of tokens are those of parts, and nothing that grows with a file is broadcast."""
    one = "// c\nclass C{0} {{\n  make(a) {{ return f{0}(a); }}\n}}\n"
    files = spark.createDataFrame([("a.js", "".join(one.format(i) for i in range(400)), "javascript")], "path string, content string, language string")
    plan = brace_code.code_tokens(files, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" not in plan and "BroadcastHint" not in plan
    out = brace_code.extract_braces(files)
    assert out.where("what = 'symbol'").count() == 800 and out.where("what = 'calls'").count() == 400
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_weighted_steps_are_not_written_again(spark, monkeypatch):
    """The last step of a traversal reads the links' own table both ways; with heavy vertices it gives the same rows."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(set(df.columns)) or cut(df))
    rng = random.Random(14)
    rows = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(70)})
    links = spark.createDataFrame([(a, b, 100 + 7 * i) for i, (a, b) in enumerate(rows)], "from_id long, to_id long, weight_milli long")
    seeds = links.select(F.col("from_id").alias("id")).distinct()
    got = sorted(map(tuple, graph.weighted_neighbors(links, seeds, 2, 150, keep=False).collect()))
    assert len(got) > 200 and not [c for c in written if {"part", "weight_milli"} <= c]
    assert got == sorted(map(tuple, graph.weighted_neighbors(links, seeds, 2, 150, heavy_at=2, keep=False).collect()))
