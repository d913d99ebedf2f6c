"""Notes, tasks, links and their life, on small tables with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import graph, memory, similarity
from graphloom.sources.schemas import TABLES, empty, migrate
from graphloom.sources.store import TableStore, export_json, import_json


def now():
    return F.lit("2024-05-01").cast("timestamp")


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, "first note about graphs"), (2, "second note about edges"), (3, "use weighted graphs"), (4, "better pruning")]
    return spark.createDataFrame([(i, "t", "fact", c) for i, c in rows], "id long, topic string, kind string, content string")


def test_scalars(spark):
    rows = [("Base Integration!", "base-integration"), ("base_integration", "base-integration"), ("---", "general"), ("", "general"), (None, "general"), (" A  b ", "a-b")]
    got = spark.createDataFrame(rows, "t string, want string").select(fn.slug(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    one = spark.createDataFrame([("note-12", "7", "x-1", "  ", "High", "a/b/c/d/e", "src/x.py")], "a string, b string, c string, k string, p string, l string, m string")
    r = one.select(fn.note_id(F.col("a")), fn.note_id(F.col("b")), fn.note_id(F.col("c")), fn.note_kind(F.col("k")), fn.new_priority(F.col("p")), fn.short_location(F.col("l")), fn.module_of(F.col("m"))).first()
    assert tuple(r) == (12, 7, None, "fact", "medium", "c/d/e", "src.x")
    trimmed = spark.createDataFrame([("a  b\n" * 300,)], "t string").select(fn.trim_text(F.col("t"), 20).alias("x")).first().x
    assert trimmed == "a b a b a b a b a..." and len(trimmed) <= 20


def test_boundary_links(notes):
    got = {(r.from_note_id, r.to_note_id): (r.inter, r.uni, r.weight_milli, r.confidence_milli) for r in similarity.auto_links(notes, 1, 5).collect()}
    assert got == {(1, 2): (1, 5, 200, 300), (1, 3): (1, 5, 200, 300)}
    known = notes.sparkSession.createDataFrame([(1, 2)], "from_note_id long, to_note_id long")
    assert similarity.auto_links(notes, 1, 5, known).count() == 1


def test_link_life(spark):
    links = spark.createDataFrame([(1, 2, 800, "related", "explicit"), (1, 3, 200, "auto", "auto"), (2, 3, 40, "auto", "auto"), (3, 4, 980, "auto", "auto")], "from_note_id long, to_note_id long, weight_milli long, link_type string, source string")
    assert [r.weight_milli for r in similarity.decay(links, 500).orderBy("from_note_id", "to_note_id").collect()] == [800, 100, 20, 490]
    assert similarity.prune(links, 50).count() == 3
    only = spark.createDataFrame([(4,)], "id long")
    assert [r.weight_milli for r in similarity.decay(links, 500, only).orderBy("from_note_id", "to_note_id").collect()] == [800, 200, 40, 490]
    hits = spark.createDataFrame([(3, 4), (3, 4), (1, 2), (1, 3)], "from_note_id long, to_note_id long")
    assert [r.weight_milli for r in similarity.reinforce(links, hits).orderBy("from_note_id", "to_note_id").collect()] == [800, 250, 40, 1000]


def test_recompute(notes, spark):
    links = spark.createDataFrame([(1, 2, 600), (2, 3, 500), (3, 4, 300)], "from_note_id long, to_note_id long, weight_milli long")
    got = {(r.from_note_id, r.to_note_id): (r.weight_milli, r.action) for r in similarity.recompute_links(notes, links).collect()}
    assert got == {(1, 2): (400, "updated"), (2, 3): (500, "deleted"), (3, 4): (300, "kept"), (1, 3): (200, "created")}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from("apple berry cherry damson elder fig grape hazel".split()), max_size=7), min_size=2, max_size=9))
def test_pairs_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, "t", " ".join(t)) for i, t in enumerate(texts)], "id long, topic string, content string")
    got = {(r.a, r.b, r.inter, r.uni) for r in similarity.jaccard_pairs(df, 1, 4).collect()}
    sets = [set(t) - set(fn.STOPWORDS) for t in texts]
    want = {(i, j, len(a & b), len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a) >= 3 and len(b) >= 3 and 4 * len(a & b) >= len(a | b)}
    assert got == want


def test_compaction(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "t", "summary" if i == 2 else "fact", "x", i == 3, t0 + dt.timedelta(seconds=i)) for i in range(45)]
    notes = migrate("notes", spark.createDataFrame(rows, "id long, topic string, kind string, content string, pinned boolean, created_at timestamp"))
    tasks = migrate("tasks", spark.createDataFrame([(1, "t", "todo", [5]), (2, "t", "done", [6])], "id long, topic string, status string, notes array<long>"))
    planets = migrate("planets", spark.createDataFrame([(1, "t")], "id long, topic string"))
    links = spark.createDataFrame([(0, 44), (43, 44)], "from_note_id long, to_note_id long")
    p, n, l = memory.compact_topic("t", planets, notes, tasks, links)  # noqa: E741
    assert {r.id for r in n.collect()} == {2, 3, 5} | set(range(15, 45))
    assert p.first().memory_state == "compacted" and [tuple(r) for r in l.collect()] == [(43, 44)]


def test_tasks(spark):
    tasks = migrate("tasks", spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, "t", "c")], "id long, topic string, title string"))
    tasks = memory.update_task(memory.update_task(tasks, 2, now(), depends_on=[1]), 3, now(), depends_on=[2])
    for bad in ([3], [2], [1]):
        with pytest.raises(ValueError, match="cycle"):
            memory.update_task(tasks, 1, now(), depends_on=bad)
    with pytest.raises(ValueError, match="no such"):
        memory.update_task(tasks, 1, now(), depends_on=[99])
    with pytest.raises(ValueError, match="status"):
        memory.update_task(tasks, 1, now(), status="nope")
    done = memory.update_task(tasks, 1, now(), status="Done").where("id = 1").first()
    assert done.status == "done" and done.completed_at is not None
    batch = spark.createDataFrame([("T x", "new", "High", [2, 1, 2, 77], [], [], 1)], "topic string, title string, priority string, depends_on array<long>, files array<string>, notes array<long>, ord int")
    made = memory.create_tasks(tasks, batch, now()).where("id = 4").first()
    assert (made.topic, made.priority, made.depends_on, made.status) == ("t-x", "medium", [1, 2], "todo")
    assert memory.list_tasks(tasks, status="unknown").count() == 3
    assert [(r.status, r.n, r.total) for r in memory.task_summary(tasks).collect()] == [("todo", 3, 3)]
    planets, notes, blocked = memory.block_task(empty(spark, "planets"), empty(spark, "notes"), tasks, 2, "stuck", now())
    row = blocked.where("id = 2").first()
    assert row.status == "blocked" and row.notes == [1] and notes.first().title == "Blocked: b" and planets.count() == 1


def test_notes_and_planets(spark):
    batch = spark.createDataFrame([("New Topic", " Fact ", "hello", None, None, None, 1), ("new_topic", "", "more", "t", "me", "done", 2)], "topic string, kind string, content string, title string, agent_id string, status string, ord int")
    planets, notes = memory.add_notes(empty(spark, "planets"), empty(spark, "notes"), batch, now())
    assert [(r.id, r.topic, r.aliases) for r in planets.collect()] == [(1, "new-topic", ["new-topic"])]
    assert [(r.id, r.kind, r.title, r.agent_id, r.status) for r in notes.orderBy("id").collect()] == [(1, "fact", "hello", "default", "open"), (2, "fact", "t", "me", "done")]
    change = spark.createDataFrame([("New topic", None, "g", None, None, "b", "f.py", None)], "topic string, status string, goal string, current_state string, handoff string, next_step string, file string, command string")
    twice = memory.update_planets(memory.update_planets(planets, change, now()), change.withColumn("next_step", F.lit("a")), now()).first()
    assert (twice.goal, twice.next_steps, twice.files, twice.status) == ("g", ["a", "b"], ["f.py"], "active")
    assert memory.pin(notes, [2]).where("pinned").count() == 1 and memory.tag(notes, 1, ["x"]).where("id = 1").first().tags == ["x"]
    with pytest.raises(ValueError):
        memory.set_memory_state(planets, "new-topic", "cold")
    links = memory.link(empty(spark, "note_links"), migrate("note_links", spark.createDataFrame([(2, 1, "related"), (1, 2, "related"), (1, 1, "related")], "from_note_id long, to_note_id long, link_type string")), "from_note_id", "to_note_id", "link_type")
    assert [(r.from_note_id, r.to_note_id) for r in links.collect()] == [(1, 2)]
    gone = memory.delete_planet("new-topic", planets, notes, links, empty(spark, "tasks"), empty(spark, "planet_links"))
    assert all(t.count() == 0 for t in gone.values())


def test_migration_is_idempotent(spark):
    old = spark.createDataFrame([(1, "t", "fact", "c")], "id long, topic string, kind string, content string")
    once = migrate("notes", old)
    assert once.collect() == migrate("notes", once).collect() and once.first().pinned is False and once.first().tags == []
    for name in TABLES:
        assert migrate(name, empty(spark, name)).count() == 0


def test_store_and_export(spark, tmp_path, notes):
    store = TableStore(spark, str(tmp_path / "db"), keep=2)
    assert store.read("notes").count() == 0
    store.write("notes", notes)
    store.merge("notes", notes.where("id = 1").withColumn("content", F.lit("changed")))
    store.merge("notes", notes.withColumn("content", F.lit("ignored")), "ignore")
    assert store.read("notes").where("content = 'changed'").count() == 1 and store.read("notes").count() == 4
    assert store.versions("notes") == [2, 3]
    store.delete("notes", F.col("id") == 4)
    assert store.read("notes").count() == 3
    tables = {"planets": empty(spark, "planets"), "notes": store.read("notes"), "note_links": empty(spark, "note_links"), "planet_links": empty(spark, "planet_links")}
    export_json(tables, str(tmp_path / "out"))
    back = import_json(spark, str(tmp_path / "out"))
    assert sorted(map(str, back["notes"].collect())) == sorted(map(str, tables["notes"].collect()))
    grown, counts = memory.import_table("notes", store.read("notes").where("id < 3"), back["notes"])
    assert grown.count() == 3 and tuple(counts.first()) == (1, 2)


def test_weighted_traversal(spark):
    links = spark.createDataFrame([(1, 2, 800), (1, 3, 500), (2, 3, 300), (3, 4, 900), (4, 5, 0)], "from_id long, to_id long, weight_milli long")
    seed = spark.createDataFrame([(1,)], "id long")
    one = sorted((r.id, r.weight_milli, r.depth) for r in graph.weighted_neighbors(links, seed, 1).collect())
    assert one == [(2, 800, 1), (3, 500, 1)]
    two = {(r.source, r.target) for r in graph.subgraph(links, seed, 2, 400).collect()}
    assert two == {(1, 2), (2, 1), (1, 3), (3, 1), (3, 4)}
    ranked = [(r.neighbor, r.rank) for r in graph.rank_neighbors(links.withColumn("confidence_milli", F.col("weight_milli"))).where("id = 3").orderBy("rank").collect()]
    assert ranked == [(4, 1), (1, 2), (2, 3)]


def test_paths_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "from_id string, to_id string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "x")], "from_id string, to_id string")
    got = {(r.from_id, r.to_id): r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {("a", "d"): ["a", "b", "c", "d"], ("a", "a"): ["a"], ("a", "x"): None}
    vertices = spark.createDataFrame([(v,) for v in "abcdxyz"], "id string")
    assert {r.id: r.component for r in graph.components(edges, vertices).collect()} == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "x", "z": "z"}
    assert {(r.id, r.depth) for r in graph.k_hop(edges, vertices.where("id = 'b'"), 2).collect()} == {("b", 0), ("a", 1), ("c", 1), ("d", 2)}
    triangle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "from_id long, to_id long")
    row = graph.clustering(triangle, spark.range(1, 5)).first()
    assert (row.vertices, row.triangles, row.mean_milli) == (4, 1, round(1000 * (1 + 1 + 1 / 3) / 4, 6))


def test_paths_have_no_longest(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(26)], "from_id long, to_id long")
    pairs = spark.createDataFrame([(26, 0), (0, 99)], "from_id long, to_id long")
    got = {(r.from_id, r.to_id): (r.length, r.path) for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {(26, 0): (26, list(range(26, -1, -1))), (0, 99): (None, None)}
    assert {r.length for r in graph.shortest_paths(edges, pairs, longest=20).collect()} == {None}
