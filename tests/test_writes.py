"""Batches with repeated keys, appended versions, double writers, and new notes beside pruned links."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import memory, similarity
from graphloom.sources import store as stores
from graphloom.sources.schemas import empty, migrate



def now():
    return F.lit("2024-05-01").cast("timestamp")


def test_repeated_keys_in_a_batch(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    delta = spark.createDataFrame([(1, "new", None, 2), (1, "old", "z", 1), (3, "c", None, 1), (3, "d", "q", 2)], "id long, v string, w string, ord int")
    assert sorted(map(tuple, memory.upsert(base, delta, ["id"]).collect())) == [(1, "new", None), (2, "b", "y"), (3, "d", "q")]
    assert sorted(map(tuple, memory.insert_ignore(base, delta, ["id"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert sorted(map(tuple, memory.patch(base, delta, ["id"]).collect())) == [(1, "new", "z"), (2, "b", "y")]


def test_several_interactions_of_a_topic(spark):
    batch = spark.createDataFrame([("T", "go", "", "", "one", "a", "said", 1), ("t", "", "", "", "two", "b", "", 2), ("t", "", "", "", "", "a", "", 3)], "topic string, decision string, fact string, summary string, current_state string, next_step string, activity string, ord long")
    planets, notes = memory.log_interaction(empty(spark, "planets"), empty(spark, "notes"), batch, now())
    assert [(r.id, r.current_state, r.next_steps) for r in planets.collect()] == [(1, "two", ["a", "b"])]
    assert sorted((r.kind, r.content) for r in notes.collect()) == [("decision", "go"), ("turn", "said")]


def test_appends_keep_versions_and_refuse_double_writers(spark, tmp_path, monkeypatch):
    store = stores.TableStore(spark, str(tmp_path / "db"), keep=2)
    row = lambda i: migrate("notes", spark.createDataFrame([(i, f"t{i}")], "id long, topic string"))
    store.write("notes", row(1))
    monkeypatch.setattr(stores, "MAX_PARTS", 3)
    for i in range(2, 7):
        store.merge("notes", row(i).unionByName(row(i)).unionByName(row(1)), "ignore")
        assert sorted(r.id for r in store.read("notes").collect()) == list(range(1, i + 1))
    assert len(store.versions("notes")) == 2
    claim = tmp_path / "db" / "notes" / "claim=7"
    claim.write_text("")
    with pytest.raises(stores.ConflictError):
        store.write("notes", row(9))
    store.recover("notes")
    assert store.write("notes", row(9)) == 7 and store.read("notes").count() == 1


def test_new_notes_leave_pruned_links_and_find_turns(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), now())
    e.add_note("t", "alpha beta gamma delta")
    e.add_note("t", "alpha beta gamma epsilon")
    assert e.table("note_links").count() == 1
    e.decay(0.01)
    e.prune(0.1)
    e.log_turn("t", "zeta theta kappa lambda")
    e.add_note("t", "zeta theta kappa omega")
    assert [(r.from_note_id, r.to_note_id, r.weight) for r in e.table("note_links").collect()] == [(3, 4, 0.6)]
    e.log_turn("t", "zeta theta kappa lambda")  # a turn looks for nothing
    assert e.table("note_links").count() == 1
    e.delete_planet("t")
    e.add_note("t", "zeta theta kappa omega")
    assert e.table("note_links").count() == 0  # the index has forgotten the notes that went
    e.add_nodes(spark.createDataFrame([("n", "Café plan", "x", ["menu"])], "id string, title string, content string, keywords array<string>"))
    assert [r.id for r in e.search_nodes("cafe menu").collect()] == ["n"] and {r.source for r in e.search("plan").collect()} == {"node"}
    e.delete_node("n")
    assert e.search_nodes("cafe").count() == 0


def test_the_index_of_notes_finds_what_pairs_find(spark, tmp_path):
    words = [f"word{chr(97 + i)}x" for i in range(12)]
    rows = [(i, f"t{i % 3}", ("fact", "turn", "decision")[i % 5 % 3], " ".join(words[(i * 7 + k * (1 + i % 4)) % 12] for k in range(5))) for i in range(1, 90)]
    notes = migrate("notes", spark.createDataFrame(rows, "id long, topic string, kind string, content string"))
    index, found = similarity.NoteIndex(spark, str(tmp_path / "i")), []
    for part in (notes.where("id <= 40"), notes.where("id > 40")):
        index.write(part)
        found += [(r.from_note_id, r.to_note_id, r.weight_milli) for r in index.links(part).collect()]
    want = similarity.auto_links(notes, fresh=notes.where("kind NOT IN ('turn', 'summary')").select("id"))
    assert sorted(found) == sorted((r.from_note_id, r.to_note_id, r.weight_milli) for r in want.collect()) and len(found) > 50


def test_projects_are_found_and_steps_removed(spark, tmp_path):
    from graphloom.operators import graph

    e = Engine(spark, str(tmp_path / "a" / "db"), now())
    e.store.write("code_symbols", migrate("code_symbols", spark.createDataFrame([(1, "f.py"), (2, "f.py")], "id long, file_path string")))
    (tmp_path / "b" / "db" / "code_symbols").mkdir(parents=True)
    (tmp_path / "b" / "db" / "code_symbols" / "version=1.json").write_text("broken")
    got = [(r.root.rsplit("/", 2)[-2], r.symbols, r.files) for r in stores.find_projects(spark, f"{tmp_path}/*/db").collect()]
    assert got == [("a", 2, 1), ("b", 0, 0)] and stores.find_projects(spark, f"{tmp_path}/none/*").count() == 0
    steps = __import__("pathlib").Path(graph.shared_steps(spark))
    before = set(steps.iterdir()) if steps.exists() else set()
    e.ensure_planet("One Topic")
    assert set(steps.iterdir()) - before == set() and e.planets().count() == 1
