"""The facade, end to end."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.plans import context


def test_memory_and_code(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), F.lit("2024-05-01").cast("timestamp"))
    texts = ["first note about graphs", "second note about edges", "use weighted graphs", "better pruning"]
    ids = [e.add_note("Graph Test", t)["id"] for t in texts]
    assert ids == [1, 2, 3, 4]
    for a, b, w in ((1, 2, 0.8), (1, 3, 0.5), (2, 3, 0.3), (3, 4, 0.9)):
        e.link_notes(a, b, weight=w)
    near = [(r.id, r.weight_milli) for r in e.neighbors(3).orderBy(F.desc("weight_milli")).collect()]
    assert near == [(4, 900), (1, 500), (2, 300), (1, 200)]
    e.decay(0.5)
    assert sorted(r.weight for r in e.table("note_links").collect()) == [0.1, 0.1, 0.3, 0.5, 0.8, 0.9]
    e.prune(0.15)
    assert e.table("note_links").count() == 4
    assert {r.action: r["count"] for r in e.recompute("graph test").collect()} == {"created": 2, "total_pairs": 6}
    e.pin(2)
    e.update_planet("graph test", goal="Link things", next_step="write")
    text = e.agent_context("Graph Test")
    assert "Topic: Graph Test\nStatus: active" in text.replace("graph-test", "Graph Test") and "## Goal\nLink things" in text and "## Pinned Notes\n- [fact] second note about edges" in text
    assert "No stored context" in e.agent_context("nothing here")
    assert {r.source for r in e.search("graph").collect()} == {"planet", "note"}
    t = e.create_task("graph test", "do it", notes=[1])
    e.block_task(t, "waiting")
    assert e.table("tasks").first().status == "blocked" and e.table("notes").where("kind = 'issue'").count() == 1
    e.compact("graph test")
    e.export(str(tmp_path / "out"))
    other = Engine(spark, str(tmp_path / "other"))
    assert other.import_(str(tmp_path / "out"))["notes"] == (5, 0) and other.import_(str(tmp_path / "out"))["notes"] == (0, 5)
    assert other.stats().where("table_name = 'notes'").first().n == 5
    e.delete_planet("graph test")
    assert e.table("notes").count() == e.table("note_links").count() == e.table("tasks").count() == 0

    root = tmp_path / "code"
    root.mkdir()
    (root / "a.py").write_text("def f():\n    return g()\n")
    (root / "b.py").write_text("def g():\n    return 1\n")
    row = e.index(str(root)).first()
    assert (row.symbol_count, row.file_count) == (2, 2)
    assert e.table("code_edges").where("to_name = 'g'").first().to_symbol_id == e.table("code_symbols").where("symbol_name = 'g'").first().id
    said = lambda df: sorted(f"{r.change} {r.path}" for r in df.collect())
    assert said(e.sync(str(root))) == ["created a.py", "created b.py"]
    (root / "a.py").write_text("def h():\n    return g()\n")
    (root / "b.py").unlink()
    assert said(e.sync(str(root))) == ["deleted b.py", "modified a.py"]
    assert [r.symbol_name for r in e.table("code_symbols").collect()] == ["h"]


def test_pages_links_archives_and_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), F.lit("2024-05-01").cast("timestamp"))
    e.log_interaction("First Topic", decision="use it", current_state="begun", activity="hello")
    assert e.planet_page("first topic") is not None and "## Decisions\n- use it" in e.planet_page("first topic") and "hello" in e.planet_page("first topic")
    e.ensure_planet("FIRST topic")
    e.update_planet("first topic", handoff="carry on")
    assert e.agent_context("first topic").endswith("\n\n## Handoff\ncarry on\n\n" + context.INSTRUCTIONS) and e.planet("First Topic").first().handoff == "carry on"
    assert e.planet_dump("first topic") == "first-topic | active\n  goal: \u2014\n  state: begun\n  next: \u2014\n  handoff: carry on\n  notes (2):\n    [turn] hello\n    [deci] use it" and e.planet_dump("none") is None
    assert e.planets().first().aliases == ["FIRST topic", "first-topic"]
    e.create_task("Second", "a task")
    e.link_planets("first topic", "second")
    e.link_planets("second", "first topic")
    assert e.table("planet_links").count() == 1
    for a, b in (("second", "second"), ("second", "third")):
        with pytest.raises(ValueError):
            e.link_planets(a, b)
    e.archive("second", "whole talk", "bot", "archive-1")
    e.archive("third", "lost talk", "bot", "archive-2")
    e.folder_hub("work")
    e.folder_hub("work")
    assert {r.id for r in e.table("nodes").collect()} == {"archive-1", "hub-work"} and e.node("archive-1").first().content == "whole talk"
    assert [r.id for r in e.search_nodes("talk").collect()] == ["archive-1"] and e.search_nodes("nothing").count() == 0
    assert e.note(1).first().kind == "decision" and e.note(99).count() == 0 and e.briefing().count() == 2
    for wrong in (lambda: e.pin(99), lambda: e.tag(99, ["x"]), lambda: e.update_task(99, status="done")):
        with pytest.raises(ValueError):
            wrong()
