"""Transcripts and exports of several shapes, broken ones too."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.sources import documents
from graphloom.sources.schemas import migrate

FILES = {
    "m.json": json.dumps({"messages": [{"type": "user", "content": "hi", "timestamp": "t1"}, {"role": "assistant", "content": [{"text": "a"}, {"output_text": "b"}, {"x": 1}], "created_at": "t2"}, {"role": "tool", "content": {"k": [1]}}, 7, {"role": "user"}]}),
    "c.json": json.dumps({"messages": [], "conversation": [{"sender": "bob", "text": "yo"}]}),
    "i.json": json.dumps({"items": [{"message": "m"}]}),
    "l.json": json.dumps([{"role": "user", "content": " x "}, {"role": "user", "content": "y"}]),
    "o.json": json.dumps({"role": "user", "content": "alone"}),
    "j.jsonl": '{"role":"user","content":"q","timestamp":"t9"}\nbroken\n\n{"payload":{"type":"message","role":"assistant","content":[{"input_text":"p"}]}}\n{"role":"system","content":"no"}\n',
    "broken.json": '{"messages": [',
    "empty.json": "",
}


def test_messages_of_every_shape(spark):
    df = spark.createDataFrame([*FILES.items(), ("null.json", None)], "path string, content string")
    got = {}
    for r in documents.messages(df).orderBy("path", "at").collect():
        got.setdefault(r.path, []).append((r.shape, r.sender, r.said, r.time) if r.error is None else r.error)
    assert got == {
        "m.json": [("messages", "USER", "hi", "t1"), ("messages", "ASSISTANT", "a\nb", "t2"), ("messages", "TOOL", '{"k":[1]}', "unknown")],
        "c.json": [("conversation", "BOB", "yo", "unknown")], "i.json": [("items", "UNKNOWN", "m", "unknown")], "l.json": [("list", "USER", "x", "unknown"), ("list", "USER", "y", "unknown")],
        "o.json": [("object", "USER", "alone", "unknown")], "j.jsonl": [("lines", "USER", "q", "t9"), "no JSON: broken", ("lines", "ASSISTANT", "p", "unknown")], "broken.json": ['no JSON: {"messages": ['],
    }
    texts = {r.path: r.transcript for r in documents.transcripts(df, "T").collect()}
    assert texts["l.json"] == "Full Archive of T\n\n\n--- [unknown] USER ---\nx\n\n--- [unknown] USER ---\ny" and "broken.json" not in texts


def test_the_newest_file_is_read(spark, tmp_path):
    for i, name in enumerate(("a.json", "b.json", "c.jsonl")):
        (tmp_path / name).write_text(FILES["o.json"] if name != "b.json" else FILES["l.json"])
        os.utime(tmp_path / name, (1000 + (i == 1) * 100, 1000 + (i == 1) * 100))
    one = documents.newest_file(spark, f"{tmp_path}/*.json", f"{tmp_path}/*.jsonl")
    assert [r.path.rsplit("/")[-1] for r in one.collect()] == ["b.json"] and documents.messages(one).count() == 2
    (tmp_path / "none").mkdir()
    assert documents.newest_file(spark, f"{tmp_path}/none").count() == 0


def test_exports_as_one_document(spark, tmp_path):
    notes = migrate("notes", spark.createDataFrame([(1, "t", 'say "hi"\n', ["a"], True), (2, "t", "two", None, False)], "id long, topic string, content string, tags array<string>, pinned boolean"))
    planets = migrate("planets", spark.createDataFrame([(1, "t", ["s"])], "id long, topic string, next_steps array<string>"))
    links = migrate("note_links", spark.createDataFrame([(1, 2, 0.5)], "from_note_id long, to_note_id long, weight double"))
    from graphloom.sources.schemas import empty

    text = documents.export_document({"planets": planets, "notes": notes, "note_links": links, "planet_links": empty(spark, "planet_links")}).first().document
    assert json.loads(text)["version"] == 1 and len(json.loads(text)["notes"]) == 2
    back = documents.read_export(spark.createDataFrame([("x", text)], "path string, content string"))
    for name, df in (("planets", planets), ("notes", notes), ("note_links", links)):
        assert sorted(back[name].collect(), key=str) == sorted(df.collect(), key=str)
    assert back["planet_links"].count() == back["errors"].count() == 0
    other = json.dumps({"planets": [{"topic": "z", "next_steps": '["q"]'}, {"goal": "lost"}], "notes": [{"id": "7", "topic": "z", "content": "c"}, {"id": 8}], "note_links": 5})
    back = documents.read_export(spark.createDataFrame([("y", other), ("bad", "{"), ("none", None)], "path string, content string"))
    assert [(r.topic, r.next_steps, r.status) for r in back["planets"].collect()] == [("z", ["q"], "active")] and [(r.id, r.kind) for r in back["notes"].collect()] == [(7, None)] and back["note_links"].count() == 0
    assert sorted((r.path, r.what) for r in back["errors"].collect()) == [("bad", "no JSON"), ("none", "no JSON"), ("y", "notes row 1 lacks its key"), ("y", "planets row 1 lacks its key")]
    e = Engine(spark, str(tmp_path / "db"), F.lit("2024-05-01").cast("timestamp"))
    (tmp_path / "doc.json").write_text(other)
    assert e.import_document(str(tmp_path / "doc.json")) == {"planets": (1, 0), "notes": (1, 0), "note_links": (0, 0), "planet_links": (0, 0), "errors": 2}
    e.archive_file("z", "bot", "archive-9", str(tmp_path / "doc.json"))
    assert e.table("nodes").count() == 0  # nothing was said in it
    (tmp_path / "talk.json").write_text(FILES["m.json"])
    e.archive_file("z", "bot", "archive-9", str(tmp_path / "talk.json"))
    assert e.node("archive-9").first().content.startswith("Full Archive of z\n\n\n--- [t1] USER ---\nhi")
