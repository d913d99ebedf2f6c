"""Files to symbols, code graph, search, context and streams."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import code, search, similarity
from graphloom.plans import context
from graphloom.sources import code_files
from graphloom.sources.schemas import migrate
from graphloom.sources.store import TableStore
from graphloom.streaming import gains, operators as streams

SOURCE = '''"""Doc."""
import os
from pkg.mod import thing

class A(Base):
    """About A."""
    def run(self):
        return helper(thing())

async def helper(x):
    return x

helper(1)
'''


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "proj"
    (root / "sub").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "a.py").write_text(SOURCE)
    (root / "sub" / "b.js").write_text("import x from './a'\nexport function go() {}\nclass K {}\n")
    (root / "bad.py").write_text("def broken(:\n")
    (root / "node_modules" / "c.py").write_text("def no(): pass\n")
    (root / "notes.md").write_text("# no")
    return root


def test_extraction(spark, project):
    files = code_files.discover(spark, str(project))
    assert {r.path for r in files.collect()} == {"a.py", "bad.py", "sub/b.js"}
    symbols, edges = code_files.index_files(files)
    got = {(r.file_path, r.symbol_name): (r.symbol_type, r.start_line, r.docstring) for r in symbols.collect()}
    assert got == {("a.py", "A"): ("class", 5, "About A."), ("a.py", "run"): ("method", 7, ""), ("a.py", "helper"): ("async_function", 10, ""), ("sub/b.js", "go"): ("function", 2, ""), ("sub/b.js", "K"): ("class", 3, "")}
    parent = symbols.where("symbol_name = 'run'").first().parent_id
    assert parent == symbols.where("symbol_name = 'A'").first().id
    calls = {(r.from_name, r.to_name, r.line_number, r.to_symbol_id > 0) for r in edges.where("edge_type = 'calls'").collect()}
    assert calls == {("run", "helper", 8, True), ("run", "thing", 8, False), ("", "helper", 13, True)}
    assert {r.from_name for r in edges.where("edge_type = 'imports'").collect()} == {"os", "pkg.mod.thing", "./a"}
    assert [r.symbol_name for r in code.callers(symbols, edges).where("to_name = 'helper'").collect()] == ["run"]
    lines = [(r.line, r.text) for r in code.read_lines(files, "a.py", 4, 2).orderBy("line").collect()]
    assert lines == [(5, "class A(Base):"), (6, '    """About A."""')]
    with pytest.raises(ValueError):
        code.read_lines(files, "../x")
    seen = files.select("path", F.sha2("content", 256).alias("hash")).where("path <> 'bad.py'").withColumn("hash", F.when(F.col("path") == "a.py", "old").otherwise(F.col("hash")))
    assert {(r.path, r.change) for r in code_files.changed_files(files, seen).collect()} == {("a.py", "modified"), ("bad.py", "created")}


def test_dead_exports(spark):
    symbols = spark.createDataFrame([(1, "m/a.py", "f"), (2, "m/b.py", "g"), (3, "m/c.py", "h"), (4, "m/d.py", "k")], "id long, file_path string, symbol_name string")
    edges = spark.createDataFrame([("calls", "x", "f", "m/b.py"), ("calls", "y", "h", "m/c.py"), ("imports", "m.b.g", None, "m/a.py"), ("imports", "m.ccc", None, "m/a.py")], "edge_type string, from_name string, to_name string, file_path string")
    assert {r.file_path for r in code.dead_exports(symbols, edges).collect()} == {"m/c.py", "m/d.py"}


def test_search(spark):
    docs = spark.createDataFrame([(1, "graph edges", "weights of a graph"), (2, "edge", "graphs"), (3, "other", None)], "id long, title string, content string")
    assert [r.id for r in search.bm25(docs, "id", ["title", "content"], "graph edge").collect()] == [2, 1] or [r.id for r in search.bm25(docs, "id", ["title", "content"], "graph edge").collect()] == [1, 2]
    assert search.bm25(docs, "id", ["title"], "  !").count() == 0
    s = docs.select("id", F.col("title").alias("symbol_name"), F.lit("").alias("signature"), F.col("content").alias("docstring"), F.lit("x.py").alias("file_path"), F.lit("function").alias("symbol_type"), F.lit("function").alias("kind"))
    assert search.search_symbols(s, "dge").count() == 2 and search.search_symbols(s, "^oth", use_regex=True).count() == 1 and search.search_symbols(s, " ").count() == 0
    files = spark.createDataFrame([("a", "x = 1\ny = x\nz")], "path string, content string")
    lines = spark.createDataFrame([("a", 1)], "path string, line int")
    assert [(r.line, r.text) for r in search.references(files, "x", lines).collect()] == [(2, "y = x")]
    assert search.rerank_prompt(docs, [2, 1], "q").first().prompt == "Rank these by relevance to: q\nnote-1: weights of a graph\nnote-2: graphs"


def test_context(spark):
    planets = migrate("planets", spark.createDataFrame([(1, "t", "Goal  here", ["s"])], "id long, topic string, goal string, next_steps array<string>"))
    rows = [(i, "t", "turn" if i % 2 else "decision", f"text {i}", i == 4, f"2024-01-01 00:00:{i:02d}") for i in range(30)]
    notes = migrate("notes", spark.createDataFrame(rows, "id long, topic string, kind string, content string, pinned boolean, created_at string"))
    text = context.agent_context(planets, notes, None, "t").first().text
    assert text.startswith("# Knowledge Base Context\nTopic: t\nStatus: active\n\n## Goal\nGoal here\n\n## Current State\nNo current state recorded.\n\n## Next Steps\n- s\n\n## Pinned Notes\n- [decision] text 4\n\n## Key Notes\n- [decision] text 28\n")
    assert text.count("default: ") == 6
    assert context.nested_planets(planets, notes, 3).first().notes[0].id == 29


def test_streams_equal_batches(spark, tmp_path):
    schema = "project string, path string, change string, ts timestamp"
    rows = [("p", "a", "modified", "2024-01-01 00:00:00"), ("p", "b", "created", "2024-01-01 00:00:01"), ("p", "a", "modified", "2024-01-01 00:00:02"), ("p", "c", "deleted", "2024-01-01 00:00:09"), ("q", "a", "created", "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "project string, path string, change string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = sorted((r.project, r.n, r.created, r.modified, r.deleted) for r in streams.debounce(events).collect())
    assert batch == [("p", 1, [], [], ["c"]), ("p", 3, ["b"], ["a"], []), ("q", 1, ["a"], [], [])]
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counted = streams.run_to_table(stream.groupBy("project").count())
    assert {(r.project, r["count"]) for r in counted.collect()} == {("p", 4), ("q", 1)}


def test_incremental_links_equal_batch(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"))
    texts = ["first note about graphs", "second note about edges", "use weighted graphs", "better pruning"]
    for i, t in enumerate(texts):
        migrate("notes", spark.createDataFrame([(i + 1, "t", "fact", t)], "id long, topic string, kind string, content string")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(store.read("notes").schema).parquet(str(tmp_path / "in"))
        streams.link_new_notes(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert {(r.from_note_id, r.to_note_id, r.weight, r.confidence) for r in store.read("note_links").collect()} == {(1, 2, 0.2, 0.3), (1, 3, 0.2, 0.3)}
    spark.createDataFrame([(1, 2), (1, 2)], "from_note_id long, to_note_id long").write.parquet(str(tmp_path / "acc"))
    access = spark.readStream.schema("from_note_id long, to_note_id long").parquet(str(tmp_path / "acc"))
    streams.reinforce_on_access(access, store, str(tmp_path / "ck2")).awaitTermination()
    assert store.read("note_links").where("to_note_id = 2").first().weight == 0.3
    # The same batch once more, as after a failure: nothing is added twice.
    streams.reinforce_on_access(access, store, str(tmp_path / "ck3")).awaitTermination()
    assert store.read("note_links").where("to_note_id = 2").first().weight == 0.3 and store.marks("note_links") == {"accesses": 0}


def test_watch_sees_creations_changes_moves_and_deletions(spark, project, tmp_path):
    store = TableStore(spark, str(tmp_path / "db"))

    def watch() -> list[tuple]:
        streams.watch_files(spark, str(project), store, str(tmp_path / "ck")).awaitTermination()
        return sorted((r.file_path, r.symbol_name) for r in store.read("code_symbols").collect())

    first = watch()
    assert ("a.py", "run") in first and ("sub/b.js", "go") in first and not any("node_modules" in p for p, _ in first)
    assert [r.file_path for r in store.read("code_failures").collect()] == ["bad.py"]
    before = store.versions("code_symbols")
    assert watch() == first and store.versions("code_symbols") == before  # a restart repeats nothing
    (project / "a2.py").write_text("def later():\n    return go()\n")
    assert watch() == sorted([*first, ("a2.py", "later")])
    (project / "a2.py").rename(project / "a3.py")
    assert watch() == sorted([*first, ("a3.py", "later")])
    go = store.read("code_symbols").where("symbol_name = 'go'").first().id
    assert store.read("code_edges").where("to_name = 'go' AND file_path = 'a3.py'").first().to_symbol_id == go
    (project / "sub" / "b.js").unlink()
    assert watch() == sorted([("a3.py", "later"), *[r for r in first if r[0] != "sub/b.js"]])
    # The call stays, and its end, whose file is gone, is open again.
    assert store.read("code_edges").where("to_name = 'go' AND file_path = 'a3.py'").first().to_symbol_id == 0
    for file in list(project.rglob("*.py")):
        file.unlink()
    assert watch() == [] and store.read("code_edges").count() == 0  # deletions alone empty the tables


def test_gains_equal_batch_reinforcement(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    store = TableStore(spark, str(tmp_path / "db"))
    links = [(1, 2, "auto", 0.2), (1, 3, "auto", 0.93), (2, 3, "explicit", 0.5), (3, 4, "auto", 0.1)]
    store.write("note_links", spark.createDataFrame(links, "from_note_id long, to_note_id long, link_type string, weight double"))
    place, seen = str(tmp_path / "in"), []

    def access(pairs: list[tuple[int, int]]) -> None:
        spark.createDataFrame(pairs, "from_note_id long, to_note_id long").coalesce(1).write.mode("append").parquet(place)
        seen.extend(pairs)

    def run(checkpoint: str = "ck") -> dict:
        stream = spark.readStream.schema("from_note_id long, to_note_id long").parquet(place)
        gains.reinforce_as_state(stream, store, str(tmp_path / checkpoint)).awaitTermination()
        return {(r.from_note_id, r.to_note_id): r.weight for r in gains.weights(store).collect()}

    def batch() -> dict:
        rows = spark.createDataFrame([(a, b, k, round(1000 * w)) for a, b, k, w in links], "from_note_id long, to_note_id long, link_type string, weight_milli long")
        out = similarity.reinforce(rows, spark.createDataFrame(seen, "from_note_id long, to_note_id long"))
        return {(r.from_note_id, r.to_note_id): r.weight_milli / 1000 for r in out.collect()}

    access([(1, 2), (1, 2), (1, 3), (2, 3), (9, 10)])
    tables = store.versions("note_links")
    assert run() == batch()
    access([(1, 3)] * 3 + [(1, 2)])
    assert run() == batch() and store.versions("note_links") == tables  # no batch rewrites the links
    rows = store.read("link_gains").count()
    access([(1, 3)] * 5)
    assert run() == batch() and store.read("link_gains").count() == rows  # a full link gives no rows
    # Without its checkpoint the stream runs all batches again under the same numbers: nothing is added.
    assert run("ck2") == batch()
    gains.settle(store)
    assert run() == batch() and store.read("link_gains").count() == 0
    assert {(r.from_note_id, r.to_note_id): r.weight for r in store.read("note_links").collect()} == batch()


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("topic string").parquet(str(tmp_path / "none"))
    assert streams.run_to_table(streams.note_counts(stream)).collect() == []


def test_transcripts(spark):
    lines = ['{"role":"user","content":"hi"}', '{"type":"assistant","content":[{"text":"a"},{"text":"b"}]}', '{"role":"system","content":"no"}', "broken", '{"payload":{"role":"user","content":" x "}}']
    got = [(r.role, r.content) for r in code_files.transcript_turns(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("user", "hi"), ("assistant", "a\nb"), ("user", "x")]


def test_entry_without_the_training_data_operators(tmp_path):
    """The driver removes graphloom/llm, tests/llm and the pipeline; the rest must import."""
    root = Path(__file__).resolve().parent.parent
    for item in ("__spark_entry__.py",):
        (tmp_path / item).write_text((root / item).read_text())
    for path in (root / "graphloom").rglob("*.py"):
        if "llm" not in path.parts:
            to = tmp_path / path.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
