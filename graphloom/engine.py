"""A facade over a table store: the calls of the memory and code library, each a few operators."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import slug_of
from .operators import code, graph, lookup, memory, search, similarity
from .operators.fulltext import TextIndex
from .plans import context
from .sources import code_files, documents, store as stores
from .streaming import gains


def _stores(method):
    """For methods whose results are stored or plain values when they return: the steps on the way are removed."""

    @wraps(method)
    def run(self, *args, **options):
        with graph.steps_removed(self.spark):
            return method(self, *args, **options)

    return run


class Engine:
    """Reads give DataFrames; writes make new versions of tables."""

    def __init__(self, spark: SparkSession, root: str, now: Column | None = None):
        self.spark, self.store = spark, stores.TableStore(spark, root)
        self.now = now if now is not None else F.current_timestamp()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def slug(self, topic: str) -> str:
        return slug_of(topic)

    # notes and planets

    def _index(self, name: str, kind: type, *args) -> TextIndex:
        """The index of a table, built from its rows when it is first asked for and kept by writes from then on."""
        index = kind(self.spark, f"{self.store.root}/index/{name}", *args)
        if not index.exists():
            index.write(self.table(name))
        return index

    def node_index(self) -> TextIndex:
        return self._index("nodes", search.TextIndex, search.NODE_TEXTS)

    def note_index(self) -> similarity.NoteIndex:
        return self._index("notes", similarity.NoteIndex)

    def _save_notes(self, notes: DataFrame, planets: DataFrame, drops: bool = False) -> DataFrame:
        """Stores new states of both tables and gives the notes that are new; the index learns of them and, with ``drops``, of those that are gone."""
        index, before = self.note_index(), self.table("notes").select("id")
        # What is new is told by key; no table is written in place, so both states can be read on.
        grown = graph.cut(notes.join(before, "id", "left_anti"))
        gone = graph.cut(before.join(notes.select("id"), "id", "left_anti")) if drops else None
        if drops:
            self.store.write("notes", notes)
        else:
            self.store.write("notes", grown, append=True)
        self.store.write("planets", planets)
        index.write(grown, gone)
        return grown

    @_stores
    def add_note(self, topic: str, content: str, kind: str = "fact", title: str | None = None, agent_id: str | None = None, status: str | None = None, auto_link: bool = True) -> dict:
        """Adds a note, links it with the notes of its topic unless it is a turn or summary, and says whether a summary is due.

        Links that are there keep their weight, and links that were pruned
        stay so: only pairs with the new note are looked at.
        """
        row = self.spark.createDataFrame([(topic, kind, content, title, agent_id, status, 1)], "topic string, kind string, content string, title string, agent_id string, status string, ord int")
        planets, notes = memory.add_notes(self.table("planets"), self.table("notes"), row, self.now)
        grown = self._save_notes(notes, planets)
        if auto_link:
            self._link(grown)
        name = self.slug(topic)
        n = self.table("notes").where(F.col("topic") == name).count()
        return {"id": grown.first()["id"], "topic": name, "summarize": n >= memory.SUMMARIZE_AT}

    def _link(self, batch: DataFrame, num: int = 1, den: int = 5) -> None:
        new = graph.cut(link_rows(self.note_index().links(batch, num, den), self.now))
        if new.limit(1).count():
            self.store.merge("note_links", new, "ignore")

    @_stores
    def log_interaction(self, topic: str, decision: str = "", fact: str = "", summary: str = "", current_state: str = "", next_step: str = "", activity: str = "") -> None:
        """Up to three notes, a change of the planet and a turn in one call."""
        names = ("topic", "decision", "fact", "summary", "current_state", "next_step", "activity")
        row = self.spark.createDataFrame([(topic, decision, fact, summary, current_state, next_step, activity, 0)], ", ".join(f"{n} string" for n in names) + ", ord long")
        planets, notes = memory.log_interaction(self.table("planets"), self.table("notes"), row, self.now)
        self._link(self._save_notes(notes, planets))

    @_stores
    def archive(self, topic: str, transcript: str, agent_id: str, archive_id: str) -> None:
        """A transcript as a conversation node of an existing planet; without that planet nothing changes."""
        row = self.spark.createDataFrame([(topic, transcript, agent_id, archive_id, 0)], "topic string, transcript string, agent_id string, archive_id string, ord long")
        planets, notes, nodes = memory.archive_transcripts(self.table("planets"), self.table("notes"), self.table("nodes"), row, self.now)
        self._save_notes(notes, planets)
        self.add_nodes(nodes.where(F.col("id") == archive_id))

    @_stores
    def add_nodes(self, nodes: DataFrame) -> None:
        """Nodes in place of those of their ids, in the table and in its index; of several of one id the last (``ord``) stays."""
        one = graph.cut(memory.one_per_key(nodes, ["id"]))
        index = self.node_index()
        self.store.merge("nodes", one)
        index.write(one)

    @_stores
    def delete_node(self, node: str) -> None:
        """The node, its edges and its postings."""
        index = self.node_index()
        self.store.delete_node(node)
        index.write(gone=self.spark.createDataFrame([(node,)], "id string"))

    @_stores
    def folder_hub(self, folder: str) -> None:
        grown = memory.folder_hubs(self.table("nodes"), self.spark.createDataFrame([(folder,)], "folder string"), self.now)
        self.add_nodes(grown.join(self.table("nodes").select("id"), "id", "left_anti"))

    @_stores
    def ensure_planet(self, topic: str) -> None:
        self.store.write("planets", graph.cut(memory.ensure_planets(self.table("planets"), self.spark.createDataFrame([(topic,)], "topic string"), self.now)))

    @_stores
    def link_planets(self, a: str, b: str, relation: str = "related", weight: float = 1.0) -> None:
        row = self.spark.createDataFrame([(a, b, relation, weight, 0)], "from_topic string, to_topic string, relation string, weight double, ord long")
        links, refused = memory.link_planets(self.table("planets"), self.table("planet_links"), row, self.now)
        if (r := refused.first()) is not None:
            raise ValueError(r["reason"])
        self.store.write("planet_links", graph.cut(links))

    def log_turn(self, topic: str, message: str, agent_id: str = "default") -> dict:
        return self.add_note(topic, message, "turn", "", agent_id, auto_link=False)

    @_stores
    def link_topic(self, topic: str, num: int = 1, den: int = 5) -> None:
        """Links all notes of a topic anew, each with those before it; links that are there stay as they are."""
        own = self.table("notes").where(F.col("topic") == topic)
        new = similarity.auto_links(own, num, den, fresh=own.where(~F.col("kind").isin("turn", "summary")).select("id"))
        self.store.merge("note_links", link_rows(new, self.now), "ignore")

    def link_notes(self, a: int, b: int, link_type: str = "related", weight: float = 1.0) -> None:
        if a == b:
            raise ValueError("a note does not link to itself")
        if self.table("notes").where(F.col("id").isin(a, b)).count() < 2:
            raise ValueError("no such note")
        row = self.spark.createDataFrame([(a, b, link_type, weight, 1.0, "explicit")], "from_note_id long, to_note_id long, link_type string, weight double, confidence double, source string")
        self.store.write("note_links", memory.link(self.table("note_links"), row.withColumns({"created_at": self.now, "updated_at": self.now}), "from_note_id", "to_note_id", "link_type"))

    def pin(self, note: int, pinned: bool = True) -> None:
        self.store.write("notes", memory.pin(self.table("notes"), [note], pinned))

    def tag(self, note: int, tags: list[str]) -> None:
        self.store.write("notes", memory.tag(self.table("notes"), note, tags))

    @_stores
    def update_planet(self, topic: str, **change: str | None) -> None:
        names = ("status", "goal", "current_state", "handoff", "next_step", "file", "command")
        row = self.spark.createDataFrame([(topic, *[change.get(n) for n in names])], ", ".join(f"{n} string" for n in ("topic", *names)))
        self.store.write("planets", memory.update_planets(self.table("planets"), row, self.now))

    @_stores
    def delete_planet(self, topic: str) -> None:
        names = ("planets", "notes", "note_links", "tasks", "planet_links")
        out = memory.delete_planet(self.slug(topic), *[self.table(n) for n in names])
        for name in ("note_links", "tasks", "planet_links"):
            self.store.write(name, out[name])
        self._save_notes(out["notes"], out["planets"], drops=True)

    @_stores
    def compact(self, topic: str) -> None:
        planets, notes, links = memory.compact_topic(self.slug(topic), self.table("planets"), self.table("notes"), self.table("tasks"), self.table("note_links"))
        self.store.write("note_links", links)
        self._save_notes(notes, planets, drops=True)

    def set_memory_state(self, topic: str, state: str) -> None:
        self.store.write("planets", memory.set_memory_state(self.table("planets"), self.slug(topic), state))

    # links

    def _milli(self) -> DataFrame:
        return gains.weights(self.store).withColumn("weight_milli", F.round(F.col("weight") * 1000).cast("long"))

    def _keep(self, links: DataFrame) -> None:
        """New links in place of those with all gains so far, which are in them."""
        self.store.write("note_links", links.withColumn("weight", F.col("weight_milli") / 1000), marks=self.store.marks("link_gains"))

    def _within(self, topic: str | None) -> DataFrame | None:
        return self.table("notes").where(F.col("topic") == self.slug(topic)).select("id") if topic else None

    @_stores
    def decay(self, factor: float = 0.9, topic: str | None = None) -> None:
        self._keep(similarity.decay(self._milli(), round(1000 * factor), self._within(topic)))

    @_stores
    def prune(self, threshold: float = 0.05, topic: str | None = None) -> None:
        self._keep(similarity.prune(self._milli(), round(1000 * threshold), self._within(topic)))

    def recompute(self, topic: str | None = None, num: int = 1, den: int = 10) -> DataFrame:
        """Measures all pairs of a topic, or of all topics together, again; counts by action."""
        notes = self.table("notes")
        notes = notes.where(F.col("topic") == self.slug(topic)) if topic else notes
        links = self._milli().where("link_type = 'auto'").select("from_note_id", "to_note_id", "weight_milli")
        out = graph.cut(similarity.recompute_links(notes, links, num, den, group="topic" if topic else None))
        kept = out.where("action <> 'deleted'").select(F.col("from_note_id"), F.col("to_note_id"), "weight_milli", similarity.confidence_milli(F.col("weight_milli")).alias("confidence_milli"))
        explicit = self.table("note_links").where("link_type <> 'auto'")
        self.store.write("note_links", explicit.unionByName(link_rows(kept, self.now)), marks=self.store.marks("link_gains"))
        return similarity.recompute_counts(out, notes, "topic" if topic else None)

    # reads

    def node(self, node: str) -> DataFrame:
        return lookup.by_key(self.table("nodes"), node)

    def note(self, note: int) -> DataFrame:
        return lookup.by_key(self.table("notes"), note)

    def symbol(self, symbol: int) -> DataFrame:
        return lookup.by_key(self.table("code_symbols"), symbol)

    def symbols_by_name(self, name: str, file_path: str = "") -> DataFrame:
        return lookup.symbols_by_name(self.table("code_symbols"), name, file_path)

    def edges(self, from_id: str | None = None, to_id: str | None = None) -> DataFrame:
        return lookup.get_edges(self.table("edges"), from_id, to_id)

    def planets(self) -> DataFrame:
        return lookup.list_planets(self.table("planets"))

    @_stores
    def planet_page(self, topic: str) -> str | None:
        name = self.slug(topic)
        row = context.planet_pages(*[self.table(t).where(F.col("topic") == name) for t in ("planets", "notes")]).first()
        return row["text"] if row else None

    def planet(self, topic: str) -> DataFrame:
        """The row of a topic's planet, or none."""
        return lookup.by_key(self.table("planets"), self.slug(topic), "topic")

    def planet_dump(self, topic: str) -> str | None:
        name = self.slug(topic)
        row = context.planet_dumps(self.planet(topic), self.table("notes").where(F.col("topic") == name)).first()
        return row["text"] if row else None

    def briefing(self) -> DataFrame:
        return context.briefing(self.table("planets"))

    def search_nodes(self, query: str, limit: int = 10, raw: bool = False) -> DataFrame:
        """(id, score) of nodes, best first, by their index; ``raw``: a query as ``fulltext.parse`` reads it."""
        return self.node_index().search(query, limit, raw)

    def neighbors(self, note: int, depth: int = 1, min_weight: float = 0.0) -> DataFrame:
        links = self._milli().select(F.col("from_note_id").alias("from_id"), F.col("to_note_id").alias("to_id"), "weight_milli")
        return graph.weighted_neighbors(links, self.spark.createDataFrame([(note,)], "id long"), depth, round(1000 * min_weight))

    def subgraph(self, note: int, depth: int = 2, min_weight: float = 0.2) -> DataFrame:
        links = self._milli().select(F.col("from_note_id").alias("from_id"), F.col("to_note_id").alias("to_id"), "weight_milli")
        return graph.subgraph(links, self.spark.createDataFrame([(note,)], "id long"), depth, round(1000 * min_weight))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return search.search_all(self.table("planets"), self.table("notes"), self.table("nodes"), query, limit, self.node_index())

    def search_notes(self, topic: str = "", kind: str = "", query: str = "", tags: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
        return search.search_notes(self.table("notes"), self.slug(topic) if topic else "", kind, query, tags, limit)

    @_stores
    def agent_context(self, topic: str, query: str | None = None) -> str:
        row = context.agent_context(self.table("planets"), self.table("notes"), self.table("nodes"), self.slug(topic), query, index=self.node_index() if query else None).first()
        return row["text"] if row else f"# Knowledge Base Context\nTopic: {self.slug(topic)}\n\nNo stored context found for this topic yet."

    def compact_context(self, topic: str, query: str = "") -> str:
        """State, next step, open tasks, pins and facts of a topic; without a planet, topics that it may have meant."""
        name = self.slug(topic)
        own = [self.table(t).where(F.col("topic") == name) for t in ("planets", "notes", "tasks")]
        row = context.compact_texts(*own, query).first()
        return row["text"] if row else context.suggestions(self.table("planets"), name).first()["text"]

    def stats(self) -> DataFrame:
        return memory.memory_stats(*[self.table(n) for n in ("planets", "notes", "nodes", "edges")])

    # tasks

    @_stores
    def create_task(self, topic: str, title: str, priority: str = "medium", depends_on: list[int] | None = None, notes: list[int] | None = None) -> int:
        self.ensure_planet(topic)
        row = self.spark.createDataFrame([(topic, title, priority, depends_on or [], [], notes or [], 1)], "topic string, title string, priority string, depends_on array<long>, files array<string>, notes array<long>, ord int")
        self.store.write("tasks", memory.create_tasks(self.table("tasks"), row, self.now))
        return self.table("tasks").agg(F.max("id")).first()[0]

    @_stores
    def update_task(self, task: int, **change) -> None:
        self.store.write("tasks", memory.update_task(self.table("tasks"), task, self.now, **change))

    @_stores
    def block_task(self, task: int, reason: str = "") -> None:
        planets, notes, tasks = memory.block_task(self.table("planets"), self.table("notes"), self.table("tasks"), task, reason, self.now)
        self.store.write("tasks", tasks)
        self._save_notes(notes, planets)

    # code

    def index(self, root: str, project: str = "p") -> DataFrame:
        """Indexes all files below ``root``, in place of what was there; files that cannot be read are in ``code_failures``."""
        files = code_files.discover(self.spark, root)
        found = graph.cut(code_files.extract(files))
        symbols, edges = code_files.index_files(files, project, found)
        symbols = graph.cut(symbols)
        self.store.write("code_edges", code.resolve(symbols, edges))
        self.store.write("code_symbols", symbols)
        self.store.write("code_failures", code_files.failures(found).withColumnRenamed("path", "file_path"))
        return code.project_stats(self.table("code_symbols"), self.table("code_edges"))

    def symbol_index(self) -> TextIndex:
        return self._index("code_symbols", search.TextIndex, search.SYMBOL_TEXTS, "id", "long")

    def sync(self, root: str, project: str = "p") -> DataFrame:
        """Indexes the files whose content is not what the index has seen, and forgets deleted ones; (path, change) of each."""
        files = code_files.discover(self.spark, root)
        whole = files.select("path", F.sha2("content", 256).alias("hash"))
        seen = f"{self.store.root}/code_manifest"
        p, fs = self.store._path(seen)
        manifest = self.spark.read.parquet(seen) if fs.exists(p) else self.spark.createDataFrame([], "path string, hash string")
        changed = graph.cut(code_files.changed_files(files, graph.cut(manifest)))
        own = files.join(changed, "path", "left_semi")
        found = graph.cut(code_files.extract(own))
        symbols, edges = code_files.index_files(own, project, found)
        symbols = graph.cut(code_files.replace_files(self.table("code_symbols"), symbols, changed))
        self.store.write("code_edges", code.relink(symbols, code_files.replace_files(self.table("code_edges"), edges, changed)))
        self.store.write("code_symbols", symbols)
        self.store.write("code_failures", code_files.replace_files(self.table("code_failures"), code_files.failures(found).withColumnRenamed("path", "file_path"), changed))
        whole.write.mode("overwrite").parquet(seen)
        return changed

    # export and import

    def export(self, path: str, topic: str | None = None) -> None:
        names = ("planets", "notes", "note_links", "planet_links")
        stores.export_json(memory.export_tables(*[self.table(n) for n in names], self.slug(topic) if topic else None), path)

    def export_document(self, topic: str | None = None) -> str:
        """An export as one JSON text."""
        names = ("planets", "notes", "note_links", "planet_links")
        return documents.export_document(memory.export_tables(*[self.table(n) for n in names], self.slug(topic) if topic else None)).first()["document"]

    @_stores
    def import_document(self, path: str) -> dict:
        """Adds the rows with new keys of an export that is one document; (created, skipped) by table, and how many rows or documents could not be read."""
        files = self.spark.read.format("binaryFile").load(path).select("path", F.decode("content", "utf-8").alias("content"))
        tables = documents.read_export(files)
        errors = tables.pop("errors").count()
        return {**self._import(tables), "errors": errors}

    @_stores
    def archive_file(self, topic: str, agent_id: str, archive_id: str, *patterns: str) -> None:
        """Archives the newest transcript among the files that fit the globs; one that says nothing changes nothing."""
        said = documents.transcripts(documents.newest_file(self.spark, *patterns), topic).first()
        if said is not None:
            self.archive(topic, said["transcript"], agent_id, archive_id)

    @_stores
    def import_(self, path: str) -> dict[str, tuple[int, int]]:
        """Adds rows with new keys; (created, skipped) by table."""
        return self._import(stores.import_json(self.spark, path))

    def _import(self, tables: dict[str, DataFrame]) -> dict[str, tuple[int, int]]:
        counts = {}
        for name, df in tables.items():
            grown, n = memory.import_table(name, self.table(name), graph.cut(df))
            counts[name] = tuple(n.first())
            if name == "notes":
                self._save_notes(grown, self.table("planets"))
            else:
                self.store.write(name, grown)
        return counts


def link_rows(links: DataFrame, now: Column) -> DataFrame:
    """Derived links as rows of ``note_links``."""
    return links.select(
        "from_note_id", "to_note_id", F.lit("auto").alias("link_type"), (F.col("weight_milli") / 1000).alias("weight"), (F.col("confidence_milli") / 1000).alias("confidence"), F.lit("auto").alias("source"),
        now.alias("created_at"), now.alias("updated_at"))
