"""Streams of notes, accesses and file changes.

Each function maps a streaming (or static) DataFrame to another, so the
same plan runs on both; ``foreachBatch`` ones take the store they merge into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import code, similarity
from ..operators.graph import cut, shared_steps
from ..operators.memory import one_per_key
from ..sources import code_files
from ..sources.store import TableStore
from .folder_source import NAME, FolderChanges

DEBOUNCE = "2 seconds"


def debounce(events: DataFrame, gap: str = DEBOUNCE, ts: str = "ts", key: str = "project", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, paths by kind of change): bursts of changes that no pause as long as ``gap`` parts."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = out.groupBy(key, F.session_window(ts, gap))
    return grouped.agg(
        F.count("*").alias("n"),
        *[F.array_sort(F.collect_set(F.when(F.col("change") == c, F.col("path")))).alias(c) for c in ("created", "modified", "deleted")],
    ).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "created", "modified", "deleted")


def session_counts(events: DataFrame, gap: str, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed(events: DataFrame, width: str, slide: str | None = None, ts: str = "ts", by: str = "event_type", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) by tumbling or sliding windows."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return out.groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def distinct_events(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def note_counts(notes: DataFrame) -> DataFrame:
    """Running counts by topic (complete or update mode)."""
    return notes.groupBy("topic").agg(F.count("*").alias("n"))


def full_topic_alerts(notes: DataFrame, at: int = 50) -> DataFrame:
    return note_counts(notes).where(F.col("n") >= at)


def active_topic(planets: DataFrame) -> DataFrame:
    """The topic touched last."""
    return planets.agg(F.max_by("topic", F.struct("updated_at", "id")).alias("topic"))


def run_to_table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All of a stream's present input through a query; the state after its last micro-batch, as a table in the shared folder."""
    spark = df.sparkSession
    path, done = f"{shared_steps(spark)}/stream-{uuid.uuid4().hex}", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state/b={number}")
        done.append(number)

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:  # a stream without input has no batch
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/state/b={done[-1]}")


def link_new_notes(notes: DataFrame, store: TableStore, checkpoint: str, num: int = 1, den: int = 5) -> StreamingQuery:
    """Adds each micro-batch of notes to the store and links them with the notes of their topics that came before.

    The index of notes answers for the earlier ones, so work follows the
    batch; both tables only grow by what is new. A batch that runs again after
    a failure changes nothing: its notes are stored last, and until they are,
    it does the same once more.
    """
    index = similarity.NoteIndex(notes.sparkSession, f"{store.root}/index/notes")

    def merge(batch: DataFrame, _: int) -> None:
        if not index.exists():
            index.write(store.read("notes"))
        fresh = cut(one_per_key(batch, ["id"], last=False).join(store.read("notes").select("id"), "id", "left_anti"))
        if fresh.isEmpty():
            return
        index.write(fresh)
        new = index.links(fresh, num, den)
        none = F.lit(None).cast("timestamp")
        rows = new.select(
            "from_note_id", "to_note_id", F.lit("auto").alias("link_type"), (F.col("weight_milli") / 1000).alias("weight"), (F.col("confidence_milli") / 1000).alias("confidence"), F.lit("auto").alias("source"), none.alias("created_at"), none.alias("updated_at"))
        store.merge("note_links", cut(rows), "ignore")
        store.write("notes", fresh, append=True)

    return notes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reinforce_on_access(accesses: DataFrame, store: TableStore, checkpoint: str, step: float = 0.05, name: str = "accesses") -> StreamingQuery:
    """Adds a step to the weight of automatic links for each access, at most to 1.

    The table's version says which batch of the stream ``name`` it holds, so a
    batch that runs again adds nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if store.marks("note_links").get(name, -1) >= number:
            return
        links = store.read("note_links")
        scaled = links.withColumn("weight_milli", F.round(F.col("weight") * 1000).cast("long"))
        grown = similarity.reinforce(scaled, batch, int(step * 1000))
        store.write("note_links", grown.withColumn("weight", F.col("weight_milli") / 1000), marks={name: number})

    return accesses.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_changes(spark: SparkSession, root: str, listings: str) -> DataFrame:
    """A stream of (path, change, modified, content) of the source files below ``root``: created, modified and deleted ones; a moved file is deleted and created. Skipped folders are not entered."""
    spark.dataSource.register(FolderChanges)
    source = spark.readStream.format(NAME).option("listings", listings)
    return source.option("skip", ",".join(code_files.SKIP_DIRS)).option("extensions", ",".join(code_files.LANGUAGES)).load(root)


def apply_changes(store: TableStore, changes: DataFrame, project: str = "p") -> None:
    """The code tables after file changes (path, change, content): rows of changed files give way, those of deleted ones go, and names are looked for again in all files."""
    listed = cut(changes.select("path", "change", "content").withColumn("language", code_files.language_of(F.col("path"))))
    files = listed.where("change <> 'deleted' AND language IS NOT NULL")
    found = cut(code_files.extract(files))
    symbols, edges = code_files.index_files(files, project, found)
    symbols = cut(code_files.replace_files(store.read("code_symbols"), symbols, listed))
    store.write("code_edges", code.relink(symbols, code_files.replace_files(store.read("code_edges"), edges, listed)))
    store.write("code_symbols", symbols)
    store.write("code_failures", code_files.replace_files(store.read("code_failures"), code_files.failures(found).withColumnRenamed("path", "file_path"), listed))


def watch_files(spark: SparkSession, root: str, store: TableStore, checkpoint: str, project: str = "p") -> StreamingQuery:
    """Indexes files below ``root`` as they appear, change, move or go; a batch without changes does nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_changes(store, batch, project)

    changes = file_changes(spark, root, f"{checkpoint.rstrip('/')}-listings")
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
