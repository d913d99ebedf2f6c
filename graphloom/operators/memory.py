"""Planets, notes, tasks and links: reads, and writes as functions from table states to table states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MEMORY_STATES, PRIORITIES, STATUSES, new_priority, note_kind, note_title, slug
from ..sources.schemas import KEYS, migrate
from .graph import FEW, cut, numbered

KEEP_NEWEST = 30
SUMMARIZE_AT = 50


# ---- merging by key


def _order(delta: DataFrame) -> Column:
    """What orders rows of one key: ``ord`` where there is such a column, then the rows' own texts, so that a batch run again keeps the same one."""
    return F.struct(*(["ord"] if "ord" in delta.columns else []), F.to_json(F.struct("*")))


def one_per_key(delta: DataFrame, keys: list[str], last: bool = True) -> DataFrame:
    """The last row of each key, or the first."""
    pick = F.max_by if last else F.min_by
    return delta.groupBy(*keys).agg(pick(F.struct("*"), _order(delta)).alias("_row")).select("_row.*")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same key; of several of one key the last (by ``ord``) stays."""
    one = one_per_key(delta, keys).drop(*({"ord"} - set(base.columns)))
    return base.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` whose key it lacks, the first (by ``ord``) of each."""
    one = one_per_key(delta.join(base.select(*keys), keys, "left_anti").select(*delta.columns), keys, last=False).drop(*({"ord"} - set(base.columns)))
    return base.unionByName(one, allowMissingColumns=True)


def patch(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with the non-null values of ``delta``, of each column the last (by ``ord``); keys that it lacks are ignored."""
    change = [c for c in delta.columns if c not in keys and c in base.columns]
    order = _order(delta)
    folded = delta.groupBy(*keys).agg(F.lit(True).alias("_hit"), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_new_{c}") for c in change])
    j = base.join(folded, keys, "left")
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in change else F.col(c) for c in base.columns])


def next_ids(base: DataFrame, delta: DataFrame, order: str, key: str = "id") -> DataFrame:
    """``delta`` with ids after the greatest of ``base``, in the order of a column, dealt out by its ranges."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top")).first()["_top"]
    return numbered(delta, order, "_rank").withColumn(key, (F.lit(top) + F.col("_rank")).cast("long")).drop("_rank")


def latest(df: DataFrame, order: str = "updated_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).limit(1)


# ---- notes and planets


def add_notes(planets: DataFrame, notes: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(planets, notes) after a batch of (topic, kind, content, title, agent_id, status, ord); topics that are new get planets."""
    tidy = batch.select(
        slug(F.col("topic")).alias("topic"), note_kind(F.col("kind")).alias("kind"), "content", note_title(F.col("title"), F.col("content")).alias("title"),
        F.coalesce("agent_id", F.lit("default")).alias("agent_id"), F.coalesce("status", F.lit("open")).alias("status"), now.alias("created_at"), now.alias("updated_at"), "ord")
    numbered = next_ids(notes, tidy, "ord").drop("ord")
    touched = tidy.select("topic").distinct()
    fresh = next_ids(planets, touched.join(planets.select("topic"), "topic", "left_anti"), "topic")
    fresh = migrate("planets", fresh.select("id", "topic", F.col("topic").alias("display_topic"), F.array("topic").alias("aliases"), now.alias("created_at"), now.alias("updated_at")))
    mark = touched.withColumn("updated_at", now)
    return patch(planets, mark, ["topic"]).unionByName(fresh), notes.unionByName(migrate("notes", numbered))


def ensure_planets(planets: DataFrame, topics: DataFrame, now: Column) -> DataFrame:
    """Planets with those of (topic, as written): new ones are added, known ones gain the name as an alias and are touched."""
    asked = topics.select(F.col("topic").alias("_said"), slug(F.col("topic")).alias("topic")).groupBy("topic").agg(F.array_sort(F.collect_set("_said")).alias("_names"))
    known = planets.join(asked, "topic", "left")
    every = F.array_sort(F.array_union(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.col("_names")), F.array("topic")))
    hit = F.col("_names").isNotNull()
    shown = F.when(F.coalesce("display_topic", F.lit("")) != "", F.col("display_topic")).otherwise(F.coalesce(F.get("_names", F.lit(0)), "display_topic"))
    change = {"aliases": F.when(hit, every).otherwise(F.col("aliases")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "display_topic": F.when(hit, shown).otherwise(F.col("display_topic"))}
    old = known.select(*[change[c].alias(c) if c in change else F.col(c) for c in planets.columns])
    fresh = next_ids(planets, asked.join(planets.select("topic"), "topic", "left_anti"), "topic")
    name = F.get("_names", F.lit(0))
    fresh = fresh.select(
        "id", "topic", name.alias("display_topic"), F.array_sort(F.array_union("_names", F.array("topic"))).alias("aliases"),
        F.concat(F.lit("Unified task context for: "), name).alias("current_state"), now.alias("created_at"), now.alias("updated_at"))
    return old.unionByName(migrate("planets", fresh).select(*planets.columns))


def link_planets(planets: DataFrame, links: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(links, refused) after a batch of (from_topic, to_topic, relation, weight, ord).

    refused: (ord, reason) of links to the same planet or to one that does not
    exist. The smaller id comes first; a link that is there already stays.
    """
    ids = planets.select("id", "topic")
    named = batch.select("ord", "relation", "weight", slug(F.col("from_topic")).alias("_a"), slug(F.col("to_topic")).alias("_b"))
    found = named.join(ids.select(F.col("topic").alias("_a"), F.col("id").alias("_ia")), "_a", "left").join(ids.select(F.col("topic").alias("_b"), F.col("id").alias("_ib")), "_b", "left")
    missing = lambda c: F.concat(F.lit("no planet "), F.col(c))
    judged = found.withColumn("reason", F.when(F.col("_a") == F.col("_b"), "a planet does not link to itself").when(F.col("_ia").isNull(), missing("_a")).when(F.col("_ib").isNull(), missing("_b")))
    good = judged.where("reason IS NULL").select(F.least("_ia", "_ib").alias("from_planet_id"), F.greatest("_ia", "_ib").alias("to_planet_id"), "relation", "weight", "ord")
    fresh = good.groupBy("from_planet_id", "to_planet_id", "relation").agg(F.min_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"))
    fresh = fresh.join(links.select("from_planet_id", "to_planet_id", "relation"), ["from_planet_id", "to_planet_id", "relation"], "left_anti")
    grown = migrate("planet_links", next_ids(links, fresh, "ord").withColumn("created_at", now))
    return migrate("planet_links", links).unionByName(grown), judged.where("reason IS NOT NULL").select("ord", "reason")


def log_interaction(planets: DataFrame, notes: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(planets, notes) after (topic, decision, fact, summary, current_state, next_step, activity, ord): a note for each part given, the planet's change and a turn."""
    kinds = (("decision", "decision"), ("fact", "fact"), ("summary", "summary"), ("turn", "activity"))
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("content"), F.lit(i).alias("i")) for i, (k, c) in enumerate(kinds)])
    rows = batch.select("topic", F.col("ord").alias("_o"), F.explode(F.filter(parts, lambda x: F.coalesce(x["content"], F.lit("")) != "")).alias("x"))
    none = F.lit(None).cast("string")
    agent = F.when(F.col("x.kind") == "turn", "system")
    new = rows.select("topic", F.col("x.kind").alias("kind"), F.col("x.content").alias("content"), none.alias("title"), agent.alias("agent_id"), none.alias("status"), (F.col("_o") * 4 + F.col("x.i")).alias("ord"))
    planets, notes = add_notes(planets, notes, new, now)
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).alias(c)
    change = batch.select("topic", none.alias("status"), none.alias("goal"), given("current_state"), none.alias("handoff"), given("next_step"), none.alias("file"), none.alias("command"), "ord")
    return update_planets(planets, change.where("current_state IS NOT NULL OR next_step IS NOT NULL"), now), notes


def archive_transcripts(planets: DataFrame, notes: DataFrame, nodes: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(planets, notes, nodes) after (topic, transcript, agent_id, archive_id, ord): a conversation node and a turn each; topics without a planet are left out."""
    own = batch.withColumn("topic", slug(F.col("topic"))).join(planets.select("topic"), "topic", "left_semi")
    node = own.select(
        F.col("archive_id").alias("id"), F.concat(F.lit("History ("), "agent_id", F.lit("): "), "topic").alias("title"), F.col("transcript").alias("content"), F.lit("conversation").alias("node_type"),
        F.array("topic", "agent_id", F.lit("archive"), F.lit("moon")).alias("keywords"), F.create_map(F.lit("topic"), F.col("topic"), F.lit("agent_id"), F.col("agent_id"), F.lit("scope"), F.lit("moon")).alias("metadata"), now.alias("created_at"))
    said = own.select("topic", F.lit("turn").alias("kind"), F.concat(F.lit("Archived moon "), "archive_id", F.lit(".")).alias("content"), F.lit("").alias("title"), "agent_id", F.lit(None).cast("string").alias("status"), "ord")
    planets, notes = add_notes(planets, notes, said, now)
    return planets, notes, upsert(nodes, migrate("nodes", node), ["id"])


def folder_hubs(nodes: DataFrame, folders: DataFrame, now: Column) -> DataFrame:
    """Nodes with a summary node for each of (folder), added where there is none; null folders are left out."""
    named = folders.where("folder IS NOT NULL").select("folder").distinct().withColumn("title", F.concat(F.lit("Session: "), "folder"))
    fresh = named.join(nodes.where("node_type = 'summary'").select("title"), "title", "left_anti")
    metadata = F.create_map(F.lit("is_folder_hub"), F.lit("true"), F.lit("folder"), F.col("folder"))
    rows = fresh.select(
        F.concat(F.lit("hub-"), "folder").alias("id"), "title", F.concat(F.lit("Global hub for project folder: "), "folder").alias("content"), F.lit("summary").alias("node_type"), metadata.alias("metadata"), now.alias("created_at"))
    return nodes.unionByName(migrate("nodes", rows))


def update_planets(planets: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Sparse changes of (topic, status, goal, current_state, handoff, next_step, file, command[, ord]).

    Of several changes of a topic, the last value that is given counts; next
    steps, files and commands all join their sorted sets.
    """
    sets, single = {"next_steps": "next_step", "files": "file", "commands": "command"}, ("status", "goal", "current_state", "handoff")
    named = changes.withColumn("topic", slug(F.col("topic")))
    order = _order(named)
    folded = named.groupBy("topic").agg(
        F.lit(True).alias("_hit"), *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in single],
        *[F.collect_set(F.when(F.col(c) != "", F.col(c))).alias(f"_{c}") for c in sets.values()])
    j = planets.join(folded, "topic", "left")
    out = []
    for c in planets.columns:
        if c in sets:
            out.append(F.when(F.size(f"_{sets[c]}") > 0, F.array_sort(F.array_union(F.coalesce(c, F.array().cast("array<string>")), f"_{sets[c]}"))).otherwise(F.col(c)).alias(c))
        elif c in single:
            out.append(F.coalesce(f"_{c}", c).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def delete_planet(topic: str, planets: DataFrame, notes: DataFrame, links: DataFrame, tasks: DataFrame, planet_links: DataFrame) -> dict[str, DataFrame]:
    """All tables without the topic, and without links and tasks that would dangle."""
    own = planets.where(F.col("topic") == topic).select("id")
    gone = notes.where(F.col("topic") == topic).select("id")
    return {
        "planets": planets.where(F.col("topic") != topic), "notes": notes.where(F.col("topic") != topic), "note_links": drop_dangling(links, gone, "from_note_id", "to_note_id"),
        "tasks": tasks.where(F.col("topic") != topic), "planet_links": drop_dangling(planet_links, own, "from_planet_id", "to_planet_id")}


def drop_dangling(links: DataFrame, gone: DataFrame, a: str, b: str) -> DataFrame:
    """Links without an end in ``gone``: (id)."""
    ids = gone.select(F.col("id").alias("_id"))
    return links.join(ids, F.col(a) == F.col("_id"), "left_anti").join(ids, F.col(b) == F.col("_id"), "left_anti")


def link(links: DataFrame, batch: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """Adds (a, b, kind, ...) with the smaller end first, unless there already; links to oneself are refused by leaving them out."""
    tidy = batch.where(F.col(a) != F.col(b)).withColumns({a: F.least(a, b), b: F.greatest(a, b)}).dropDuplicates([a, b, kind])
    return insert_ignore(links, tidy, [a, b, kind])


def _existing(notes: DataFrame, ids: list[int]) -> None:
    found = {r["id"] for r in notes.where(F.col("id").isin(ids)).select("id").distinct().collect()}
    if missing := sorted(set(ids) - found):
        raise ValueError(f"no such notes: {missing}")


def pin(notes: DataFrame, ids: list[int], pinned: bool = True) -> DataFrame:
    """The given notes pinned or not; an id without a note is an error."""
    _existing(notes, ids)
    return notes.withColumn("pinned", F.when(F.col("id").isin(ids), F.lit(pinned)).otherwise(F.col("pinned")))


def tag(notes: DataFrame, note: int, tags: list[str]) -> DataFrame:
    """The note with these tags in place of its own; an id without a note is an error."""
    _existing(notes, [note])
    return notes.withColumn("tags", F.when(F.col("id") == note, F.array(*[F.lit(t) for t in tags]).cast("array<string>")).otherwise(F.col("tags")))


def set_memory_state(planets: DataFrame, topic: str, state: str) -> DataFrame:
    if state not in MEMORY_STATES:
        raise ValueError(f"memory state is one of {', '.join(MEMORY_STATES)}")
    return planets.withColumn("memory_state", F.when(F.col("topic") == topic, state).otherwise(F.col("memory_state")))


def full_topics(notes: DataFrame, at: int = SUMMARIZE_AT) -> DataFrame:
    """(topic, n) of topics with so many notes that a summary is due."""
    return notes.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= at)


def compact_keep(notes: DataFrame, tasks: DataFrame, newest: int = KEEP_NEWEST) -> DataFrame:
    """The notes that compaction keeps: summaries, pinned ones, those of tasks that are not done, and the newest others of each topic."""
    held = tasks.where("status <> 'done'").select(F.explode("notes").alias("id")).distinct().withColumn("_held", F.lit(True))
    order = Window.partitionBy("topic", F.col("kind") == "summary").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = notes.join(held, "id", "left").withColumn("_rank", F.row_number().over(order))
    keep = (F.col("kind") == "summary") | F.col("pinned") | F.col("_held").isNotNull() | (F.col("_rank") <= newest)
    return ranked.where(keep).select(*notes.columns)


def compact_topic(topic: str, planets: DataFrame, notes: DataFrame, tasks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(planets, notes, links) after one topic is compacted; links to deleted notes go with them."""
    own = notes.where(F.col("topic") == topic)
    kept = compact_keep(own, tasks.where(F.col("topic") == topic))
    gone = own.select("id").join(kept.select("id"), "id", "left_anti")
    return set_memory_state(planets, topic, "compacted"), notes.where(F.col("topic") != topic).unionByName(kept), drop_dangling(links, gone, "from_note_id", "to_note_id")


# ---- tasks


def list_tasks(tasks: DataFrame, topic: str = "", status: str = "", priority: str = "") -> DataFrame:
    """Tasks that fit; unknown statuses and priorities filter nothing."""
    out = tasks.where(F.col("topic") == topic) if topic else tasks
    out = out.where(F.col("status") == status) if status in STATUSES else out
    return out.where(F.col("priority") == priority) if priority in PRIORITIES else out


def task_summary(tasks: DataFrame) -> DataFrame:
    """(topic, status, n, total): tasks by topic and status, and in the topic."""
    return tasks.groupBy("topic", "status").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("topic")))


def new_tasks(tasks: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The tasks of (topic, title, priority, depends_on, files, notes, ord), as they are added to ``tasks``; dependencies that do not exist are dropped, the rest sorted."""
    numbered = cut(next_ids(tasks, batch, "ord").withColumns({"topic": slug(F.col("topic")), "priority": new_priority(F.col("priority"))}))
    asked = numbered.select("id", F.explode("depends_on").alias("_dep"))
    wanted = asked.select("_dep").distinct()
    # A short list goes to the tasks, whose ids then stay where they are.
    wanted = F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted
    known = tasks.select(F.col("id").alias("_dep")).join(wanted, "_dep", "left_semi")
    deps = asked.join(known, "_dep", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("_dep")).alias("depends_on"))
    out = numbered.drop("depends_on", "ord").join(deps, "id", "left").withColumns({"status": F.lit("todo"), "created_at": now})
    return migrate("tasks", out)


def create_tasks(tasks: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """``tasks`` with those of a batch (``new_tasks``)."""
    return tasks.unionByName(new_tasks(tasks, batch, now))


def update_task(tasks: DataFrame, task: int, now: Column, status: str | None = None, priority: str | None = None, depends_on: list[int] | None = None, title: str | None = None, files: list[str] | None = None, notes: list[int] | None = None) -> DataFrame:
    """One task changed; files and notes are sorted and distinct. An unknown task or value, missing dependencies and cycles are errors; done sets completed_at, leaving it clears it."""
    from .graph import cycles

    if status is not None and status.lower() not in STATUSES:
        raise ValueError(f"status is one of {', '.join(STATUSES)}")
    if priority is not None and priority.lower() not in PRIORITIES:
        raise ValueError(f"priority is one of {', '.join(PRIORITIES)}")
    if depends_on:
        found = {r["id"] for r in tasks.where(F.col("id").isin(depends_on)).select("id").collect()}
        if missing := sorted(set(depends_on) - found):
            raise ValueError(f"no such tasks: {missing}")
        spark = tasks.sparkSession
        asked = spark.createDataFrame([(task, d) for d in depends_on], "id long, dep long")
        arcs = tasks.where(F.col("id") != task).select("id", F.explode("depends_on").alias("dep"))
        if cycles(arcs, asked).where("closes").limit(1).count():
            raise ValueError("the dependencies close a cycle")
    if tasks.where(F.col("id") == task).limit(1).count() == 0:
        raise ValueError(f"no task {task}")
    me = F.col("id") == task
    out = tasks
    for name, value in (("files", files), ("notes", notes)):
        if value is not None:
            kind = "string" if name == "files" else "long"
            array = F.array(*[F.lit(v).cast(kind) for v in sorted(set(value))]).cast(f"array<{kind}>")
            out = out.withColumn(name, F.when(me, array).otherwise(F.col(name)))
    if status is not None:
        s = status.lower()
        done = F.when(me, now if s == "done" else F.lit(None).cast("timestamp")).otherwise(F.col("completed_at"))
        out = out.withColumns({"completed_at": done, "status": F.when(me, s).otherwise(F.col("status"))})
    if priority is not None:
        out = out.withColumn("priority", F.when(me, priority.lower()).otherwise(F.col("priority")))
    if title is not None:
        out = out.withColumn("title", F.when(me, title).otherwise(F.col("title")))
    if depends_on is not None:
        array = F.array(*[F.lit(d).cast("long") for d in sorted(set(depends_on))]).cast("array<long>")
        out = out.withColumn("depends_on", F.when(me, array).otherwise(F.col("depends_on")))
    return out


def block_task(planets: DataFrame, notes: DataFrame, tasks: DataFrame, task: int, reason: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(planets, notes, tasks): the task is blocked; a reason becomes an issue note of its topic that the task refers to."""
    if reason:
        row = tasks.where(F.col("id") == task).select("topic", F.lit("issue").alias("kind"), F.lit(reason).alias("content"), F.concat(F.lit("Blocked: "), "title").alias("title"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("ord"))
        planets, grown = add_notes(planets, notes, row, now)
        new = grown.agg(F.max("id")).first()[0]
        tasks = tasks.withColumn("notes", F.when(F.col("id") == task, F.array_sort(F.array_distinct(F.array_append("notes", F.lit(new).cast("long"))))).otherwise(F.col("notes")))
        notes = grown
    return planets, notes, update_task(tasks, task, now, status="blocked")


# ---- export and import


def export_tables(planets: DataFrame, notes: DataFrame, links: DataFrame, planet_links: DataFrame, topic: str | None = None) -> dict[str, DataFrame]:
    """The four tables of an export; of one topic, its links are those with an end in it."""
    if topic:
        planets, notes = planets.where(F.col("topic") == topic), notes.where(F.col("topic") == topic)
        links = touching(links, notes.select("id"), "from_note_id", "to_note_id")
        planet_links = touching(planet_links, planets.select("id"), "from_planet_id", "to_planet_id")
    return {"planets": planets, "notes": notes, "note_links": links, "planet_links": planet_links}


def touching(links: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    """Links with either end in ``ids``: (id). One pass over the links; a short list of ids goes to them."""
    own = cut(ids.select(F.col("id").alias("_id")).distinct())
    own = F.broadcast(own) if own.count() <= FEW else own
    marked = links
    for end, name in ((a, "_first"), (b, "_second")):
        marked = marked.join(own, F.col(end) == F.col("_id"), "left").withColumnRenamed("_id", name)
    return marked.where("_first IS NOT NULL OR _second IS NOT NULL").drop("_first", "_second")


def import_table(name: str, base: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, counts): rows whose key is new are added; counts: one row of created and skipped."""
    tidy = migrate(name, incoming).dropDuplicates(KEYS[name])
    marked = tidy.join(base.select(*KEYS[name]).withColumn("_have", F.lit(True)), KEYS[name], "left")
    counts = marked.agg(F.count(F.when(F.col("_have").isNull(), 1)).alias("created"), F.count("_have").alias("skipped"))
    return insert_ignore(base, tidy, KEYS[name]), counts


def planet_links_named(links: DataFrame, planets: DataFrame) -> DataFrame:
    """Links of planets with the topics of both ends."""
    names = planets.select("id", "topic")
    out = links.join(names.select(F.col("id").alias("from_planet_id"), F.col("topic").alias("from_topic")), "from_planet_id")
    return out.join(names.select(F.col("id").alias("to_planet_id"), F.col("topic").alias("to_topic")), "to_planet_id")


def memory_stats(planets: DataFrame, notes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_name, n): rows of each table."""
    named = {"planets": planets, "notes": notes, "nodes": nodes, "edges": edges}
    out = None
    for name, df in named.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
