"""Context assembly: sections of ranked lines, gathered by topic and rendered to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import note_color, trim_text
from ..operators.fulltext import TextIndex
from ..operators.search import NODE_TEXTS, bm25

TAGS = {"decision": "dec", "issue": "iss", "fact": "fact"}


def _newest(notes: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("topic", *by).orderBy(F.desc("created_at"), F.desc("id"))
    return notes.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k)


def context_sections(planets: DataFrame, notes: DataFrame, query: str = "", keep: int = 8, activity: int = 6) -> DataFrame:
    """(topic, section, ord, line) of every topic: goal, state, steps, pinned, key notes, activity.

    The newest notes are shown, newest first; ``query`` narrows key notes.
    """
    head = [("goal", 10, trim_text(F.coalesce(F.when(F.col("goal") != "", F.col("goal")), F.lit("Not set.")), 300)), ("state", 20, trim_text(F.coalesce(F.when(F.col("current_state") != "", F.col("current_state")), F.lit("No current state recorded.")), 500))]
    rows = None
    for name, place, line in head:
        part = planets.select("topic", F.lit(name).alias("section"), F.lit(place * 1000).alias("ord"), line.alias("line"))
        rows = part if rows is None else rows.unionByName(part)
    # The last five steps, oldest first.
    steps = planets.select("topic", F.posexplode(F.slice("next_steps", F.greatest(F.lit(1), F.size("next_steps") - 4), 5)).alias("i", "s")).select("topic", F.lit("steps").alias("section"), (30_000 + F.col("i")).alias("ord"), trim_text(F.col("s"), 180).alias("line"))
    body = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("title"), F.lit(""))
    line = F.concat(F.lit("["), F.col("kind"), F.lit("] "), trim_text(body, 220))
    facts = notes.where("kind <> 'turn'")
    if query:
        facts = facts.where(F.lower("content").contains(query.lower()))
    pins = _newest(notes.where("pinned"), 100).select("topic", F.lit("pinned").alias("section"), (40_000 + F.col("ord")).alias("ord"), line.alias("line"))
    key = _newest(facts, keep).select("topic", F.lit("notes").alias("section"), (50_000 + F.col("ord")).alias("ord"), line.alias("line"))
    turn = F.concat(F.col("agent_id"), F.lit(": "), trim_text(F.coalesce("content", F.lit("")), 220))
    turns = _newest(notes.where("kind = 'turn'"), activity).select("topic", F.lit("activity").alias("section"), (60_000 + F.col("ord")).alias("ord"), turn.alias("line"))
    for part in (steps, pins, key, turns):
        rows = rows.unionByName(part)
    return rows


# The headings of a topic's context.
TITLES = {"goal": "## Goal", "state": "## Current State", "steps": "## Next Steps", "pinned": "## Pinned Notes", "notes": "## Key Notes", "activity": "## Recent Activity"}


def render(sections: DataFrame, planets: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """(topic, text): name and status of each topic, then its sections under their titles; goal and state stand as they are, other lines as items."""
    name: Column = F.create_map(*[F.lit(x) for kv in (titles or TITLES).items() for x in kv])
    line = F.when(F.col("section").isin("goal", "state"), F.col("line")).otherwise(F.concat(F.lit("- "), "line"))
    lines = sections.groupBy("topic", "section").agg(F.min("ord").alias("o"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    block = F.concat(F.element_at(name, F.col("section")), F.lit("\n"), F.col("body"))
    blocks = lines.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("o", block.alias("b")))).alias("x"))
    shown = F.coalesce(F.when(F.col("display_topic") != "", F.col("display_topic")), F.col("topic"))
    head = F.concat(F.lit("# Knowledge Base Context\nTopic: "), shown, F.lit("\nStatus: "), F.coalesce("status", F.lit("active")), F.lit("\n\n"))
    named = planets.select("topic", head.alias("head"))
    return blocks.join(named, "topic").select("topic", F.concat("head", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n")).alias("text"))


# What stands at the end of a topic's context.
INSTRUCTIONS = (
    "## Instructions\n- Use this memory before answering.\n- Prefer existing decisions unless the user asks to revisit them.\n"
    "- After answering, log durable updates back into the knowledge base."
)


def agent_context(planets: DataFrame, notes: DataFrame, nodes: DataFrame | None, topic: str | None, query: str | None = None, results: int = 5, index: TextIndex | None = None) -> DataFrame:
    """(topic, text) of one topic, or of all if it is None: its sections, the best nodes for ``query`` (found by ``index`` where that is given), the handoff and the instructions."""
    mine = planets.where(F.col("topic") == topic) if topic is not None else planets
    own = render(context_sections(mine, notes.where(F.col("topic") == topic) if topic is not None else notes), mine)
    line = F.concat(F.lit("- ["), F.col("node_type"), F.lit("] "), F.col("title"), F.lit(": "), trim_text(F.col("content"), 220))
    memories = F.lit(None).cast("string")
    if query and nodes is not None:
        best = index.search(query, results) if index is not None else bm25(nodes, "id", NODE_TEXTS, query, results)
        hits = best.join(nodes, "id")
        found = hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line")))), lambda x: x["line"]), "\n").alias("found"))
        own = own.join(F.broadcast(found))  # one row
        memories = F.when(F.col("found") != "", F.concat(F.lit("## Query-Relevant Memories\n"), "found"))
    left = mine.select("topic", F.when(F.col("handoff") != "", F.concat(F.lit("## Handoff\n"), trim_text(F.col("handoff"), 400))).alias("_handoff"))
    return own.join(left, "topic", "left").select("topic", F.concat_ws("\n\n", "text", memories, "_handoff", F.lit(INSTRUCTIONS)).alias("text"))


def planet_dumps(planets: DataFrame, notes: DataFrame, shown: int = 10, counted: int = 100) -> DataFrame:
    """(topic, text): all that a planet holds, and the first of its newest notes; ``counted``: how many notes it looks at."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("\u2014"))
    named = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(c, ", ")))
    title = F.concat(F.coalesce(F.nullif(F.col("display_topic"), F.lit("")), "topic"), F.lit(" | "), F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active")))
    newest = _newest(notes, counted).select("topic", F.struct("ord", F.concat(F.lit("    ["), F.substring("kind", 1, 4), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, 200)).alias("line")).alias("x"))
    said = newest.groupBy("topic").agg(F.count("*").alias("_n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, shown), lambda x: x["line"]), "\n").alias("_notes"))
    head = F.concat_ws(
        "\n", title, F.concat(F.lit("  goal: "), dash("goal")), F.concat(F.lit("  state: "), dash("current_state")), F.concat(F.lit("  next: "), dash("next_step")), named("steps", "next_steps"), named("files", "files"),
        named("cmds", "commands"), F.when(F.col("handoff") != "", F.concat(F.lit("  handoff: "), "handoff")), F.when(F.col("_n") > 0, F.concat(F.lit("  notes ("), F.col("_n").cast("string"), F.lit("):\n"), "_notes")))
    return planets.join(said, "topic", "left").select("topic", head.alias("text"))


def compact_context(notes: DataFrame, tasks: DataFrame, query: str = "", open_tasks: int = 5) -> DataFrame:
    """(topic, ord, line): open tasks (the first few and how many more), pins, and decisions, issues and facts that hold ``query``."""
    todo = tasks.where("status <> 'done'")
    order = Window.partitionBy("topic").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = todo.withColumns({"ord": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("topic"))})
    lines = ranked.where(F.col("ord") <= open_tasks).select("topic", F.col("ord"), F.concat(F.lit("task-"), F.col("id"), F.lit(" ["), "status", F.lit("/"), "priority", F.lit("] "), "title").alias("line"))
    more = ranked.where((F.col("ord") == 1) & (F.col("n") > open_tasks)).select("topic", F.lit(open_tasks + 1).alias("ord"), F.concat(F.lit("... and "), F.col("n") - open_tasks, F.lit(" more")).alias("line"))
    pins = _newest(notes.where("pinned"), 100).select("topic", (1000 + F.col("ord")).alias("ord"), F.concat(F.lit("pin: "), F.substring("content", 1, 300)).alias("line"))
    own = notes.where(F.col("kind").isin(*TAGS))
    if query:
        own = own.where(F.lower("content").contains(query.strip().lower()))
    name = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    facts = _newest(own, 100).select("topic", (2000 + F.col("ord")).alias("ord"), F.concat(F.element_at(name, F.col("kind")), F.lit(": "), F.substring("content", 1, 300)).alias("line"))
    return lines.unionByName(more).unionByName(pins).unionByName(facts)


def compact_texts(planets: DataFrame, notes: DataFrame, tasks: DataFrame, query: str = "") -> DataFrame:
    """(topic, text): state, next step, open tasks, pins and facts of each planet, a line each; of a topic a bounded number of lines."""
    shown = lambda c, name: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  {name}: "), c))
    head = F.concat_ws("\n", F.concat(F.lit("ctx: "), "topic"), shown("current_state", "state"), shown("next_step", "next"))
    n_open = tasks.where("status <> 'done'").groupBy("topic").agg(F.count("*").alias("n"))
    lines = compact_context(notes, tasks, query)
    title = n_open.select("topic", F.lit(0).alias("ord"), F.concat(F.lit("\n  tasks ("), "n", F.lit(" open):")).alias("line"))
    indent = F.when(F.col("ord") < 1000, "    ").otherwise("  ")
    body = lines.select("topic", "ord", F.concat(indent, "line").alias("line")).unionByName(title)
    joined = body.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return planets.select("topic", head.alias("head")).join(joined, "topic", "left").select("topic", F.concat_ws("\n", "head", "body").alias("text"))


def suggestions(planets: DataFrame, topic: str, limit: int = 5) -> DataFrame:
    """(text) for a topic without a planet: the first planets whose name holds it."""
    found = planets.where(F.col("topic").contains(topic)).select("topic").orderBy("topic").limit(limit)
    names = found.agg(F.array_join(F.array_sort(F.collect_list("topic")), ", ").alias("names"))
    return names.select(F.concat(F.lit(f"ctx: {topic}\n  state: (no context yet)"), F.when(F.col("names") != "", F.concat(F.lit("\n  (did you mean: "), "names", F.lit(")"))).otherwise("")).alias("text"))


def summaries(notes: DataFrame, limit: int = 50) -> DataFrame:
    """(topic, ord, line): the newest ``limit`` notes that are no summaries, oldest first."""
    own = _newest(notes.where("kind <> 'summary'"), limit)
    back = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("ord")))
    return own.select("topic", back.alias("place"), F.concat(F.lit("["), "kind", F.lit("] "), trim_text(F.col("content"), 400)).alias("line")).withColumnRenamed("place", "ord")


def nested_planets(planets: DataFrame, notes: DataFrame, limit: int = 50) -> DataFrame:
    """Planets with an array of their newest notes, newest first."""
    own = _newest(notes, limit).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "kind", "title", "content"))).alias("notes"))
    return planets.join(own, "topic", "left")


def graph_document(planets: DataFrame, notes: DataFrame, links: DataFrame, planet_links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for drawing: planets and notes; a contains edge to each note, and the links."""
    p = planets.select(F.concat(F.lit("planet-"), "topic").alias("id"), F.col("topic").alias("label"), F.lit("planet").alias("kind"), F.lit("#ffffff").alias("color"))
    n = notes.select(F.concat(F.lit("note-"), F.col("id")).alias("id"), F.substring(F.coalesce("title", "content"), 1, 60).alias("label"), "kind", note_color(F.col("kind")).alias("color"))
    whole = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1000).otherwise(F.col(c)).cast("long").alias(c)
    inside = notes.join(planets.select("topic"), "topic", "left_semi").select(F.concat(F.lit("planet-"), "topic").alias("source"), F.concat(F.lit("note-"), F.col("id")).alias("target"), F.lit("contains").alias("type"), F.lit(1000).cast("long").alias("weight_milli"))
    linked = links.select(F.concat(F.lit("note-"), F.col("from_note_id")).alias("source"), F.concat(F.lit("note-"), F.col("to_note_id")).alias("target"), F.lit("auto").alias("type"), whole("weight_milli"))
    edges = inside.unionByName(linked)
    if planet_links is not None:
        edges = edges.unionByName(planet_links.select(F.concat(F.lit("planet-"), "from_topic").alias("source"), F.concat(F.lit("planet-"), "to_topic").alias("target"), F.col("relation").alias("type"), F.lit(1000).cast("long").alias("weight_milli")))
    return p.unionByName(n), edges


# The headings of a planet's page, and what stands under those without content.
PAGE = (("## Goal", "Not set."), ("## Status", "active"), ("## Current State", "No current state recorded."), ("## Decisions", "- None"), ("## Open Issues", "- None"), ("## Next Steps", "- None"),
        ("## Important Files", "- None"), ("## Commands", "- None"), ("## Recent Activity", "- None"), ("## Agent Handoff", "Read this planet first. Open moons only when detailed transcript history is needed."))


def _tail(notes: DataFrame, name: str, line: Column, k: int = 8) -> DataFrame:
    """(topic, name): the newest k notes of each topic as lines, oldest first."""
    own = _newest(notes, k).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("o"), F.concat(F.lit("- "), line).alias("l")))).alias("x"))
    return own.select("topic", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias(name))


def planet_pages(planets: DataFrame, notes: DataFrame) -> DataFrame:
    """(topic, text): goal, status, state, last decisions and open issues, steps, files, commands, last activity and handoff of each planet."""
    from ..operators.lookup import open_issues

    body = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("title"), F.lit(""))
    turn = F.concat(F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit(" "), F.coalesce("agent_id", F.lit("unknown")), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = planets
    for name, own, line in (("_dec", notes.where("kind = 'decision'"), body), ("_iss", open_issues(notes), body), ("_act", notes.where("kind = 'turn'"), turn)):
        rows = rows.join(_tail(own, name, line), "topic", "left")
    items = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    parts = (F.col("goal"), F.col("status"), F.col("current_state"), F.col("_dec"), F.col("_iss"), items("next_steps"), items("files"), items("commands"), F.col("_act"), F.col("handoff"))
    blocks = [F.concat(F.lit(f"\n\n{title}\n"), F.coalesce(F.when(part != "", part), F.lit(other))) for (title, other), part in zip(PAGE, parts, strict=True)]
    return rows.select("topic", F.concat(F.lit("# Topic: "), F.col("topic"), *blocks).alias("text"))


def briefing(planets: DataFrame) -> DataFrame:
    """(topic, planet, status, preview, next): all planets, those touched last first, with the start of their goal and their last next step."""
    said = F.coalesce(F.when(F.col("goal") != "", F.col("goal")), F.col("current_state"), F.lit(""))
    newest = planets.orderBy(F.desc("updated_at"), F.desc("id"))
    return newest.select(
        F.coalesce(F.when(F.col("display_topic") != "", F.col("display_topic")), F.col("topic")).alias("topic"), F.concat(F.lit("planet-"), "topic").alias("planet"), F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("active")).alias("status"),
        F.trim(F.replace(F.substring(said, 1, 300), F.lit("\n"), F.lit(" "))).alias("preview"), F.get("next_steps", F.size("next_steps") - 1).alias("next"))
