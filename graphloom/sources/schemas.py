"""Schemas of the memory, graph and code tables, and migration of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<long>": T.ArrayType(T.LongType()), "array<float>": T.ArrayType(T.FloatType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """``name type, ...``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


PLANETS = _schema(
    "id long, topic string, display_topic string, status string, goal string, current_state string, next_step string, next_steps array<string>, files array<string>, "
    "commands array<string>, handoff string, aliases array<string>, memory_state string, created_at timestamp, updated_at timestamp")
NOTES = _schema(
    "id long, topic string, kind string, content string, title string, agent_id string, status string, turn_index int, created_at timestamp, updated_at timestamp, "
    "tags array<string>, pinned boolean")
NOTE_LINKS = _schema("from_note_id long, to_note_id long, link_type string, weight double, confidence double, source string, created_at timestamp, updated_at timestamp")
PLANET_LINKS = _schema("id long, from_planet_id long, to_planet_id long, relation string, weight double, created_at timestamp")
TASKS = _schema("id long, topic string, title string, status string, priority string, depends_on array<long>, files array<string>, notes array<long>, created_at timestamp, completed_at timestamp")
NODES = _schema(
    "id string, title string, content string, node_type string, keywords array<string>, embedding array<float>, weight double, created_at timestamp, last_accessed timestamp, "
    "decay_score double, metadata map<string,string>")
EDGES = _schema("from_id string, to_id string, edge_type string, weight double, confidence double, created_at timestamp, metadata map<string,string>")
CODE_SYMBOLS = _schema(
    "id long, project_id string, file_path string, symbol_name string, symbol_type string, language string, kind string, start_line int, end_line int, start_col int, end_col int, "
    "signature string, docstring string, parent_id long, content_hash string, created_at timestamp, updated_at timestamp")
CODE_EDGES = _schema("id long, project_id string, from_symbol_id long, to_symbol_id long, from_name string, to_name string, edge_type string, file_path string, line_number int, created_at timestamp")
CODE_PROJECTS = _schema("id string, root_path string, name string, file_count int, symbol_count int, last_indexed timestamp, created_at timestamp")

LINK_GAINS = _schema("from_note_id long, to_note_id long, gain_milli long, stream string, batch long")
CODE_FAILURES = _schema("file_path string, reason string")

TABLES = {
    "code_failures": CODE_FAILURES, "link_gains": LINK_GAINS,
    "planets": PLANETS, "notes": NOTES, "note_links": NOTE_LINKS, "planet_links": PLANET_LINKS, "tasks": TASKS, "nodes": NODES, "edges": EDGES,
    "code_symbols": CODE_SYMBOLS, "code_edges": CODE_EDGES, "code_projects": CODE_PROJECTS,
}
KEYS = {
    "planets": ["topic"], "notes": ["id"], "note_links": ["from_note_id", "to_note_id", "link_type"], "planet_links": ["from_planet_id", "to_planet_id", "relation"],
    "tasks": ["id"], "nodes": ["id"], "edges": ["from_id", "to_id", "edge_type"], "code_symbols": ["id"], "code_edges": ["id"], "code_projects": ["id"],
    "code_failures": ["file_path"], "link_gains": ["stream", "batch", "from_note_id", "to_note_id"],
}
NODE_TYPES = ("concept", "fact", "summary", "conversation", "task", "question", "example")
EDGE_TYPES = ("is_a", "part_of", "related_to", "causes", "depends_on", "contradicts", "derived_from")

# What a column holds where an older table lacks it or has null.
DEFAULTS = {
    ("notes", "pinned"): False, ("notes", "status"): "open", ("notes", "agent_id"): "default", ("notes", "turn_index"): 0,
    ("note_links", "confidence"): 1.0, ("note_links", "source"): "auto", ("note_links", "weight"): 1.0, ("note_links", "link_type"): "related",
    ("planets", "memory_state"): "hot", ("planets", "status"): "active", ("tasks", "status"): "todo", ("tasks", "priority"): "medium",
    ("planet_links", "relation"): "related", ("planet_links", "weight"): 1.0, ("nodes", "weight"): 1.0, ("nodes", "decay_score"): 1.0,
    ("edges", "weight"): 1.0, ("edges", "confidence"): 1.0, ("code_edges", "from_symbol_id"): 0, ("code_edges", "to_symbol_id"): 0,
}


def migrate(name: str, df: DataFrame) -> DataFrame:
    """The table in its present schema; columns that it lacks get their defaults. Applying it again changes nothing."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for field in TABLES[name].fields:
        default = DEFAULTS.get((name, field.name))
        if field.name.lower() in have:
            value = F.col(f"`{have[field.name.lower()]}`").cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        if default is not None:
            value = F.coalesce(value, F.lit(default).cast(field.dataType))
        elif isinstance(field.dataType, T.ArrayType) and field.name != "embedding":
            value = F.coalesce(value, F.array().cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def from_texts(name: str, df: DataFrame, allowed: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, refused) of rows whose columns are texts: arrays and maps as JSON, times in ISO form, numbers and booleans as written.

    What cannot be read becomes null, and arrays empty. ``allowed``: the values
    that columns can have; rows with another are refused, null ones are not.
    """
    out = []
    for field in TABLES[name].fields:
        if field.name not in df.columns:
            continue
        kind, text = field.dataType.simpleString(), F.col(field.name).cast("string")
        if kind.startswith(("array", "map")):
            value = F.from_json(text, kind)
        elif kind == "timestamp":
            value = F.try_to_timestamp(text)
        else:
            value = text.try_cast(kind)
        out.append(value.alias(field.name))
    rows = df.select(*out)
    good = F.lit(True)
    for column, values in (allowed or {}).items():
        good = good & F.coalesce(F.col(column).isin(*values), F.lit(True))
    return migrate(name, rows.where(good)), migrate(name, rows.where(~good))


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
