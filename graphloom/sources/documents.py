"""JSON of unknown shape: transcripts and exports that are one document, read as VARIANT.

A document may be an object with ``messages``, ``conversation`` or ``items``,
a bare list, or lines of one object each. What cannot be parsed gives a row
that says so; the rest goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES, migrate

#: Where a document's messages can be, in the order in which they count.
LISTS = ("messages", "conversation", "items")
TABLE_LISTS = ("planets", "notes", "note_links", "planet_links")


def newest_file(spark: SparkSession, *patterns: str) -> DataFrame:
    """(path, content) of the file that changed last among those that fit the globs; of equally new ones the last by path. Only that file's content is read."""
    files = None
    for pattern in patterns:
        own = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
        files = own if files is None else files.unionByName(own)
    last = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).first()
    if last is None:
        return spark.createDataFrame([], "path string, content string")
    return spark.read.format("binaryFile").load(last["path"]).select("path", F.decode("content", "utf-8").alias("content"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _said(v: Column) -> Column:
    """The text of a message: a string, an array of parts, or anything else as JSON."""
    out = F.lit("")
    for name in ("message", "text", "content"):  # the last one tried counts first
        value = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        parts = _list(v, f"$.{name}")
        pieces = F.filter(F.transform(parts, lambda p: F.coalesce(*[F.nullif(_text(p, f"$.{k}"), F.lit("")) for k in ("text", "input_text", "output_text")])), lambda t: t.isNotNull())
        said = F.when(kind.startswith("ARRAY"), F.array_join(pieces, "\n")).when(kind == "STRING", _text(v, f"$.{name}")).when(kind.isin("VOID", "BOOLEAN"), None).otherwise(F.to_json(value))
        out = F.coalesce(F.nullif(said, F.lit("")), out)
    return F.trim(out)


def _first(v: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(_text(v, f"$.{n}"), F.lit("")) for n in names])


def messages(files: DataFrame) -> DataFrame:
    """(path, at, shape, sender, said, time, error) of (path, content) transcripts, in the order of each file.

    shape: messages, conversation, items, list, object or lines. Of lines,
    only user and assistant rows count, and a ``payload`` of type message
    stands for its line. Messages without text are left out. A document or
    line that is no JSON gives one row with ``error``. Null and empty files
    give nothing.
    """
    body = files.select("path", F.trim(F.coalesce("content", F.lit(""))).alias("content")).where("content <> ''")
    several = F.size(F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != "")) > 1
    # The parser stops behind the first value, so a file of lines is told by its first line, which is a value of its own.
    alone = F.try_parse_json(F.regexp_extract("content", r"^[^\r\n]*", 0)).isNotNull()
    doc = body.withColumn("v", F.when(~(several & alone), F.try_parse_json("content")))
    whole = doc.where(F.col("v").isNotNull())
    shape, found = F.lit("object"), F.array("v")
    for name in reversed(LISTS):
        has = F.size(_list(F.col("v"), f"$.{name}")) > 0
        shape, found = F.when(has, name).otherwise(shape), F.when(has, _list(F.col("v"), f"$.{name}")).otherwise(found)
    bare = _list(F.col("v"), "$")
    listed = whole.select("path", F.when(bare.isNotNull(), "list").otherwise(shape).alias("shape"), F.when(bare.isNotNull(), bare).otherwise(found).alias("m"))
    rows = listed.select("path", "shape", F.posexplode("m").alias("at", "m"), F.lit(None).cast("string").alias("error"))
    # A line of its own is read by the same names as a message of a document, roles first.
    lines = doc.where(F.col("v").isNull() & several).select("path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line")).where(F.trim("line") != "").withColumn("m", F.try_parse_json("line"))
    inner = F.try_variant_get("m", "$.payload", "variant")
    message = F.when(_text(inner, "$.type") == "message", inner).otherwise(F.col("m"))
    spoken = lines.select("path", "at", F.lit("lines").alias("shape"), message.alias("m"), F.when(F.col("m").isNull(), F.concat(F.lit("no JSON: "), F.substring("line", 1, 80))).alias("error"), _first(F.col("m"), "timestamp").alias("_time"))
    broken = doc.where(F.col("v").isNull() & ~several).select("path", F.lit(0).alias("at"), F.lit("none").alias("shape"), F.col("v").alias("m"), F.concat(F.lit("no JSON: "), F.substring("content", 1, 80)).alias("error"), F.lit(None).cast("string").alias("_time"))
    every = rows.withColumn("_time", F.lit(None).cast("string")).unionByName(spoken).unionByName(broken)
    in_lines = F.col("shape") == "lines"
    sender = F.upper(F.coalesce(F.when(in_lines, _first(F.col("m"), "role", "sender", "type")).otherwise(_first(F.col("m"), "type", "role", "sender")), F.lit("unknown")))
    time = F.coalesce("_time", F.when(~in_lines, _first(F.col("m"), "timestamp", "created_at")), F.lit("unknown"))
    out = every.select("path", "at", "shape", sender.alias("sender"), _said(F.col("m")).alias("said"), time.alias("time"), "error")
    return out.where(F.col("error").isNotNull() | ((F.col("said") != "") & (~in_lines | F.col("sender").isin("USER", "ASSISTANT"))))


def transcripts(files: DataFrame, topic: str) -> DataFrame:
    """(path, transcript) of each file that holds messages, under the topic's name."""
    # Fixed value: the headings of an archive.
    block = F.concat(F.lit("\n\n--- ["), "time", F.lit("] "), "sender", F.lit(" ---\n"), "said")
    own = messages(files).where("error IS NULL").select("path", F.struct("at", block.alias("b")).alias("x"))
    return own.groupBy("path").agg(F.concat(F.lit(f"Full Archive of {topic}\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")).alias("transcript"))


def read_export(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of (path, content) exports that are one document each, and ``errors`` (path, what): documents and rows that cannot be read.

    Arrays may be JSON texts or lists, ids texts or numbers; absent columns
    get their defaults. Rows without their table's key are errors.
    """
    doc = files.select("path", F.try_parse_json("content").alias("v"), F.col("content"))
    errors = doc.where(F.col("v").isNull()).select("path", F.lit("no JSON").alias("what"))
    out: dict[str, DataFrame] = {}
    keys = {"planets": ("topic",), "notes": ("id", "topic", "content"), "note_links": ("from_note_id", "to_note_id"), "planet_links": ("from_planet_id", "to_planet_id")}
    for name in TABLE_LISTS:
        rows = doc.select("path", F.posexplode(_list(F.col("v"), f"$.{name}")).alias("_at", "r"))
        columns = []
        for field in TABLES[name].fields:
            kind = field.dataType.simpleString()
            value = F.try_variant_get("r", f"$.{field.name}", kind)
            if kind.startswith("array"):
                text = F.from_json(_text(F.col("r"), f"$.{field.name}"), kind)
                value = F.coalesce(value, text)
            columns.append(value.alias(field.name))
        tidy = rows.select("path", "_at", *columns)
        good = F.lit(True)
        for key in keys[name]:
            good = good & F.col(key).isNotNull()
        out[name] = migrate(name, tidy.where(good))
        errors = errors.unionByName(tidy.where(~good).select("path", F.concat(F.lit(f"{name} row "), F.col("_at").cast("string"), F.lit(" lacks its key")).alias("what")))
    return {**out, "errors": errors}


def export_document(tables: dict[str, DataFrame]) -> DataFrame:
    """(document): all tables of an export as one JSON text. The whole export is one value, so it is for exports that a person reads or another tool takes; ``export_json`` writes folders."""
    out = None
    for name in TABLE_LISTS:
        order = F.array_sort(F.collect_list(F.to_json(F.struct("*"))))
        own = tables[name].agg(F.concat(F.lit(f'"{name}": ['), F.array_join(order, ", "), F.lit("]")).alias(name))
        out = own if out is None else out.join(F.broadcast(own))  # one row each
    return out.select(F.concat(F.lit('{"version": 1, '), F.concat_ws(", ", *TABLE_LISTS), F.lit("}")).alias("document"))
