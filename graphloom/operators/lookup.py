"""Point reads, lists and file searches: filters that reach the Parquet scan, and bounded listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROWSE_FILES = 100


def by_key(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of a key (a node, note, symbol or task), or none."""
    return df.where(F.col(key) == value)


def get_edges(edges: DataFrame, from_id=None, to_id=None) -> DataFrame:
    """Edges with the given ends; without any, all."""
    for column, value in (("from_id", from_id), ("to_id", to_id)):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def symbols_by_name(symbols: DataFrame, name: str, file_path: str = "") -> DataFrame:
    """Symbols of a name, in one file if that is given; ambiguous names give several rows."""
    own = symbols.where(F.col("symbol_name") == name)
    return own.where(F.col("file_path") == file_path) if file_path else own


def filter_symbols(symbols: DataFrame, symbol_type: str = "", file_path: str = "") -> DataFrame:
    """To be applied before a search and its limit, so that a limit never hides what fits."""
    for column, value in (("symbol_type", symbol_type), ("file_path", file_path)):
        if value:
            symbols = symbols.where(F.col(column) == value)
    return symbols


def list_planets(planets: DataFrame) -> DataFrame:
    """Planets, those touched last first."""
    return planets.orderBy(F.desc("updated_at"), F.desc("id"))


def open_issues(notes: DataFrame) -> DataFrame:
    """Issues and questions that are not done; a null status is not done."""
    return notes.where(F.col("kind").isin("issue", "question") & (F.coalesce("status", F.lit("open")) != "done"))


def numeric_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Rows whose text is a whole number, with that number; others are left out."""
    return df.where(F.col(column).rlike(r"^-?[0-9]+$")).withColumn(name, F.expr(f"try_cast(`{column}` AS bigint)")).where(F.col(name).isNotNull())


def browse_files(symbols: DataFrame, limit: int = BROWSE_FILES) -> DataFrame:
    """(file_path, n, symbol_type): symbols by file and the greatest of their types, the first files by path."""
    return symbols.groupBy("file_path").agg(F.count("*").alias("n"), F.max("symbol_type").alias("symbol_type")).orderBy("file_path").limit(limit)


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob that fits a path or its end after a slash; ``**/`` fits any folders, ``*`` and ``?`` no slash."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif c == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out, at = out + f"[{'^' + body[1:] if body[0] == '!' else body}]", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return f"^(?:.*/)?{out}$"


def glob_files(files: DataFrame, pattern: str, limit: int | None = None, path: str = "path") -> DataFrame:
    """Files whose path fits the glob, by path."""
    out = files.where(F.col(path).rlike(glob_regex(pattern))).orderBy(path)
    return out.limit(limit) if limit else out


def grep(files: DataFrame, pattern: str, glob: str = "", limit: int = 100, path: str = "path", text: str = "content") -> DataFrame:
    """(path, line, text, more): the first ``limit`` lines that fit a regular expression, by path and line, and how many others do."""
    own = glob_files(files, glob, path=path) if glob else files
    lines = own.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    hits = lines.where(F.col("text").rlike(pattern))
    total = hits.agg(F.greatest(F.lit(0), F.count("*") - limit).alias("more"))
    return hits.orderBy("path", "line").limit(limit).join(F.broadcast(total))


def payload_stats(planets: DataFrame, notes: DataFrame) -> DataFrame:
    """(planets, notes): how many a graph payload has; one row each, so the join is of single rows."""
    return planets.agg(F.count("*").alias("planets")).join(F.broadcast(notes.agg(F.count("*").alias("notes"))))


def similarity_prompt(notes: DataFrame, a: int, b: int) -> DataFrame:
    """(prompt) with both notes; no row unless both exist."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("\nTitle: "), "title")).otherwise("")
    block = F.concat(F.lit("--- note-"), F.col("id").cast("string"), F.lit(" ("), "topic", F.lit("/"), "kind", F.lit(") ---"), title, F.lit("\n"), F.coalesce("content", F.lit("")))
    own = notes.where(F.col("id").isin(a, b)).select(F.struct("id", block.alias("b")).alias("x"))
    # Fixed value: the request under the notes.
    request = "\n\nAgent: decide a similarity score (0-1) and call link_notes with weight=<score>."
    both = own.agg(F.array_sort(F.collect_list("x")).alias("x")).where(F.size("x") == 2)
    return both.select(F.concat(F.array_join(F.transform("x", lambda x: x["b"]), "\n"), F.lit(request)).alias("prompt"))
