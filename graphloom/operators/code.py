"""Code-graph operators over symbols and name-resolved edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_of
from .graph import cut, deal, follow

# What dead-code analysis leaves out.
DYNAMIC_LANGUAGES = ("bash", "shell", "sh", "lua", "qml", "qmljs", "js")
IMPLICIT_NAMES = ("__init__", "id", "title", "content", "metadata", "__bool__")
#: Rows of a step that one task makes and tells apart.
ROWS = 2_000_000
ENTRY_PATHS = ("%/cli/%", "%/mcp/%", "%/watcher.py", "%/server.py", "%/tests/%", "tests/%")


def _page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Ordered, and cut where ``limit`` is positive."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit > 0 else out


def list_symbols(symbols: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return _page(symbols, ["file_path", "start_line", "id"], limit, offset)


def list_files(symbols: DataFrame, part: str = "", limit: int = 0) -> DataFrame:
    """(file_path, symbol_count, language) of files whose path holds ``part``."""
    own = symbols.where(F.col("file_path").contains(part)) if part else symbols
    out = own.groupBy("file_path").agg(F.count("*").alias("symbol_count"), F.max("language").alias("language"))
    return _page(out, ["file_path"], limit) if limit > 0 else out


def callers(symbols: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(to_name, id, symbol_name, file_path): distinct symbols that call each name (of ``names``: (to_name))."""
    calls = edges.where("edge_type = 'calls' AND from_symbol_id > 0").select("to_name", F.col("from_symbol_id").alias("id"))
    if names is not None:
        calls = calls.join(names, "to_name", "left_semi")
    return calls.join(symbols.select("id", "symbol_name", "file_path"), "id").select("to_name", "id", "symbol_name", "file_path").distinct()


def callees(symbols: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(symbol_name, file_path, to_name): distinct names that symbols of each name call."""
    own = symbols.join(names, "symbol_name", "left_semi") if names is not None else symbols
    calls = edges.where("edge_type = 'calls'").select(F.col("from_symbol_id").alias("id"), "to_name")
    return own.select("id", "symbol_name", "file_path").join(calls, "id").select("symbol_name", "file_path", "to_name").distinct()


def dead_code(symbols: DataFrame, edges: DataFrame, language: str = "", limit: int = 0) -> DataFrame:
    """Functions and methods whose name nothing calls, implicit names and entry points aside."""
    own = symbols.where(F.col("symbol_type").isin("function", "method") & ~F.col("symbol_name").isin(*IMPLICIT_NAMES))
    own = own.where(F.col("language") == language) if language else own.where(~F.col("language").isin(*DYNAMIC_LANGUAGES))
    for path in ENTRY_PATHS:
        own = own.where(~F.col("file_path").like(path))
    called = edges.where("edge_type = 'calls'").select(F.col("to_name").alias("symbol_name")).distinct()
    out = own.join(called, "symbol_name", "left_anti")
    return _page(out, ["file_path", "start_line", "id"], limit) if limit > 0 else out


def dead_exports(symbols: DataFrame, edges: DataFrame, limit: int = 0) -> DataFrame:
    """(file_path) of files that no other file calls into or imports.

    An import reaches a file if its dotted name begins with the file's module;
    the join is on all dotted prefixes of the import, so it stays an equi-join.
    """
    files = symbols.select("file_path").distinct().withColumn("module", module_of(F.col("file_path")))
    calls = edges.where("edge_type = 'calls'").select("to_name", F.col("file_path").alias("at"))
    called = symbols.select("file_path", F.col("symbol_name").alias("to_name")).distinct().join(calls.distinct(), "to_name").where("at <> file_path").select("file_path").distinct()
    parts = F.split("from_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    imports = edges.where("edge_type = 'imports' AND from_name <> ''").select(F.col("file_path").alias("at"), F.explode(prefixes).alias("module")).distinct()
    imported = files.join(imports, "module").where("at <> file_path").select("file_path").distinct()
    out = files.select("file_path").join(called.unionByName(imported).distinct(), "file_path", "left_anti")
    return _page(out, ["file_path"], limit) if limit > 0 else out


def impact(symbols: DataFrame, edges: DataFrame, names: DataFrame, depth: int = 2) -> DataFrame:
    """(name, depth, id, symbol_name, via): who calls each name, and who calls these, by name, to ``depth``.

    Distinct by (name, id, via) with the least depth.
    """
    arcs = cut(callers(symbols, edges).select(F.col("to_name").alias("src"), F.col("id").alias("dst"), "symbol_name").distinct())
    # Depths belong to pairs of a name and a name that is called, so only these are told apart; rows are made from them last, and not moved again.
    by_name = arcs.select("src", F.col("symbol_name").alias("dst")).distinct()
    seen = frontier = cut(names.select(F.col("to_name").alias("name"), F.col("to_name").alias("via"), F.lit(1).alias("depth")).distinct())
    dealt, heavy = deal(by_name) if depth > 1 else (None, None)
    for d in range(2, depth + 1):
        step = follow(frontier.select("name", F.col("via").alias("src")), dealt, heavy).select("name", F.col("dst").alias("via")).distinct()
        frontier = cut(step.join(seen, ["name", "via"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    rows, many = deal(arcs)
    return follow(seen.withColumnRenamed("via", "src"), rows, many).select("name", "depth", F.col("dst").alias("id"), "symbol_name", F.col("src").alias("via"))


def trace(edges: DataFrame, names: DataFrame, direction: str = "inbound", depth: int = 2) -> DataFrame:
    """(name, reached, depth): least depth of names met along calls (outbound) or against them (inbound)."""
    a, b = ("to_name", "from_name") if direction == "inbound" else ("from_name", "to_name")
    steps, heavy = deal(edges.where("edge_type = 'calls'").select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct())
    seen = cut(names.select("name", F.col("name").alias("reached"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for d in range(1, depth + 1):
        step = follow(frontier.select("name", F.col("reached").alias("src")), steps, heavy, ROWS).select("name", F.col("dst").alias("reached")).distinct()
        frontier = cut(step.join(seen, ["name", "reached"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def resolve(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are 0 get the least id of the symbol of that name, where there is one."""
    first = symbols.groupBy("symbol_name").agg(F.min("id").alias("_id"))
    out = edges.join(first.select(F.col("symbol_name").alias("to_name"), F.col("_id").alias("_to")), "to_name", "left")
    out = out.join(first.select(F.col("symbol_name").alias("from_name"), F.col("_id").alias("_from")), "from_name", "left")
    fill = lambda c, n: F.when(F.coalesce(c, F.lit(0)) == 0, F.coalesce(n, F.lit(0))).otherwise(F.col(c)).alias(c)
    rest = [c for c in edges.columns if c not in ("to_symbol_id", "from_symbol_id")]
    return out.select(*rest, fill("to_symbol_id", F.col("_to")), fill("from_symbol_id", F.col("_from")))


def relink(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``resolve`` after files changed: ends whose symbol is gone are looked for anew."""
    ids = symbols.select(F.col("id").alias("_id"))
    for column in ("to_symbol_id", "from_symbol_id"):
        met = edges.join(ids, F.col(column) == F.col("_id"), "left")
        edges = met.withColumn(column, F.when(F.col("_id").isNotNull(), F.col(column)).otherwise(0)).select(*edges.columns)
    return resolve(symbols, edges)


def project_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: symbol_count, file_count, edge_count."""
    zero = F.lit(0).cast("long")
    s = symbols.select(F.lit(1).cast("long").alias("s"), "file_path", zero.alias("e"))
    e = edges.select(zero.alias("s"), F.lit(None).cast("string").alias("file_path"), F.lit(1).cast("long").alias("e"))
    return s.unionByName(e).agg(F.coalesce(F.sum("s"), zero).alias("symbol_count"), F.countDistinct("file_path").alias("file_count"), F.coalesce(F.sum("e"), zero).alias("edge_count"))


def file_tree(paths: DataFrame) -> DataFrame:
    """(parent, name, files): every folder and file below its folder, with the number of files in it."""
    parts = F.split("file_path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), F.get(parts, n - 1).alias("name")))
    return paths.select("file_path").distinct().select(F.inline(steps)).groupBy("parent", "name").agg(F.count("*").alias("files"))


def normal_path(path: str) -> str:
    """A path below the project without empty, ``.`` and ``..`` parts; one that leaves the project is an error."""
    parts: list[str] = []
    for part in path.split("/"):
        if part == ".." and parts:
            parts.pop()
        elif part == "..":
            raise ValueError("the path leaves the project")
        elif part not in ("", "."):
            parts.append(part)
    if path.startswith("/") or not parts:
        raise ValueError("the path leaves the project")
    return "/".join(parts)


def read_lines(files: DataFrame, path: str, offset: int = 0, limit: int = 200) -> DataFrame:
    """(line, text) of one file, numbered from 1; paths that leave the project are refused."""
    wanted = normal_path(path)
    lines = files.where(F.col("path") == wanted).select(F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return lines.where((F.col("line") > offset) & (F.col("line") <= offset + limit))
