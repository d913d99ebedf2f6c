"""Source files to symbols and edges.

Files are read by Spark's binary source. Python is parsed by its own parser
on the executors, one file a row; languages of braces by plans over tokens
(``brace_code``); others by regular expressions. A file that cannot be read
gives a row that says why, and the others go on.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .brace_code import BRACE_LANGUAGES, EXTRACTED, extract_braces

# Folders that are not searched, and languages by extension.
SKIP_DIRS = (
    "node_modules", "vendor", "dist", "build", "target", ".venv", "venv", ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".next",
    ".cache", "Pods", ".build", "coverage", ".tox", "eggs", "wheelhouse", ".mypy_cache", ".ruff_cache", ".terraform", ".serverless",
)
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "lua": "lua", "sh": "bash"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def discover(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, language[, content]) of source files below ``root``, skipped folders aside; path is relative to the root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    base = "/" + re.sub(r"^[a-z]+:/+", "/", root).strip("/") + "/"
    relative = F.when(tail.startswith(base), F.substring(tail, F.lit(len(base) + 1), F.length(tail))).otherwise(tail)
    out = found.withColumn("path", relative).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    out = out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in SKIP_DIRS])))
    return out.select("path", "language", "content") if content else out.select("path", "language")


def _failed(path: str, error: BaseException) -> tuple:
    return (path, "failure", type(error).__name__, "failure", None, None, None, None, str(error)[:200], None, None, None, None)


def _python(path: str, source: str) -> Iterator[tuple]:
    """Symbols (what: symbol) and edges (what: calls, imports) of a file, in the order of its text; of one that cannot be parsed, the failure."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        yield _failed(path, error)
        return
    lines = source.splitlines()
    edge = lambda what, name, at, target: (path, what, name, what, at.lineno, None, at.col_offset + 1, None, None, None, None, target, None)
    # (node, scope, class around): a stack, as trees can be deeper than calls.
    stack = [(child, "", None) for child in reversed(list(ast.iter_child_nodes(tree)))]
    while stack:
        node, scope, cls = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            if isinstance(node, ast.ClassDef):
                kind = "class"
            else:
                kind = ("async_" if isinstance(node, ast.AsyncFunctionDef) else "") + ("method" if cls is not None and scope == cls else "function")
            text = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            yield (path, "symbol", node.name, kind, node.lineno, node.end_lineno, node.col_offset + 1, (node.end_col_offset or 0) + 1, lines[node.lineno - 1].strip(), ast.get_docstring(node) or "", cls or "", None, hashlib.sha256(text.encode()).hexdigest()[:16])
            scope, cls = node.name, node.name if isinstance(node, ast.ClassDef) else cls
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                yield edge("calls", scope, node, name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield edge("imports", a.name, a, None)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield edge("imports", f"{node.module or ''}.{a.name}", a, None)
        stack += [(child, scope, cls) for child in reversed(list(ast.iter_child_nodes(node)))]


_GENERIC = re.compile(r"^[ \t]*(?:export\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|static\s+|async\s+|default\s+)*(function|fn|func|def|class|struct|enum|trait|interface|module)\s+([A-Za-z_]\w*)", re.M)
_IMPORT = re.compile(r"""^[ \t]*(?:import\s+(?:[^'"\n]*?from\s+)?['"]([^'"]+)['"]|use\s+([\w:]+)|import\s+([\w.]+))""", re.M)
_KINDS = {"fn": "function", "func": "function", "def": "function"}


def _generic(path: str, source: str) -> Iterator[tuple]:
    for m in _GENERIC.finditer(source):
        line = source.count("\n", 0, m.start(1)) + 1
        text = source[m.start(1) : source.find("\n", m.end()) if "\n" in source[m.end() :] else len(source)]
        yield (path, "symbol", m[2], _KINDS.get(m[1], m[1]), line, line, 1, len(text) + 1, text.strip(), "", "", None, hashlib.sha256(text.encode()).hexdigest()[:16])
    for m in _IMPORT.finditer(source):
        yield (path, "imports", m[1] or m[2] or m[3], "imports", source.count("\n", 0, m.start()) + 1, None, None, None, None, None, None, None, None)


def extract(files: DataFrame) -> DataFrame:
    """What (path, language, content) files hold: symbols, calls, imports and failures, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EXTRACTED.split(", ")]
        kinds = [pa.int32() if c.split()[1] == "int" else pa.string() for c in EXTRACTED.split(", ")]
        for batch in batches:
            rows = []
            for path, language, content in zip(*[batch.column(c).to_pylist() for c in ("path", "language", "content")], strict=True):
                source = (content or b"").decode("utf-8", "replace") if isinstance(content, (bytes, type(None))) else content
                try:
                    rows += list(_python(path, source) if language == "python" else _generic(path, source))
                except (RecursionError, MemoryError, ValueError) as error:
                    rows.append(_failed(path, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    braces = F.col("language").isin(*BRACE_LANGUAGES)
    own = files.select("path", "language", "content")
    return own.where(~braces).mapInArrow(run, EXTRACTED).unionByName(extract_braces(own))


def failures(found: DataFrame) -> DataFrame:
    """(path, reason) of the files that gave nothing."""
    return found.where("what = 'failure'").select("path", F.concat_ws(": ", "name", "signature").alias("reason"))


def index_files(files: DataFrame, project: str = "p", found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(code_symbols, code_edges) of files. Ids are stable: hashes of project, path, place and name; ends of other files are 0. ``found``: what ``extract`` gave for them."""
    found = extract(files) if found is None else found
    ident = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    s = found.where("what = 'symbol'").withColumn("id", ident(F.lit(project), F.col("path"), F.col("start_line"), F.col("start_col"), F.col("name")))
    s = s.join(files.select("path", "language"), "path")
    last = s.groupBy("path", "name").agg(F.max_by("id", F.struct("start_line", "id")).alias("_id"))
    parents = last.select("path", F.col("name").alias("parent"), F.col("_id").alias("parent_id"))
    symbols = s.join(parents, ["path", "parent"], "left").select(
        "id", F.lit(project).alias("project_id"), F.col("path").alias("file_path"), F.col("name").alias("symbol_name"), F.col("type").alias("symbol_type"), "language", F.col("type").alias("kind"),
        "start_line", "end_line", "start_col", "end_col", "signature", "docstring", "parent_id", "content_hash")
    e = found.where("what IN ('calls', 'imports')")
    own = last.select("path", F.col("name"), F.col("_id").alias("from_symbol_id"))
    to = last.select("path", F.col("name").alias("target"), F.col("_id").alias("to_symbol_id"))
    edges = e.join(own, ["path", "name"], "left").join(to, ["path", "target"], "left").select(
        ident(F.col("path"), F.col("start_line"), F.coalesce("start_col", F.lit(0)), F.col("name"), F.coalesce("target", F.lit("")), F.col("what")).alias("id"), F.lit(project).alias("project_id"), F.coalesce("from_symbol_id", F.lit(0)).alias("from_symbol_id"),
        F.coalesce("to_symbol_id", F.lit(0)).alias("to_symbol_id"), F.col("name").alias("from_name"), F.col("target").alias("to_name"), F.col("what").alias("edge_type"), F.col("path").alias("file_path"), F.col("start_line").alias("line_number"))
    return symbols, edges


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of the files in ``changed`` (path) give way to ``new``; deleted files have none there."""
    return old.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").unionByName(new, allowMissingColumns=True)


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change): files whose content hash is not in ``manifest`` (path, hash), and those that are gone."""
    now = files.select("path", F.sha2("content", 256).alias("hash"))
    j = now.join(manifest.withColumnRenamed("hash", "old"), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "created").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old"), "modified")
    return j.select("path", kind.alias("change")).where("change IS NOT NULL")


def page_symbols(pages: DataFrame) -> DataFrame:
    """(url, level, name) of the headings of HTML pages, tags inside left out."""
    found = F.expr(r"regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 0)")
    one = pages.select("url", F.explode(found).alias("x"))
    return one.select("url", F.regexp_extract("x", r"(?is)^<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace("x", r"(?is)<[^>]*>", ""), r"\s+", " ")).alias("name"))


def page_imports(pages: DataFrame) -> DataFrame:
    """(url, target, n): targets of the links of HTML pages, and how often."""
    found = F.expr("""regexp_extract_all(html, 'href="([^"]*)"', 1)""")
    return pages.select("url", F.explode(found).alias("target")).groupBy("url", "target").agg(F.count("*").alias("n"))


def transcript_turns(lines: DataFrame) -> DataFrame:
    """(role, content) of JSON-lines transcripts (value): user and assistant rows; content may be a text or an array of parts."""
    get = lambda *p: F.coalesce(*[F.get_json_object("value", x) for x in p])
    role = F.lower(get("$.role", "$.sender", "$.type", "$.payload.role", "$.payload.type"))
    raw = get("$.content", "$.text", "$.message", "$.payload.content", "$.payload.message")
    parts = F.from_json(raw, "array<struct<text:string>>")
    content = F.when(raw.startswith("["), F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")).otherwise(raw)
    return lines.select(role.alias("role"), F.trim(content).alias("content")).where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
