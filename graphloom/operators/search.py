"""Full-text, pattern and regular-expression search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, terms
from .fulltext import TextIndex


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, limit: int | None = None) -> DataFrame:
    """(id, score): rows with a term of every prefix in ``query``, best first.

    k1 = 1.2, b = 0.75; a prefix's frequency in a row is that of all its
    terms, idf is at least 1e-6. Scores are rounded to 6 digits; ties go to
    the smaller id. A query without word characters finds nothing.

    Terms are only split and filtered on the row; a posting leaves it just
    for a prefix of the query, so the shuffle carries hits, not the corpus.
    """
    words = query_terms(query)
    split = docs.select(F.col(key).alias("id"), terms(F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns])).alias("t"))
    if not words:
        return split.select("id", F.lit(0.0).alias("score")).where(F.lit(False))

    def with_prefix(prefix: str) -> Column:
        return F.size(F.filter("t", lambda t: t.startswith(prefix)))

    counts = F.array(*[F.struct(F.lit(i).alias("q"), with_prefix(p).alias("tf")) for i, p in enumerate(words)])
    rows = split.select("id", F.size("t").alias("length"), counts.alias("c"))
    marks = [F.sum(F.when(F.get("c", F.lit(i))["tf"] > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(words))]
    # One row of corpus statistics, joined on a constant key.
    stats = rows.agg(F.count("*").alias("N"), F.avg("length").alias("avg"), *marks).withColumn("_k", F.lit(1))
    hits = rows.where(reduce(lambda a, b: a & b, [F.get("c", F.lit(i))["tf"] > 0 for i in range(len(words))])).withColumn("_k", F.lit(1))

    def part(i: int) -> Column:
        tf, n = F.get("c", F.lit(i))["tf"], F.col(f"n{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("N") - n + 0.5) / (n + 0.5)))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("avg")))

    scored = hits.join(F.broadcast(stats), "_k").select("id", F.round(reduce(lambda a, b: a + b, [part(i) for i in range(len(words))]), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


#: What a search of nodes looks at.
NODE_TEXTS = ["title", "content", "keywords"]
SYMBOL_TEXTS = ["symbol_name", "signature", "docstring", "file_path", "symbol_type", "kind"]


def contains_any(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which a column holds ``query``, case aside; ``%`` and ``_`` in it stand for any characters and any one; null columns hold nothing."""
    low = query.lower()
    if set(low) & set("%_"):
        wide = "%" + low.replace("\\", "\\\\") + "%"
        return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).like(wide), F.lit(False)) for c in columns]))
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in columns]))


def search_all(planets: DataFrame, notes: DataFrame, nodes: DataFrame | None, query: str, limit: int | None = None, index: TextIndex | None = None) -> DataFrame:
    """(source, id, title) hits in planets, then notes, then nodes, sharing one budget of ``limit``; ``index``: that of the nodes, so that their texts are not scanned."""
    p = contains_any(planets, query, "topic", "display_topic", "goal", "current_state").select(F.lit(0).alias("rank"), F.lit("planet").alias("source"), F.col("id").cast("string").alias("id"), F.col("topic").alias("title"))
    n = contains_any(notes, query, "title", "content").select(F.lit(1).alias("rank"), F.lit("note").alias("source"), F.col("id").cast("string").alias("id"), F.col("title"))
    hits = p.unionByName(n)
    if nodes is not None:
        found = (index.search(query) if index is not None else bm25(nodes, "id", NODE_TEXTS, query)).select(F.col("id").cast("string").alias("id"))
        hits = hits.unionByName(nodes.select(F.col("id").cast("string").alias("id"), "title").join(found, "id", "left_semi").select(F.lit(2).alias("rank"), F.lit("node").alias("source"), "id", "title"))
    return (hits.orderBy("rank", "id").limit(limit) if limit else hits).select("source", "id", "title")


def search_notes(notes: DataFrame, topic: str = "", kind: str = "", query: str = "", tags: tuple[str, ...] = (), limit: int | None = 10) -> DataFrame:
    """Notes that fit all given filters, pinned and newest first."""
    out = notes
    if topic:
        out = out.where(F.col("topic") == topic)
    if kind:
        out = out.where(F.col("kind") == kind)
    if query:
        out = contains_any(out, query, "title", "content")
    for tag in tags:
        out = out.where(F.array_contains("tags", tag))
    return out.orderBy(F.desc("pinned"), F.desc("created_at"), F.desc("id")).limit(limit) if limit and limit > 0 else out


def regex_search(df: DataFrame, pattern: str, columns: list[str], order: list[str], limit: int = 0) -> DataFrame:
    """Rows of which any column fits the regular expression; an invalid one is an error when run."""
    out = df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns]))
    return out.orderBy(*order).limit(limit) if limit > 0 else out


def search_symbols(symbols: DataFrame, query: str, limit: int = 20, use_regex: bool = False, index: TextIndex | None = None) -> DataFrame:
    """Symbols by regular expression; or by a query as ``fulltext.parse`` reads it, best first, where there is an index, else by BM25; or, where that finds none or cannot be read, by substring."""
    if query.strip() in ("", ".", "*", "%"):
        return symbols.where(F.lit(False))
    if use_regex:
        return regex_search(symbols, query, SYMBOL_TEXTS, ["symbol_name", "id"], limit)
    try:
        ranked = index.search(query, limit, raw=True) if index is not None else bm25(symbols, "id", SYMBOL_TEXTS, query, limit)
        if ranked.limit(1).count():
            return symbols.join(ranked, "id")
    except ValueError:
        pass
    return contains_any(symbols, query.strip(), "symbol_name", "symbol_type", "kind").orderBy("symbol_name", "id").limit(limit)


def references(files: DataFrame, name: str, definitions: DataFrame | None = None, path: str = "path", text: str = "content") -> DataFrame:
    """(path, line, text) of every line that holds ``name``, without the lines (path, line) that define it."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    hits = lines.where(F.col("text").contains(name))
    return hits.join(definitions, ["path", "line"], "left_anti") if definitions is not None else hits


def rerank_prompt(notes: DataFrame, ids: list[int], query: str) -> DataFrame:
    """(prompt): the notes with these ids, in order, as numbered lines under the query."""
    line = F.concat(F.lit("note-"), F.col("id").cast("string"), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, 500))
    own = notes.where(F.col("id").isin(ids)).select(F.struct("id", line.alias("line")).alias("x"))
    return own.agg(F.concat(F.lit(f"Rank these by relevance to: {query}\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("prompt"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark's group limit drops most rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
