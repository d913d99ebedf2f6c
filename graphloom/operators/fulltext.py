"""Full-text search over an inverted index with positions, kept by the writes that change its rows.

An index is a folder of segments. A write adds one: the postings of the rows
it holds, each file sorted by term, and the keys it has changed or deleted; a posting
counts if no later segment names its key. A segment is there once its note is
written, so readers never meet half of one, and ``merge`` writes a new
generation beside the old. Queries read the ranges of their terms only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import query_terms, terms
from .graph import FEW, cut

#: Segments beyond which a write merges them.
MAX_SEGMENTS = 16
#: Keys up to so many are named in a filter that the scan can use; more are joined.
NAMED_KEYS = 500


# ---- queries


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; ``prefix``: the last one begins a term; ``first``: at the start of a column."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: frozenset[str] | None = None


@dataclass(frozen=True)
class Near:
    """Phrases of one column with at most ``gap`` terms between the end of the first and the start of the last."""

    phrases: tuple[Phrase, ...]
    gap: int = 10


@dataclass(frozen=True)
class Both:
    """AND, OR and NOT of two queries."""

    how: str
    left: object
    right: object


_MARKS = re.compile(r'"(?:[^"]|"")*"|[(){}:+*^,-]|[^\s(){}:+*^,"-]+|(\S)')


class _Words:
    """The marks of a query, read from left to right."""

    def __init__(self, text: str):
        self.marks, self.at = [], 0
        for m in _MARKS.finditer(text):
            if m[1]:
                raise ValueError(f"cannot read the query at {m.start()}")
            self.marks.append(m[0])

    def next(self) -> str | None:
        return self.marks[self.at] if self.at < len(self.marks) else None

    def take(self, *wanted: str) -> bool:
        if self.next() in wanted and self.next() is not None:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ValueError(f"the query lacks {mark}")


def parse(text: str, columns: list[str]):
    """A query of terms, "phrases", pre*, ^first, column : part, {a b} : part, - column : part, NEAR(a b, 5), a + b, AND, OR, NOT and brackets.

    NOT binds closer than AND, AND closer than OR; parts side by side are
    joined by AND before all of these. What cannot be read is a ValueError.
    """
    w = _Words(text)

    def either(cols) -> object:
        out = all_of(cols)
        while w.take("OR"):
            out = Both("or", out, all_of(cols))
        return out

    def all_of(cols) -> object:
        out = without(cols)
        while w.take("AND"):
            out = Both("and", out, without(cols))
        return out

    def without(cols) -> object:
        out = beside(cols)
        while w.take("NOT"):
            out = Both("not", out, beside(cols))
        return out

    def beside(cols) -> object:
        out = part(cols)
        while w.next() is not None and w.next() not in ("OR", "AND", "NOT", ")", "}", ",", "*", "+", ":"):
            out = Both("and", out, part(cols))
        return out

    def named() -> frozenset[str] | None:
        """Columns before a colon, if the next marks are that."""
        start, minus, found = w.at, w.take("-"), []
        if w.take("{"):
            while w.next() not in ("}", None):
                found.append(w.marks[w.at])
                w.at += 1
            w.need("}")
        elif w.next() is not None and w.at + 1 < len(w.marks) and w.marks[w.at + 1] == ":":
            found.append(w.marks[w.at])
            w.at += 1
        if not found or not w.take(":"):
            if minus or w.at != start:
                raise ValueError("columns are followed by a colon")
            return None
        names = {f.strip('"').lower() for f in found}
        known = {c.lower(): c for c in columns}
        if unknown := names - set(known):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return frozenset(c for low, c in known.items() if (low in names) != minus)

    def part(cols) -> object:
        own = named()
        if own is not None:
            return part(own if cols is None else own & cols)
        if w.take("("):
            out = either(cols)
            w.need(")")
            return out
        if w.next() == "NEAR" and w.at + 1 < len(w.marks) and w.marks[w.at + 1] == "(":
            w.at += 2
            phrases = []
            while w.next() not in (",", ")", None):
                phrases.append(phrase(cols))
            gap = 10
            if w.take(","):
                if not (w.next() or "").isdigit():
                    raise ValueError("NEAR takes a number")
                gap = int(w.marks[w.at])
                w.at += 1
            w.need(")")
            if not phrases:
                raise ValueError("NEAR takes phrases")
            return Near(tuple(phrases), gap)
        return phrase(cols)

    def phrase(cols) -> Phrase:
        first, words = w.take("^"), []
        while True:
            mark = w.next()
            if mark is None or mark in "(){}:+*^,-" or mark in ("AND", "OR", "NOT"):
                raise ValueError("the query lacks a term")
            if mark[0] != '"' and re.search(r"[^\w\x80-\U0010ffff]", mark):
                raise ValueError(f"{mark} needs quotation marks")
            w.at += 1
            words += query_terms(mark[1:-1].replace('""', '"') if mark[0] == '"' else mark)
            if not w.take("+"):
                break
        return Phrase(tuple(words), w.take("*"), first, cols)

    out = either(None)
    if w.next() is not None:
        raise ValueError(f"the query goes on after its end: {w.next()}")
    return out


def prefixes(text: str):
    """The query of rows that hold a term of every prefix in ``text``, or None if that has none."""
    words = query_terms(text)
    return reduce(lambda a, b: Both("and", a, b), [Phrase((t,), True) for t in words]) if words else None


def _phrases(query, wanted: bool = True) -> Iterator[Phrase]:
    """Phrases that add to the score: all but those after NOT."""
    if isinstance(query, Phrase):
        yield from [query] if wanted else []
    elif isinstance(query, Near):
        yield from query.phrases if wanted else []
    else:
        yield from _phrases(query.left, wanted)
        yield from _phrases(query.right, wanted and query.how != "not")


# ---- postings


def post(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, id, col, positions, length): where each term stands in each column, and how many terms the row has; array columns count as their texts in a row.

    A row is read whole in one task, so its postings are made there and nothing is moved.
    """
    kinds = dict(docs.dtypes)
    text = lambda c: F.array_join(F.col(f"`{c}`"), " ") if kinds[c].startswith("array") else F.col(f"`{c}`")
    split = docs.select(F.col(f"`{key}`").alias("id"), *[terms(text(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    out = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", split.schema["id"].dataType), T.StructField("col", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(batch.column(f"_{i}").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32) for i in range(len(columns)))
            for i, c in enumerate(columns):
                lists = batch.column(f"_{i}")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                named = lists.flatten().dictionary_encode()
                if not len(named):
                    continue
                doc, code = np.repeat(np.arange(len(size)), size), named.indices.to_numpy().astype(np.int64)
                at = (np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                both = doc * len(named.dictionary) + code
                order = np.argsort(both, kind="stable")
                first = np.flatnonzero(np.diff(both[order], prepend=-1))
                whose = doc[order[first]]
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(at[order]))
                yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(code[order[first]])), batch.column("id").take(pa.array(whose)), pa.array([c]).take(pa.array(np.zeros(len(first), np.int32))), places, pa.array(n[whose])], names=out.names)

    return split.mapInArrow(run, out)


def one_text(df: DataFrame, key: str) -> DataFrame:
    """Rows of keys that are not null, one a key: the last by ``ord``, where there is such a column, else the one of the greatest text.

    Only rows of keys that stand there several times are moved, unless these are many.
    """
    own, name = df.where(F.col(f"`{key}`").isNotNull()), F.col(f"`{key}`")
    several = cut(own.groupBy(name.alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    n = several.limit(FEW + 1).count()
    if not n:
        return own
    order = F.struct(*(["ord"] if "ord" in df.columns else []), F.to_json(F.struct("*")))
    some = own.join(F.broadcast(several), name == F.col("_key"), "left_semi") if n <= FEW else own
    last = some.groupBy(name.alias("_key")).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")
    return own.join(F.broadcast(several), name == F.col("_key"), "left_anti").unionByName(last) if n <= FEW else last


@dataclass
class TextIndex:
    """A stored index of ``columns`` of rows with a unique ``key`` (of type ``kind``)."""

    spark: SparkSession
    path: str
    columns: list[str]
    key: str = "id"
    kind: str = "string"

    def _fs(self, text: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, name: str, mark: str) -> list[int]:
        p, fs = self._fs(folder)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(f[len(name) :]) for f in found if f.startswith(name) and f[len(name) :].isdigit() and fs.exists(self._fs(f"{folder}/{f}/{mark}")[0]))

    def _note(self, folder: str, mark: str, text: str) -> None:
        p, fs = self._fs(f"{folder}/{mark}")
        out = fs.create(p, True)
        out.write(text.encode())
        out.close()

    def _read_note(self, folder: str, mark: str) -> dict:
        p, fs = self._fs(f"{folder}/{mark}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _generation(self) -> str | None:
        have = self._numbers(self.path, "gen=", "whole")
        return f"{self.path}/gen={have[-1]}" if have else None

    def _segments(self) -> tuple[str, list[int]]:
        gen = self._generation()
        if gen is None:
            gen = f"{self.path}/gen=1"
            self._note(gen, "whole", "{}")
        return gen, self._numbers(gen, "seg=", "note")

    def exists(self) -> bool:
        return self._generation() is not None

    def statistics(self) -> tuple[int, int]:
        """(rows, terms) of the index."""
        gen, have = self._segments()
        notes = [self._read_note(f"{gen}/seg={n}", "note") for n in have]
        return sum(n["rows"] for n in notes), sum(n["terms"] for n in notes)

    def _schema(self, names: str) -> T.StructType:
        fields = {"term": "string", "id": self.kind, "col": "string", "positions": "array<int>", "length": "int", "live": "boolean", "seg": "int"}
        return T._parse_datatype_string(", ".join(f"{n} {fields[n]}" for n in names.split()))

    def _table(self, what: str, gen: str, segments: list[int], names: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self._schema(names))
        own = [f"{gen}/seg={n}/{what}" for n in segments]
        read = self.spark.read.schema(self._schema(names.replace(" seg", ""))).parquet(*own)
        return read.withColumn("seg", F.regexp_extract(F.col("_metadata.file_path"), r"/seg=([0-9]+)/", 1).cast("int")).select(*names.split())

    def _changed(self, gen: str, segments: list[int]) -> DataFrame | None:
        """(id, last): the last segment that names each key, of keys that a later segment than the first names."""
        if len(segments) < 2:
            return None
        later = self._table("docs", gen, segments[1:], "id length live seg")
        return later.groupBy("id").agg(F.max("seg").alias("last"))

    def _valid(self, rows: DataFrame, gen: str, segments: list[int]) -> DataFrame:
        changed = self._changed(gen, segments)
        if changed is None:
            return rows
        return rows.join(changed, "id", "left").where(F.col("seg") >= F.coalesce("last", "seg")).drop("last")

    def _lengths(self, ids: DataFrame, gen: str, segments: list[int]) -> tuple[int, int]:
        """(rows, terms) of the rows among ``ids`` that the index holds."""
        docs = self._table("docs", gen, segments, "id length live seg")
        some = [r[0] for r in ids.limit(NAMED_KEYS + 1).collect()]
        own = docs.where(F.col("id").isin(some)) if len(some) <= NAMED_KEYS else docs.join(ids, "id", "left_semi")
        newest = own.groupBy("id").agg(F.max_by(F.struct("length", "live"), "seg").alias("x"))
        return tuple(newest.where("x.live").agg(F.count("*"), F.coalesce(F.sum("x.length"), F.lit(0))).first())

    def _post(self, rows: DataFrame) -> DataFrame:
        return post(rows, self.key, self.columns)

    def _sizes(self, rows: DataFrame, posted: DataFrame) -> DataFrame:
        """(id, length) of all rows, by the postings written for them: texts are not read again."""
        have = posted.where(F.get("positions", F.lit(0)) == 0).groupBy("id").agg(F.max("length").alias("length"))
        ids = rows.select(F.col(f"`{self.key}`").cast(self.kind).alias("id"))
        return ids.join(have, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length"))

    def write(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Indexes ``rows`` in place of earlier ones of their keys, and forgets the keys in ``gone`` (id). Of rows of one key the last counts (``ord``); null keys are left out."""
        gen, have = self._segments()
        number = (have[-1] if have else 0) + 1
        place = f"{gen}/seg={number}"
        parts, kind = [], self.kind
        if rows is not None:
            one = one_text(rows, self.key)
            # Postings stay in the parts of their rows, each sorted by term: a term that all rows hold is in no one's file alone.
            tasks = self.spark.sparkContext.defaultParallelism
            spread = one if one.select(F.spark_partition_id()).distinct().count() >= tasks else one.repartition(tasks, F.col(f"`{self.key}`"))
            self._post(spread).withColumn("id", F.col("id").cast(kind)).sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{place}/postings")
            docs = self._sizes(one, self.spark.read.schema(self._schema("term id col positions length")).parquet(f"{place}/postings"))
            parts.append(docs.select(F.col("id").cast(kind).alias("id"), "length", F.lit(True).alias("live")))
        else:
            self.spark.createDataFrame([], self._schema("term id col positions length")).write.mode("overwrite").parquet(f"{place}/postings")
        if gone is not None:
            lost = gone.select(F.col("id").cast(kind).alias("id")).where("id IS NOT NULL").distinct()
            if parts:
                lost = lost.join(parts[0].select("id"), "id", "left_anti")
            parts.append(lost.select("id", F.lit(0).alias("length"), F.lit(False).alias("live")))
        if not parts:
            return
        reduce(DataFrame.unionByName, parts).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{place}/docs")
        own = self.spark.read.schema(self._schema("id length live")).parquet(f"{place}/docs")
        new = own.agg(F.count(F.when(F.col("live"), 1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        old = (0, 0) if not have else self._lengths(own.select("id"), gen, have)
        self._note(place, "note", json.dumps({"rows": new[0] - old[0], "terms": new[1] - old[1]}))
        if len(have) + 1 > MAX_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """All segments as one of a new generation; the generation before stays for those who read it."""
        gen, have = self._segments()
        rows, words = self.statistics()
        number = int(gen.rpartition("=")[2]) + 1
        place = f"{self.path}/gen={number}/seg=1"
        posted = self._valid(self._table("postings", gen, have, "term id col positions length seg"), gen, have)
        posted.drop("seg").select("term", "id", "col", "positions", "length").repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{place}/postings")
        docs = self._valid(self._table("docs", gen, have, "id length live seg"), gen, have).where("live")
        docs.select("id", "length", "live").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{place}/docs")
        self._note(place, "note", json.dumps({"rows": rows, "terms": words}))
        self._note(f"{self.path}/gen={number}", "whole", "{}")
        for old in self._numbers(self.path, "gen=", "whole")[:-2]:
            p, fs = self._fs(f"{self.path}/gen={old}")
            fs.delete(p, True)

    def postings(self) -> DataFrame:
        """(term, id, col, positions, length) as they count now."""
        gen, have = self._segments()
        return self._valid(self._table("postings", gen, have, "term id col positions length seg"), gen, have).drop("seg")

    def postings_of(self, wanted: DataFrame) -> DataFrame:
        """The postings of the terms in ``wanted`` (term); few ones are named in the scan's filter."""
        some = [r[0] for r in wanted.limit(NAMED_KEYS + 1).collect()]
        posted = self.postings()
        return posted.where(F.col("term").isin(some)) if len(some) <= NAMED_KEYS else posted.join(wanted, "term", "left_semi")

    def search(self, query: str, limit: int | None = None, raw: bool = False) -> DataFrame:
        """(id, score), best first, of what ``query`` asks for: a term of each of its prefixes, or with ``raw`` a query as ``parse`` reads it."""
        asked = parse(query, self.columns) if raw else prefixes(query)
        if asked is None:
            return self.spark.createDataFrame([], f"id {self.kind}, score double")
        n, words = self.statistics()
        out = score(self.postings(), asked, n, words)
        return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


# ---- matching


def _places(posted: DataFrame, term: str, prefix: bool, columns: frozenset[str] | None) -> DataFrame:
    """(id, col, p, length): where a term, or any term of a prefix, stands."""
    own = posted.where(F.col("term").startswith(term) if prefix else F.col("term") == term)
    if columns is not None:
        own = own.where(F.col("col").isin(*columns))
    if prefix:
        own = own.groupBy("id", "col", "length").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    return own.select("id", "col", F.col("positions").alias("p"), "length")


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _spans(places: str, size: int) -> Column:
    """(end, start) of phrases of ``size`` terms."""
    return F.transform(places, lambda x: F.struct((x + size).alias("end"), x.alias("start")))


def _starts(posted: DataFrame, phrase: Phrase) -> DataFrame:
    """(id, col, p, length): where a phrase begins. A phrase without terms stands nowhere."""
    if not phrase.terms:
        return posted.select("id", "col", F.col("positions").alias("p"), "length").where(F.lit(False))
    out, last = None, len(phrase.terms) - 1
    for i, term in enumerate(phrase.terms):
        own = _places(posted, term, phrase.prefix and i == last, phrase.columns)
        if out is None:
            out = own
            continue
        shifted = own.select("id", "col", _moved("p", i).alias("_q"))
        out = out.join(shifted, ["id", "col"]).select("id", "col", F.array_intersect("p", "_q").alias("p"), "length").where(F.size("p") > 0)
    return out.where(F.array_contains("p", 0)).withColumn("p", F.array(F.lit(0))) if phrase.first else out


def _near(posted: DataFrame, near: Near) -> DataFrame:
    """(id) of rows where the phrases stand close together in one column."""
    out = None
    for phrase in near.phrases:
        own = _starts(posted, phrase).select("id", "col", _spans("p", len(phrase.terms)).alias("_n"))
        if out is None:
            out = own.withColumnRenamed("_n", "s")
            continue
        # Of every choice of places: the first end and the last start, while no more than the gap is between them.
        met = F.flatten(F.transform("s", lambda a: F.transform("_n", lambda b: F.struct(F.least(a["end"], b["end"]).alias("end"), F.greatest(a["start"], b["start"]).alias("start")))))
        fit = F.array_distinct(F.filter(met, lambda x: x["start"] - x["end"] <= near.gap))
        out = out.join(own, ["id", "col"]).select("id", "col", fit.alias("s")).where(F.size("s") > 0)
    return out.select("id").distinct()


def match(posted: DataFrame, query) -> DataFrame:
    """(id) of the rows that ``query`` fits."""
    if isinstance(query, Phrase):
        return _starts(posted, query).select("id").distinct()
    if isinstance(query, Near):
        return _near(posted, query)
    left, right = match(posted, query.left), match(posted, query.right)
    if query.how == "or":
        return left.unionByName(right).distinct()
    return left.join(right, "id", "left_semi" if query.how == "and" else "left_anti")


def rank_part(tf: Column, hold: Column, length: Column, rows: int, words: int) -> Column:
    """The part of BM25 of one phrase: k1 = 1.2, b = 0.75, the rarity at least 1e-6."""
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(rows)) - hold + 0.5) / (hold + 0.5)))
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / F.lit(words / max(rows, 1))))


def score(posted: DataFrame, query, rows: int, words: int) -> DataFrame:
    """(id, score): rows that fit, by the sum of their phrases' parts, rounded to 6 digits."""
    each = None
    for i, phrase in enumerate(_phrases(query)):
        own = _starts(posted, phrase).groupBy("id").agg(F.sum(F.size("p")).alias("tf"), F.first("length").alias("length")).withColumn("q", F.lit(i))
        each = own if each is None else each.unionByName(own)
    held = each.groupBy("q").agg(F.count("*").alias("hold"))
    # One row a phrase of the query.
    parts = each.join(F.broadcast(held), "q").select("id", F.struct("q", rank_part(F.col("tf"), F.col("hold"), F.col("length"), rows, words).alias("s")).alias("x"))
    summed = parts.groupBy("id").agg(F.count("*").alias("_k"), F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda a, x: a + x["s"]).alias("score"))
    # Where all phrases are wanted, their number tells what fits.
    fits = summed.where(F.col("_k") == len(list(_phrases(query)))) if _all_wanted(query) else summed.join(match(posted, query), "id", "left_semi")
    return fits.select("id", F.round("score", 6).alias("score"))


def _all_wanted(query) -> bool:
    return isinstance(query, Phrase) or (isinstance(query, Both) and query.how == "and" and _all_wanted(query.left) and _all_wanted(query.right))
