"""The full-text index: terms, query syntax, and writes that keep it equal to a fresh one."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import fulltext
from graphloom.operators.fulltext import TextIndex
from graphloom.operators.search import bm25

SCHEMA = "id string, title string, content string, keywords array<string>"


def rows_of(index, query, raw=True):
    return [r.id for r in index.search(query, raw=raw).orderBy("id").collect()]


def test_terms_are_the_same_on_both_sides(spark):
    slugs = ["Two  Words!", "-a-", "", None, "É x", "ABC_d"]
    made = [r.s for r in spark.createDataFrame(list(enumerate(slugs)), "i int, x string").orderBy("i").select(fn.slug(F.col("x")).alias("s")).collect()]
    assert made == [fn.slug_of(x) for x in slugs]
    texts = ["Café CRÈME", "foo_bar-baz", "Ünïcödé ñandú x2", "数学 и Язык", "éclair", "", None, "a.b,c!", "İstanbul ß"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(fn.terms(F.col("x")).alias("t")).collect()]
    assert got == [fn.query_terms(t) for t in texts]
    assert got[0] == ["cafe", "creme"] and got[1] == ["foo", "bar", "baz"] and got[4] == ["eclair"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [
        ("1", "graph weights", "the quick brown fox jumps", ["fox", "graph"]), ("2", "brown graph", "quick quick fox", ["other"]), ("3", "Fox", "a fox in the brown barn quick", None),
        ("4", None, "nothing here but quickly done", ["café au lait"]), ("5", "quick brown", None, []), ("6", "", "", None)]
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), ["title", "content", "keywords"])
    index.write(spark.createDataFrame(rows, SCHEMA))
    return index


@pytest.mark.parametrize("query, want", [
    ("quick", "1235"), ("quick*", "12345"), ("quick fox", "123"), ("quick OR nothing", "12345"), ("quick NOT brown", ""), ("quick NOT title : brown", "13"), ('"quick brown"', "15"), ('"brown fox"', "1"),
    ("quick + bro*", "15"), ("^quick", "25"), ("content : ^quick", "2"), ("{title keywords} : fox", "13"), ("- title : graph", "1"), ("title : (fox OR brown)", "235"), ("NEAR(fox brown, 2)", "13"), ("NEAR(fox brown, 1)", "1"),
    ("NEAR(quick fox, 0)", "2"), ('NEAR("brown barn" fox)', "3"), ("keywords : cafe", "4"), ("fox AND brown OR done", "1234"), ("fox AND (brown OR done)", "123"), ("done OR fox NOT graph", "34"), ('"--"', ""), ("title : content : fox", ""), ('"Qu""ick"', ""),
])
def test_query_syntax(index, query, want):
    assert "".join(rows_of(index, query)) == want


@pytest.mark.parametrize("query", ["", "AND fox", "fox AND", "(fox", "fox)", "nowhere : fox", "fox : ", "a.b", "NEAR(", "NEAR(a, x)", "NOT fox", "{title : fox", "'x'", "+", "*"])
def test_unreadable_queries(index, query):
    with pytest.raises(ValueError):
        index.search(query, raw=True)


def test_plain_searches_are_prefixes_and_never_fail(index):
    assert rows_of(index, "qui fo", raw=False) == ["1", "2", "3"] and rows_of(index, '(" AND', raw=False) == [] and index.search("  !").count() == 0


def test_writes_keep_the_index_equal_to_a_fresh_one(spark, tmp_path, monkeypatch):
    random.seed(4)
    words = "red green blue café fox foxes dog a1 b2".split()
    new = lambda i: (str(i), " ".join(random.choices(words, k=2)), " ".join(random.choices(words, k=random.randint(0, 6))), random.sample(words, 2))
    monkeypatch.setattr(fulltext, "MAX_SEGMENTS", 3)
    index, table = TextIndex(spark, str(tmp_path / "a"), ["title", "content", "keywords"]), {}
    for step in range(5):
        changed = [new(i) for i in random.sample(range(20), 6)] if step else [new(i) for i in range(16)]
        gone = random.sample(sorted(table), 2) if step else []
        twice = [(*changed[0][:1], "older text", "", None)]
        df = spark.createDataFrame([(*r, 1) for r in changed] + [(*r, 0) for r in twice] + [(None, "no key", "", None, 2)], SCHEMA + ", ord int")
        index.write(df, spark.createDataFrame([(g,) for g in gone], "id string") if gone else None)
        for g in gone:
            table.pop(g)
        table |= {r[0]: r for r in changed}
        fresh = TextIndex(spark, str(tmp_path / f"fresh{step}"), ["title", "content", "keywords"])
        fresh.write(spark.createDataFrame(list(table.values()), SCHEMA))
        assert index.statistics() == fresh.statistics()
        post = lambda x: sorted(map(str, x.postings().select("id", "col", "term", "positions", "length").collect()))
        a, b = set(post(index)), set(post(fresh))
        assert (a - b, b - a) == (set(), set()), step
        for query in ("red OR fox*", "green NOT blue"):
            assert sorted(index.search(query, raw=True).collect()) == sorted(fresh.search(query, raw=True).collect())
    assert len(index._segments()[1]) <= 4 and index._segments()[0].endswith("gen=2")
    docs = spark.createDataFrame([(k, " ".join([t, c, " ".join(w)])) for k, t, c, w in table.values()], "id string, x string")
    assert index.search("fo re", limit=5).collect() == bm25(docs, "id", ["x"], "fo re", 5).collect()


def test_a_write_adds_only_its_own_terms_and_a_search_reads_no_texts(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), ["title", "content", "keywords"])
    index.write(spark.createDataFrame([(str(i), f"word{i}", "common", None) for i in range(50)], SCHEMA))
    index.write(spark.createDataFrame([("7", "fresh", "common", None)], SCHEMA))
    own = spark.read.parquet(f"{index._segments()[0]}/seg=2/postings")
    assert {r.term for r in own.collect()} == {"fresh", "common"}
    plan = index.search("fresh", raw=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,fresh)" in plan and not re.search(r"content#|title#", plan)
    assert rows_of(index, "word7") == [] and rows_of(index, "word8") == ["8"]
    empty = TextIndex(spark, str(tmp_path / "b"), ["title"])
    empty.write(spark.createDataFrame([], SCHEMA))
    assert empty.search("a").count() == 0 and empty.statistics() == (0, 0)
