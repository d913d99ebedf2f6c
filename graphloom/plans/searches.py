"""Queries of the full-text index: the syntax of queries, and searches after writes, with the SQL that each must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph
from ..operators.fulltext import TextIndex
from ..operators.search import NODE_TEXTS
from ..sources import fixtures as fx
from ..sources.fixtures import ctes
from .queries import query

_FLAT = "SELECT id, col, unnest(tok) AS term, generate_subscripts(tok, 1) - 1 AS pos FROM (SELECT id, col, regexp_extract_all(strip_accents(lower(body)), '[\\p{L}\\p{N}]+') AS tok FROM src) WHERE len(tok) > 0"
NODES_SQL = "src AS (SELECT id, 'title' AS col, title AS body FROM {0} UNION ALL SELECT id, 'content', content FROM {0} UNION ALL SELECT id, 'keywords', array_to_string(keywords, ' ') FROM {0})"
NODE_TERMS = f"WITH {ctes('nodes')}, {NODES_SQL.format('nodes')}, t AS ({_FLAT})"
DOC_TERMS = f"WITH src AS (SELECT doc_id AS id, 'text' AS col, text AS body FROM documents), t AS ({_FLAT})"


def phrase_sql(*terms: str, prefix: bool = False, first: bool = False, columns: tuple[str, ...] = ()) -> str:
    """(id, col, pos, stop) of a phrase, by joining positions."""
    fits = [f"starts_with(t{i}.term, '{x}')" if prefix and i == len(terms) - 1 else f"t{i}.term = '{x}'" for i, x in enumerate(terms)]
    joins = "".join(f" JOIN t t{i} ON t{i}.id = t0.id AND t{i}.col = t0.col AND t{i}.pos = t0.pos + {i}" for i in range(1, len(terms)))
    more = (["t0.pos = 0"] if first else []) + ([f"t0.col IN ({', '.join(repr(c) for c in columns)})"] if columns else [])
    return f"SELECT t0.id, t0.col, t0.pos, t0.pos + {len(terms)} AS stop FROM t t0{joins} WHERE {' AND '.join(fits + more)}"


def ranked_sql(head: str, total: str, found: str, phrases: list[str]) -> str:
    """(id, score) of the rows in ``found`` (SQL of ids), by the parts of the phrases."""
    each = " UNION ALL ".join(f"SELECT id, {i} AS q, count(*) AS tf FROM ({p}) GROUP BY id" for i, p in enumerate(phrases))
    return f"""{head}, n AS (SELECT (SELECT count(*) FROM {total}) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM {total}) AS avg), len AS (SELECT id, count(*) AS dl FROM t GROUP BY id), e AS ({each}), h AS (SELECT q, count(*) AS hold FROM e GROUP BY q)
SELECT e.id, round(sum(greatest(1e-6, ln((n - hold + 0.5) / (hold + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 6) AS score FROM e JOIN h USING (q) JOIN len USING (id), n WHERE e.id IN ({found}) GROUP BY e.id"""


def _index(s, columns: list[str], key: str = "id", kind: str = "string") -> TextIndex:
    return TextIndex(s, f"{graph.shared_steps(s)}/index-{uuid.uuid4().hex}", columns, key, kind)


def _nodes(s, d, text: str):
    index = _index(s, NODE_TEXTS)
    index.write(fx.nodes(s, d))
    return index.search(text, raw=True)


def _documents(s, d, text: str):
    index = _index(s, ["text"], "doc_id", "long")
    index.write(fx.table(s, d, "documents"))
    return index.search(text, raw=True)


_RED, _BLUE, _GEAR = phrase_sql("red"), phrase_sql("blue"), phrase_sql("ge", prefix=True)


@query(ranked_sql(NODE_TERMS, "nodes", f"(SELECT id FROM ({_RED}) UNION SELECT id FROM ({_BLUE})) EXCEPT SELECT id FROM ({_GEAR})", [_RED, _BLUE]))
def fts_or_not(s, d):
    return _nodes(s, d, "(red OR blue) NOT ge*")


@query(ranked_sql(NODE_TERMS, "nodes", f"SELECT id FROM ({phrase_sql('cold', 'bolt')}) UNION (SELECT id FROM ({phrase_sql('old')}) INTERSECT SELECT id FROM ({phrase_sql('economy')}))", [phrase_sql("cold", "bolt"), phrase_sql("old"), phrase_sql("economy")]))
def fts_phrase_precedence(s, d):
    """AND binds closer than OR, and parts side by side are one AND."""
    return _nodes(s, d, '"Cold BOLT" OR old economy')


@query(ranked_sql(NODE_TERMS, "nodes", f"SELECT id FROM ({phrase_sql('brand', '1', prefix=True, columns=('content',))}) INTERSECT SELECT id FROM ({phrase_sql('small', first=True, columns=('title', 'keywords'))})", [phrase_sql("brand", "1", prefix=True, columns=("content",)), phrase_sql("small", first=True, columns=("title", "keywords"))]))
def fts_columns_first(s, d):
    return _nodes(s, d, 'content : brand + 1* AND - content : ^ small')


_DE, _LA, _QUE = phrase_sql("de"), phrase_sql("la"), phrase_sql("que")


@query(ranked_sql(DOC_TERMS, "documents", f"SELECT a.id FROM ({_DE}) a JOIN ({_LA}) b ON a.id = b.id AND a.col = b.col JOIN ({_QUE}) c ON a.id = c.id AND a.col = c.col WHERE greatest(a.pos, b.pos, c.pos) - least(a.stop, b.stop, c.stop) <= 3", [_DE, _LA, _QUE]))
def fts_near_documents(s, d):
    return _documents(s, d, "NEAR(de la que, 3)")


@query(ranked_sql(DOC_TERMS, "documents", f"SELECT id FROM ({phrase_sql('of', 'the')}) INTERSECT SELECT id FROM ({phrase_sql('and', 't', prefix=True)})", [phrase_sql("of", "the"), phrase_sql("and", "t", prefix=True)]))
def fts_phrases_documents(s, d):
    return _documents(s, d, '"of the" AND "and t" *')


@query(ranked_sql(f"""WITH {ctes('nodes')}, now AS (SELECT id, CASE WHEN node_type = 'ECONOMY' THEN 'Café ' || title ELSE title END AS title, content, keywords FROM nodes WHERE node_type <> 'SMALL' UNION ALL SELECT 'n' || id, title, content, ['red', 'café'] FROM nodes WHERE node_type = 'LARGE'),
  {NODES_SQL.format('now')}, t AS ({_FLAT})""", "now", f"SELECT id FROM ({phrase_sql('red')}) INTERSECT SELECT id FROM ({phrase_sql('cafe')})", [phrase_sql("red"), phrase_sql("cafe")]))
def fts_after_writes(s, d):
    """Rows are added, changed and deleted, each write a segment of its own; the search is that of the rows as they are then."""
    nodes, index = fx.nodes(s, d), _index(s, NODE_TEXTS)
    index.write(nodes)
    index.write(nodes.where("node_type = 'ECONOMY'").withColumn("title", F.concat(F.lit("Café "), "title")), nodes.where("node_type = 'SMALL'").select("id"))
    index.write(nodes.where("node_type = 'LARGE'").withColumns({"id": F.concat(F.lit("n"), "id"), "keywords": F.array(F.lit("red"), F.lit("café"))}))
    return index.search("RED cafe", raw=True)
