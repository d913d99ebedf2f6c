"""Queries of batches with repeated keys, of links by index, of documents and code of unknown shape, and of whole contexts, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import code, graph, lookup, memory, search, similarity
from ..sources import brace_code, documents, fixtures as fx
from ..sources.fixtures import ctes
from ..sources.schemas import empty, from_texts, migrate
from . import context
from .lookups import _now
from .queries import IMPORTS_SQL, MILLI, PAIR_SQL, TOKEN_SQL, query


@query(f"WITH {ctes('doc_planets')} SELECT topic, 'last' AS current_state, 'a,b,review ' || topic AS steps, 1 AS planets, (SELECT count(*) FROM doc_notes n WHERE n.topic = p.topic) + 3 AS notes FROM doc_planets p")
def interactions_of_one_topic(s, d):
    """Three interactions of each topic in one batch."""
    notes = migrate("notes", fx.doc_notes(s, d))
    planets = graph.cut(migrate("planets", fx.planets_of(fx.doc_notes(s, d))))
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(state).alias("current_state"), F.lit(step).alias("next_step")) for i, (state, step) in enumerate((("first", "b"), ("last", "a"), ("", "b")))])
    rows = planets.select("topic", "id", F.inline(parts))
    batch = rows.select("topic", F.lit("go").alias("decision"), F.lit("").alias("fact"), F.lit("").alias("summary"), "current_state", "next_step", F.lit("").alias("activity"), (F.col("id") * 10 + F.col("i")).alias("ord"))
    after, grown = memory.log_interaction(planets, notes, batch, _now())
    counted = grown.groupBy("topic").agg(F.count("*").alias("notes"))
    own = after.groupBy("topic").agg(F.max("current_state").alias("current_state"), F.max(F.array_join("next_steps", ",")).alias("steps"), F.count("*").cast("int").alias("planets"))
    return own.join(counted, "topic")


@query(f"""WITH {ctes('nodes')} SELECT id, CASE WHEN node_type = 'ECONOMY' THEN 'new ' || title ELSE title END AS title, 'replaced' AS how FROM nodes
UNION ALL SELECT id, title, 'kept' FROM nodes UNION ALL SELECT 'x' || id, 'old ' || title, 'kept' FROM nodes WHERE node_type = 'ECONOMY' UNION ALL SELECT id, CASE WHEN node_type = 'ECONOMY' THEN 'new ' || title ELSE title END, 'patched' FROM nodes""")
def repeated_keys(s, d):
    """Every key of the batch twice: the last row replaces and patches, the first one is inserted."""
    n = fx.nodes(s, d).select("id", "title", "node_type")
    some = n.where("node_type = 'ECONOMY'")
    twice = some.withColumns({"title": F.concat(F.lit("old "), "title"), "ord": F.lit(1)}).unionByName(some.withColumns({"title": F.concat(F.lit("new "), "title"), "ord": F.lit(2)}))
    parts = {"replaced": memory.upsert(n, twice, ["id"]), "kept": memory.insert_ignore(n, twice.withColumn("id", F.concat(F.lit("x"), "id")).unionByName(twice), ["id"]), "patched": memory.patch(n, twice, ["id"])}
    out = [df.select("id", "title", F.lit(how).alias("how")) for how, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {ctes('turn_notes')}, {TOKEN_SQL.format(notes='turn_notes')}, {PAIR_SQL} SELECT hit.topic, a AS from_note_id, b AS to_note_id, inter, uni, {MILLI} AS weight_milli FROM hit JOIN turn_notes n ON n.id = b WHERE inter * 20 >= uni AND n.kind <> 'question'")
def links_by_index(s, d):
    """Notes arrive in three batches and look for earlier ones through the index alone; questions are stored as turns here, which are found but do not look."""
    notes = fx.turn_notes(s, d).withColumn("kind", F.when(F.col("kind") == "question", "turn").otherwise(F.col("kind")))
    index = similarity.NoteIndex(s, f"{graph.shared_steps(s)}/index-{uuid.uuid4().hex}")
    out = None
    for low, high in ((0, 2), (3, 4), (5, 999)):
        batch = notes.where(F.col("turn_index").between(low, high))
        index.write(batch)
        new = graph.cut(index.links(batch, 1, 20))
        out = new if out is None else out.unionByName(new)
    return out.select("topic", "from_note_id", "to_note_id", "inter", "uni", "weight_milli")


@query("""WITH c AS (SELECT conv_id, turn, role, text, conv_id % 5 AS k FROM conversations)
SELECT conv_id, ['messages', 'conversation', 'list', 'lines', 'items'][k + 1] AS shape, upper(role) AS sender, trim(text) AS said, count(*) AS n FROM c WHERE trim(coalesce(text, '')) <> '' AND (k <> 3 OR role IN ('user', 'assistant')) GROUP BY ALL
UNION ALL SELECT conv_id, 'broken', '', '', 1 FROM c WHERE k = 0 GROUP BY conv_id""")
def transcript_shapes(s, d):
    """Each conversation as a document of one of five shapes, and beside every fifth one a broken file."""
    c = fx.table(s, d, "conversations").select("conv_id", F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m")).alias("x"))
    told = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.to_json(x["m"])).alias("m"))
    body, k = F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")), F.col("conv_id") % 5
    shaped = F.when(k == 2, body).when(k == 3, F.concat(F.array_join("m", "\n"), F.lit("\n")))
    for i, name in ((0, "messages"), (1, "conversation"), (4, "items")):
        shaped = shaped.when(k == i, F.concat(F.lit(f'{{"{name}": '), body, F.lit("}")))
    files = told.select(F.col("conv_id").cast("string").alias("path"), shaped.alias("content"))
    broken = told.where(k == 0).select(F.col("conv_id").cast("string").alias("path"), F.lit('{"messages": [').alias("content"))
    got = documents.messages(files.unionByName(broken))
    wrong = F.col("error").isNotNull()
    named = got.select(F.col("path").cast("long").alias("conv_id"), F.when(wrong, "broken").otherwise(F.col("shape")).alias("shape"), F.when(wrong, "").otherwise(F.col("sender")).alias("sender"), F.when(wrong, "").otherwise(F.col("said")).alias("said"))
    return named.groupBy("conv_id", "shape", "sender", "said").agg(F.count("*").alias("n"))


_LISTED = "f AS (SELECT p_type AS path, p_partkey AS k, p_brand AS brand, 1 + 7 * (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) AS l FROM part)"


def _classes(s, d):
    """A script of every type of parts: a comment, a class of two members and a string that looks like code, for each part."""
    one = F.concat(
        F.lit("// "), "p_brand", F.lit("\nclass C"), "p_partkey", F.lit(" {\n  make(a, b) { return helper"), F.col("p_partkey") % 7, F.lit("(a); }\n  other() {\n    const s = \"class X { call(1) }\"; /* gone( */ this.make"), "p_partkey", F.lit("(s);\n  }\n}\n"))
    rows = fx.table(s, d, "part").select("p_type", F.struct("p_partkey", one.alias("c")).alias("x"))
    return rows.groupBy(F.col("p_type").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]), "").alias("content")).withColumn("language", F.lit("javascript"))


@query(f"""WITH {_LISTED} SELECT path, 'class' AS type, 'C' || k AS name, CAST(l + 1 AS INTEGER) AS start_line, CAST(l + 6 AS INTEGER) AS end_line, '' AS parent, brand AS docstring FROM f
UNION ALL SELECT path, 'method', 'make', l + 2, l + 2, 'C' || k, '' FROM f UNION ALL SELECT path, 'method', 'other', l + 3, l + 5, 'C' || k, '' FROM f""")
def brace_symbols(s, d):
    return brace_code.extract_braces(_classes(s, d)).where("what = 'symbol'").select("path", "type", "name", "start_line", "end_line", "parent", "docstring")


@query(f"WITH {_LISTED} SELECT path, 'make' AS caller, 'helper' || (k % 7) AS callee, CAST(l + 2 AS INTEGER) AS line FROM f UNION ALL SELECT path, 'other', 'make' || k, l + 4 FROM f")
def brace_calls(s, d):
    return brace_code.extract_braces(_classes(s, d)).where("what = 'calls'").select("path", F.col("name").alias("caller"), F.col("target").alias("callee"), F.col("start_line").alias("line"))


@query(f"""WITH {ctes('call_edges')}, {IMPORTS_SQL}, files AS (SELECT DISTINCT file_path, replace(replace(file_path, '/', '.'), '.py', '') AS module FROM symbols UNION SELECT DISTINCT file_path || 'x.py', replace(replace(file_path || 'x.py', '/', '.'), '.py', '') FROM symbols)
SELECT file_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM imports i WHERE i.at <> f.file_path AND length(i.from_name) % 3 = 0 AND (i.from_name = f.module OR starts_with(i.from_name, f.module || '.')))""")
def dead_exports_of_imports(s, d):
    """Only imports reach files here, a third of them; each file has a neighbour whose module begins alike and that none reaches."""
    sym, calls = fx.symbols(s, d), fx.call_edges(s, d)
    near = sym.withColumns({"file_path": F.concat("file_path", F.lit("x.py")), "id": F.col("id") + 10_000_000})
    target = sym.where("symbol_type = 'class'").select(F.col("id").alias("to_symbol_id"), F.concat(fn.module_of(F.col("file_path")), F.lit("."), "symbol_name").alias("from_name"))
    imports = calls.select("to_symbol_id", "file_path").join(target, "to_symbol_id").where(F.length("from_name") % 3 == 0).select("file_path", "from_name", F.lit("imports").alias("edge_type"), F.lit(None).cast("string").alias("to_name"))
    return code.dead_exports(sym.unionByName(near), imports)


@query(f"""WITH {ctes('turn_planets')}, n AS (SELECT topic, count(*) AS n, string_agg('    [' || substr(kind, 1, 4) || '] ' || substr(coalesce(content, ''), 1, 200), chr(10) ORDER BY k) FILTER (WHERE k <= 10) AS x FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, id DESC) AS k FROM turn_notes) WHERE k <= 100 GROUP BY topic)
SELECT topic, topic || ' | active' || chr(10) || '  goal: ' || coalesce(nullif(goal, ''), '—') || chr(10) || '  state: —' || chr(10) || '  next: —' || chr(10) || '  steps: review ' || topic || chr(10) || '  handoff: to ' || topic || chr(10) || '  notes (' || n || '):' || chr(10) || x AS text FROM turn_planets JOIN n USING (topic)""")
def planet_dumps(s, d):
    notes = fx.turn_notes(s, d)
    return context.planet_dumps(fx.planets_of(notes).withColumn("handoff", F.concat(F.lit("to "), "topic")), notes)


@query(f"""WITH {ctes('doc_planets')} SELECT topic, '# Knowledge Base Context' || chr(10) || 'Topic: ' || topic || chr(10) || 'Status: active' || chr(10) || chr(10) || '## Goal' || chr(10) || 'Goal ' || id || chr(10) || chr(10) || '## Current State' || chr(10) || 'No current state recorded.'
  || chr(10) || chr(10) || '## Next Steps' || chr(10) || '- review ' || topic || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || '## Handoff' || chr(10) || 'to ' || topic ELSE '' END || chr(10) || chr(10) || '{context.INSTRUCTIONS}' AS text FROM doc_planets""")
def context_handoffs(s, d):
    """Whole contexts of topics without notes."""
    planets = fx.planets_of(fx.doc_notes(s, d)).withColumns({"goal": F.concat(F.lit("Goal "), "id"), "handoff": F.when(F.col("id") % 2 == 0, F.concat(F.lit("to "), "topic")).otherwise("")})
    return context.agent_context(graph.cut(planets), empty(s, "notes"), None, None)


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE contains(text, chr(10)))) SELECT CAST(line AS INTEGER) AS line, text FROM l WHERE line > 1 AND line <= 3")
def code_read(s, d):
    docs = fx.table(s, d, "documents")
    last = docs.where(F.contains("text", F.lit("\n"))).agg(F.max("doc_id")).first()[0]
    files = docs.select(F.concat(F.lit("src/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return code.read_lines(files, f"./src/old/..//{last}", 1, 2)


@query(f"WITH {ctes('doc_planets')} SELECT topic, CASE WHEN id = 1 THEN 'warm' ELSE 'hot' END AS memory_state FROM doc_planets")
def set_memory_state(s, d):
    planets = graph.cut(migrate("planets", fx.planets_of(fx.doc_notes(s, d))))
    return memory.set_memory_state(planets, planets.where("id = 1").first()["topic"], "warm").select("topic", "memory_state")


@query(f"WITH {ctes('turn_notes')}, {TOKEN_SQL.format(notes='turn_notes')}, {PAIR_SQL} SELECT 'created' AS action, count(*) AS count FROM hit WHERE inter * 10 >= uni UNION ALL SELECT 'total_pairs', CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM turn_notes GROUP BY topic)")
def recompute_counts(s, d):
    notes = fx.turn_notes(s, d)
    none = s.createDataFrame([], "from_note_id long, to_note_id long, weight_milli long")
    return similarity.recompute_counts(similarity.recompute_links(notes, none), notes)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE array_to_string(string_split(p_name, ' '), ',') END AS keywords, p_type AS type, CASE WHEN p_size % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(p_size) END AS created_at, p_type <> 'SMALL' AS kept FROM part""")
def rows_of_texts(s, d):
    """Nodes whose arrays, maps and times are texts, some of them broken; one type is not allowed."""
    p = fx.table(s, d, "part")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    rows = p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 4 == 0, "[broken").otherwise(F.to_json(F.split("p_name", " "))).alias("keywords"), F.col("p_type").alias("node_type"),
        F.when(F.col("p_size") % 3 == 0, "never").otherwise(F.concat(day, F.lit("T00:00:00"))).alias("created_at"), F.concat(F.lit('{"type": "'), "p_type", F.lit('"}')).alias("metadata"))
    good, refused = from_texts("nodes", rows, {"node_type": ("ECONOMY", "LARGE", "STANDARD", "PROMO", "MEDIUM")})
    both = good.withColumn("kept", F.lit(True)).unionByName(refused.withColumn("kept", F.lit(False)))
    return both.select("id", "title", F.array_join("keywords", ",").alias("keywords"), F.col("metadata")["type"].alias("type"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "kept")


@query(f"""WITH {ctes('edges')} SELECT CAST(from_id AS VARCHAR) AS from_id, CAST(to_id AS VARCHAR) AS to_id, edge_type, CASE WHEN edge_type = 'A' THEN 0.5 ELSE 1.0 END AS weight FROM edges
UNION ALL SELECT CAST(from_id AS VARCHAR), CAST(to_id AS VARCHAR), 'new', 0.25 FROM edges WHERE edge_type = 'N'""")
def upsert_edges(s, d):
    """By all three parts of the key: the weight of one type changes, another type stands beside it."""
    e = fx.edges(s, d)
    base = graph.cut(migrate("edges", e))
    changed = e.where("edge_type = 'A'").withColumn("weight", F.lit(0.5)).unionByName(e.where("edge_type = 'N'").withColumns({"edge_type": F.lit("new"), "weight": F.lit(0.25)}))
    return memory.upsert(base, migrate("edges", changed), ["from_id", "to_id", "edge_type"]).select("from_id", "to_id", "edge_type", "weight")


@query(f"WITH {ctes('turn_planets')} SELECT id, topic, goal FROM turn_planets WHERE topic = 'conv-7'")
def planet_by_topic(s, d):
    return lookup.by_key(fx.planets_of(fx.turn_notes(s, d)), fn.slug_of("  Conv 7!"), "topic").select("id", "topic", "goal")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'fact' ELSE lower(role) END AS kind, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 80) ELSE role END AS title, CASE WHEN turn % 4 = 0 THEN 'high' ELSE 'medium' END AS priority,
  CASE WHEN turn % 5 = 0 THEN '' ELSE role || ',t' END AS listed FROM conversations""")
def defaults_of_notes(s, d):
    c = fx.table(s, d, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("role")))
    return c.select(
        "conv_id", "turn", fn.note_kind(kind).alias("kind"), fn.note_title(F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")), F.col("text")).alias("title"),
        fn.new_priority(F.when(F.col("turn") % 4 == 0, "high").when(F.col("turn") % 4 == 1, "High")).alias("priority"),
        F.array_join(fn.json_array(F.when(F.col("turn") % 5 == 0, "[oops").otherwise(F.concat(F.lit('["'), "role", F.lit('", "t"]')))), ",").alias("listed"))


@query("SELECT doc_id AS id FROM documents WHERE lower(text) LIKE '%t_e of%an%'")
def like_wildcards(s, d):
    return search.contains_any(fx.table(s, d, "documents"), "T_e of%AN", "text").select(F.col("doc_id").alias("id"))


@query(f"""WITH {ctes('symbols')}, t AS (SELECT id, regexp_extract_all(lower(symbol_name), '[a-z0-9]+') AS n, regexp_extract_all(lower(symbol_name || ' ' || signature || ' ' || docstring || ' ' || file_path || ' ' || symbol_type), '[a-z0-9]+') AS w FROM symbols)
SELECT id FROM t WHERE (list_contains(n, 'red') AND list_contains(w, 'class')) AND NOT list_contains(w, 'economy')""")
def symbols_by_syntax(s, d):
    """Symbols by a query with a column, AND and NOT, from their index."""
    sym = fx.symbols(s, d)
    index = search.TextIndex(s, f"{graph.shared_steps(s)}/index-{uuid.uuid4().hex}", search.SYMBOL_TEXTS, "id", "long")
    index.write(sym)
    return search.search_symbols(sym, "symbol_name : red class NOT economy", 1_000_000, index=index).select("id")


@query(f"WITH {ctes('call_edges')} SELECT id, file_path, symbol_name FROM symbols s WHERE symbol_type IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM call_edges e WHERE e.to_name = s.symbol_name) ORDER BY file_path, start_line, id LIMIT 40")
def dead_code_page(s, d):
    return code.dead_code(fx.symbols(s, d), fx.call_edges(s, d), limit=40).select("id", "file_path", "symbol_name")


@query(f"WITH {ctes('turn_notes')} SELECT id, topic, 'open' AS status, 'default' AS agent_id, 0 AS turn_index, false AS pinned, '' AS tags FROM turn_notes")
def migrated_notes(s, d):
    """Rows of a table that lacks the columns added later."""
    old = fx.turn_notes(s, d).select("id", "topic", "content")
    return migrate("notes", migrate("notes", old)).select("id", "topic", "status", "agent_id", "turn_index", "pinned", F.array_join("tags", ",").alias("tags"))
