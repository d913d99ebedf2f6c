"""Adapters: the driver's tables as memory, graph and code tables, in Spark and as SQL for the oracles.

Each is a projection of a whole table. ``CTE`` holds the same adapters for
DuckDB; ``ctes(names)`` strings together those that a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import FEW, cut, numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds_after(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(1704067200) + seconds)


def turn_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from conversations: a topic a conversation, a note a turn."""
    c = table(spark, sf_dir, "conversations")
    note = F.col("conv_id") * 1000 + F.col("turn")
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "fact").otherwise("decision")
    return c.select(
        note.alias("id"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("topic"), kind.alias("kind"), F.col("text").alias("content"), F.substring("text", 1, 80).alias("title"),
        F.col("role").alias("agent_id"), F.lit("open").alias("status"), F.col("turn").cast("int").alias("turn_index"), _seconds_after(note).alias("created_at"), _seconds_after(note).alias("updated_at"),
        F.array(F.col("role"), F.concat(F.lit("t"), F.col("turn") % 3)).alias("tags"), (note % 17 == 0).alias("pinned"))


def doc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from documents: a topic a source, a note a document."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(labels, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("lang").alias("kind"), F.col("text").alias("content"), F.substring("text", 1, 80).alias("title"),
        F.lit("default").alias("agent_id"), F.when(F.col("toxic") == 1, "closed").otherwise("open").alias("status"), F.lit(0).alias("turn_index"),
        _seconds_after(F.col("doc_id")).alias("created_at"), _seconds_after(F.col("doc_id")).alias("updated_at"), F.array(F.col("lang")).alias("tags"),
        F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("pinned"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, topic, content) of ``doc_notes``. Labels only say how often a document stands there, and few stand twice, so texts are not moved to meet them."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    several = cut(labels.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1"))
    n = several.limit(FEW + 1).count()
    if n:
        d = d.join(F.broadcast(several) if n <= FEW else several, "doc_id", "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1)))))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("text").alias("content"))


def planets_of(notes: DataFrame) -> DataFrame:
    """A planet a topic of ``notes``."""
    first = F.min_by("content", F.struct("created_at", "id"))
    by_topic = notes.groupBy("topic").agg(F.max("created_at").alias("updated_at"), F.min("created_at").alias("created_at"), first.alias("_goal"))
    return numbered(by_topic, "topic").select(
        "id", "topic", F.col("topic").alias("display_topic"), F.lit("active").alias("status"), F.substring("_goal", 1, 120).alias("goal"), F.lit("").alias("current_state"),
        F.lit(None).cast("string").alias("next_step"), F.array(F.concat(F.lit("review "), F.col("topic"))).alias("next_steps"), F.array().cast("array<string>").alias("files"),
        F.array().cast("array<string>").alias("commands"), F.lit("").alias("handoff"), F.array("topic").alias("aliases"), F.lit("hot").alias("memory_state"), "created_at", "updated_at")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from orders; each depends on the customer's order before."""
    o = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    first = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("todo")
    return o.withColumn("_before", before).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("cust-"), F.col("o_custkey")).alias("topic"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"), status.alias("status"),
        F.when(first.isin("1", "2"), "high").when(first == "3", "medium").otherwise("low").alias("priority"),
        F.when(F.col("_before").isNotNull(), F.array("_before")).otherwise(F.array().cast("array<bigint>")).alias("depends_on"), F.array().cast("array<string>").alias("files"),
        F.array(F.col("o_orderkey") % 1000).alias("notes"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content"), F.col("p_type").alias("node_type"), F.split("p_name", " ").alias("keywords"), (F.col("p_size") / 10).alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct steps from a line's part to the next line's, without loops."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_id"))
    j = a.join(b, ["l_orderkey", "l_linenumber"]).where(F.col("l_partkey") != F.col("to_id"))
    return j.select(F.col("l_partkey").alias("from_id"), "to_id", F.col("l_returnflag").alias("edge_type")).distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method")
    return p.select(
        (F.col("p_partkey") + 1).alias("id"), F.lit("p").alias("project_id"), F.concat("p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".py")).alias("file_path"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey") % 97).alias("symbol_name"), kind.alias("symbol_type"), F.lit("python").alias("language"), kind.alias("kind"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), F.concat(F.lit("def "), F.col("p_name")).alias("signature"), F.col("p_brand").alias("docstring"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges by id: from the part of line 1 of an order, if returned, to that of line 2."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")  # noqa: E741
    a = l.where("l_linenumber = 1 AND l_returnflag = 'R'").select("l_orderkey", (F.col("l_partkey") + 1).alias("from_symbol_id"))
    b = l.where("l_linenumber = 2").select("l_orderkey", (F.col("l_partkey") + 1).alias("to_symbol_id"))
    return a.join(b, "l_orderkey").select(F.col("l_orderkey").alias("order_id"), "from_symbol_id", "to_symbol_id")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``calls`` with the names and file of both ends."""
    s = symbols(spark, sf_dir)
    a = s.select(F.col("id").alias("from_symbol_id"), F.col("symbol_name").alias("from_name"), "file_path", F.col("start_line").alias("line_number"))
    b = s.select(F.col("id").alias("to_symbol_id"), F.col("symbol_name").alias("to_name"))
    return calls(spark, sf_dir).join(a, "from_symbol_id").join(b, "to_symbol_id").select(F.lit("p").alias("project_id"), "from_symbol_id", "to_symbol_id", "from_name", "to_name", F.lit("calls").alias("edge_type"), "file_path", "line_number")


CTE = {
    "turn_notes": """turn_notes AS (SELECT conv_id * 1000 + turn AS id, 'conv-' || conv_id AS topic,
      CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'fact' ELSE 'decision' END AS kind, text AS content, substr(text, 1, 80) AS title, role AS agent_id, 'open' AS status,
      turn AS turn_index, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 1000 + turn) AS created_at, [role, 't' || (turn % 3)] AS tags, (conv_id * 1000 + turn) % 17 = 0 AS pinned FROM conversations)""",
    "doc_notes": """doc_notes AS (SELECT d.doc_id AS id, source AS topic, lang AS kind, text AS content, substr(text, 1, 80) AS title, 'default' AS agent_id,
      CASE WHEN toxic = 1 THEN 'closed' ELSE 'open' END AS status, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS created_at, coalesce(quality = 1 AND toxic = 0, false) AS pinned
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "turn_planets": """turn_planets AS (SELECT row_number() OVER (ORDER BY topic) AS id, * FROM (SELECT topic, max(created_at) AS updated_at, substr(arg_min(content, id), 1, 120) AS goal FROM turn_notes GROUP BY topic))""",
    "doc_planets": """doc_planets AS (SELECT row_number() OVER (ORDER BY topic) AS id, * FROM (SELECT topic, max(created_at) AS updated_at, substr(arg_min(content, id), 1, 120) AS goal FROM doc_notes GROUP BY topic))""",
    "tasks": """tasks AS (SELECT o_orderkey AS id, 'cust-' || o_custkey AS topic, 'order ' || o_orderkey AS title,
      CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'todo' END AS status,
      CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium' ELSE 'low' END AS priority,
      lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS depends_on, o_orderkey % 1000 AS note, o_orderdate AS created_at FROM orders)""",
    "nodes": """nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_name || ' ' || p_brand || ' ' || p_type AS content, p_type AS node_type, string_split(p_name, ' ') AS keywords, p_size / 10 AS weight FROM part)""",
    "edges": """edges AS (SELECT DISTINCT a.l_partkey AS from_id, b.l_partkey AS to_id, a.l_returnflag AS edge_type FROM lineitem a JOIN lineitem b
      ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)""",
    "symbols": """symbols AS (SELECT p_partkey + 1 AS id, p_brand || '/' || replace(p_type, ' ', '_') || '.py' AS file_path, replace(p_name, ' ', '_') || '_' || (p_partkey % 97) AS symbol_name,
      CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS symbol_type, 'python' AS language, p_size AS start_line, p_size + 5 AS end_line, 'def ' || p_name AS signature, p_brand AS docstring FROM part)""",
    "calls": """calls AS (SELECT a.l_partkey + 1 AS from_symbol_id, b.l_partkey + 1 AS to_symbol_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
      WHERE a.l_linenumber = 1 AND a.l_returnflag = 'R' AND b.l_linenumber = 2)""",
    "call_edges": """call_edges AS (SELECT from_symbol_id, to_symbol_id, f.symbol_name AS from_name, t.symbol_name AS to_name, f.file_path, f.start_line AS line_number
      FROM calls JOIN symbols f ON from_symbol_id = f.id JOIN symbols t ON to_symbol_id = t.id)""",
}
NEEDS = {"turn_planets": ["turn_notes"], "doc_planets": ["doc_notes"], "call_edges": ["symbols", "calls"]}


def ctes(*names: str) -> str:
    """``a AS (...), b AS (...)`` of the adapters and what they need, in order."""
    out: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if CTE[name] not in out:
            out.append(CTE[name])

    for name in names:
        add(name)
    return ", ".join(out)
