"""Queries of the bundle loader: a state is published, a course's bundles are loaded over it, and the new version is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.queries.registry import query
from tessera.sources import bundles as B
from tessera.sources import assembly, loader, sinks, versions

SCOPE = "c:1"
LOADED = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"
CHUNK = 25_000  # customers' keys of one bundle: about a thousand LOs of a module


def state(t) -> dict[str, DataFrame]:
    """The domain tables as a loader's tables."""
    s = loader.shaped
    docs = t.spark.createDataFrame([("old", "Old book", "old.pdf")], loader.DOCUMENTS)
    return {"nodes": s(t.nodes, loader.NODES), "edges": s(t.edges, loader.EDGES), "questions": s(t.questions, loader.QUESTIONS), "visuals": s(t.visuals, loader.VISUALS), "source_documents": docs, "runs": t.spark.createDataFrame([(7, "old.json", "old", "x", "1", "1")], loader.RUNS), "attempts": t.attempts.select("id", "student_id", "question_id")}


def course_bundles(t) -> DataFrame:
    """Bundles of one course: the course with its modules, then its LOs, every second one of the present, in pieces."""
    nation = t.raw("nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    array = lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")
    head = nation.agg(F.collect_list(F.struct(F.concat(F.lit("m:"), "c_nationkey").alias("id"), "n_name")).alias("m")).select(  # a region has few nations
        F.lit("course.json").alias("file"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"),
        F.concat(F.array(F.expr(f"named_struct('id', '{SCOPE}', 'kind', 'course', 'label', 'Again')")), F.transform("m", lambda m: F.struct(m["id"].alias("id"), F.lit("module").alias("kind"), m["n_name"].alias("label")))).alias("_nodes"),
        F.transform("m", lambda m: F.struct(m["id"].alias("src"), F.lit(SCOPE).alias("dst"), F.lit("part_of").alias("type"))).alias("edges"),
        array(B.QUESTION).alias("questions"), array(B.VISUAL).alias("visuals"), array(B.PASSAGE).alias("text_passages"), array("string").alias("external_node_refs"),
        F.struct(F.lit("new").alias("sha256"), F.lit("New book").alias("title"), F.lit("new.pdf").alias("file_path")).alias("source_document"), F.lit(None).cast("string").alias("source_file"),
    )
    los = t.lo_keys.filter("k % 2 = 0").join(nation, "c_nationkey").withColumn("b", F.floor(F.col("k") / CHUNK))
    passage = F.concat(F.lit("p:"), "c_nationkey", F.lit("-"), "b")
    lo = los.groupBy("c_nationkey", "b").agg(F.array_sort(F.collect_list(F.struct("k", "lo_id"))).alias("l"))
    q = lambda x: F.struct(F.concat(F.lit("new:"), x["lo_id"]).alias("id"), x["lo_id"].alias("lo_id"), F.lit("basic").alias("tier"), F.lit("numeric").alias("type"), F.lit("?").alias("stem"), F.lit(None).cast(f"array<{B.CHOICE}>").alias("choices"), F.lit("1").alias("correct_answer"), F.when(x["k"] % 3 == 0, "verified").otherwise("draft").alias("status"), F.lit(1).alias("source_page"), F.when(x["k"] % 5 == 0, passage).alias("passage_id"), F.when(x["k"] % 7 == 0, "sealed").otherwise("open").alias("sensitivity_class"))
    module = F.concat(F.lit("m:"), "c_nationkey")
    body = lo.select(
        F.concat(F.lit("los-"), "c_nationkey", F.lit("-"), "b", F.lit(".json")).alias("file"), (F.col("c_nationkey") + 1).cast("int").alias("a"), "b",
        F.transform("l", lambda x: F.struct(x["lo_id"].alias("id"), F.lit("learning_objective").alias("kind"), F.concat(F.lit("Again "), x["k"]).alias("label"))).alias("_nodes"),
        F.concat(F.transform("l", lambda x: F.struct(module.alias("src"), x["lo_id"].alias("dst"), F.lit("teaches").alias("type"))), F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l")), lambda x, y: F.struct(x["lo_id"].alias("src"), y["lo_id"].alias("dst"), F.lit("prerequisite").alias("type")))).alias("edges"),
        F.transform("l", q).alias("questions"),
        F.transform(F.filter("l", lambda x: x["k"] % 4 == 0), lambda x: F.struct(F.concat(F.lit("nv:"), x["lo_id"]).alias("id"), x["lo_id"].alias("lo_id"), F.concat(F.lit("new:"), x["lo_id"]).alias("question_id"), F.lit("chart").alias("kind"), F.lit("{}").alias("spec"), F.lit("c").alias("caption"))).alias("visuals"),
        F.array(F.struct(passage.alias("id"), F.lit("t").alias("text_sha256"), F.when(F.col("c_nationkey") % 2 == 0, "editor").alias("approved_by"), F.lit("t").alias("approved_sha256"), F.lit("open").alias("sensitivity_class"))).alias("text_passages"),
        F.array(module).alias("external_node_refs"), F.lit(None).cast("struct<sha256:string,title:string,file_path:string>").alias("source_document"), F.lit("missing.pdf").alias("source_file"),
    )
    kinds = {"nodes": B.NODE, "edges": B.EDGE, "questions": B.QUESTION, "visuals": B.VISUAL, "text_passages": B.PASSAGE}

    def named(df: DataFrame) -> DataFrame:
        df = df.withColumnRenamed("_nodes", "nodes")
        return df.withColumns({c: B.widened(df, c, kind) for c, kind in kinds.items()})

    both = named(head).unionByName(named(body))
    files = graph.cut(both.select("a", "b").withColumn("ord", F.row_number().over(Window.orderBy("a", "b"))))  # two numbers for each file: what the bundles hold isn't brought into one task
    return both.join(files, ["a", "b"]).drop("a", "b").withColumns({"extraction_run": F.expr("named_struct('extractor', 'x', 'extractor_version', '2', 'schema_version', '1')"), "syllabus_version": F.lit("v9")})


def loaded(t) -> tuple[versions.Version, DataFrame]:
    root = f"{sinks.shared_folder(t.spark)}/load-{uuid.uuid4().hex}"
    versions.commit(t.spark, root, None, state(t))
    return loader.load(t.spark, root, course_bundles(t), loader.Options(scope=SCOPE, loaded_at=F.expr(LOADED)))


AFTER = """, sub AS (SELECT 'c:1' AS id UNION SELECT src_id FROM edges WHERE edge_type = 'part_of' AND dst_id = 'c:1'
    UNION SELECT t.dst_id FROM edges t JOIN edges p ON p.src_id = t.src_id AND p.edge_type = 'part_of' AND p.dst_id = 'c:1' WHERE t.edge_type = 'teaches'),
  fresh AS (SELECT k, lo_id, c_nationkey, lead(lo_id) OVER (PARTITION BY c_nationkey, k // 25000 ORDER BY k) AS next FROM lo_keys WHERE k % 2 = 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)),
  nodes2 AS (SELECT id, kind, label FROM nodes WHERE id NOT IN (SELECT id FROM sub) UNION ALL SELECT 'c:1', 'course', 'Again' UNION ALL SELECT 'm:' || n_nationkey, 'module', n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT lo_id, 'learning_objective', 'Again ' || k FROM fresh),
  edges2 AS (SELECT src_id, dst_id, edge_type, system_from, system_to, rationale FROM edges WHERE src_id NOT IN (SELECT id FROM sub) AND dst_id NOT IN (SELECT id FROM sub)
    UNION ALL SELECT src_id, dst_id, edge_type, system_from, system_to, rationale FROM edges WHERE edge_type = 'relates_to' AND (src_id IN (SELECT id FROM sub) OR dst_id IN (SELECT id FROM sub)) AND src_id IN (SELECT id FROM nodes2) AND dst_id IN (SELECT id FROM nodes2)
    UNION ALL SELECT a, b, c, TIMESTAMP '2024-06-01', NULL, NULL FROM (SELECT 'm:' || n_nationkey AS a, 'c:1' AS b, 'part_of' AS c FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'm:' || c_nationkey, lo_id, 'teaches' FROM fresh UNION ALL SELECT lo_id, next, 'prerequisite' FROM fresh WHERE next IS NOT NULL)),
  questions2 AS (SELECT id, lo_id, status FROM questions WHERE lo_id NOT IN (SELECT id FROM sub) UNION ALL
    SELECT 'new:' || lo_id, lo_id, CASE WHEN k % 3 = 0 AND k % 7 != 0 AND NOT (k % 5 = 0 AND c_nationkey % 2 = 1) THEN 'live' ELSE 'review' END FROM fresh)
"""


def _delta(name: str, before: str, after: str) -> str:
    return f"SELECT '{name}' AS name, ({before}) AS before, ({after}) AS after, ({after}) - ({before}) AS delta"


@query("q18_course_load_delta", AFTER + " UNION ALL ".join([
    _delta("nodes", "SELECT count(*) FROM nodes", "SELECT count(*) FROM nodes2"), _delta("edges", "SELECT count(*) FROM edges", "SELECT count(*) FROM edges2"),
    _delta("bridges", "SELECT count(*) FROM edges WHERE edge_type = 'relates_to'", "SELECT count(*) FROM edges2 WHERE edge_type = 'relates_to'"), _delta("questions", "SELECT count(*) FROM questions", "SELECT count(*) FROM questions2"),
    _delta("live", "SELECT count(*) FROM questions WHERE status = 'live'", "SELECT count(*) FROM questions2 WHERE status = 'live'"), _delta("review", "SELECT count(*) FROM questions WHERE status = 'review'", "SELECT count(*) FROM questions2 WHERE status = 'review'"),
    _delta("visuals", "SELECT count(*) FROM visuals", "(SELECT count(*) FROM visuals WHERE lo_id NOT IN (SELECT id FROM sub)) + (SELECT count(*) FROM fresh WHERE k % 4 = 0)".replace("(SELECT count(*) FROM visuals", "SELECT (SELECT count(*) FROM visuals", 1)),
    _delta("source documents", "SELECT 1", "SELECT 2"), _delta("attempts", "SELECT count(*) FROM attempts", "SELECT count(*) FROM attempts WHERE question_id NOT IN (SELECT id FROM questions WHERE lo_id IN (SELECT id FROM sub))"),
]))
def _(t):
    return loaded(t)[1]


@query("q18_loaded_nodes", AFTER + "SELECT id, kind, label FROM nodes2")
def _(t):
    return loaded(t)[0].table("nodes").select("id", "kind", "label")


@query("q18_loaded_questions", AFTER + "SELECT id, lo_id, status FROM questions2")
def _(t):
    return loaded(t)[0].table("questions").select("id", "lo_id", "status")


@query("b4_kept_bridges", AFTER + "SELECT src_id, dst_id, edge_type, system_from, system_to, rationale FROM edges2")
def _(t):
    return loaded(t)[0].table("edges").select("src_id", "dst_id", "edge_type", "system_from", "system_to", "rationale")


def drafts(t) -> dict[str, DataFrame]:
    """Draft lessons: a nation's customers are the subtopics of three lessons, orders are their questions, parts their visuals, documents their passages."""
    lesson = "concat('u', c_nationkey, '-', k % 3 + 1)"
    los = t.lo_keys.selectExpr("k", f"{lesson} AS lesson", "c_nationkey")
    lessons = los.groupBy("lesson", "c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("_o"), F.col("k").cast("string").alias("key"), F.concat(F.lit("About "), "k").alias("title")))).alias("s"))
    lessons = lessons.select("lesson", F.concat(F.lit("m:"), "c_nationkey").alias("module_id"), F.concat(F.lit("Module "), "c_nationkey").alias("module_title"), (F.col("c_nationkey") * 10 + F.substring_index("lesson", "-", -1).cast("int")).alias("ord"), F.transform("s", lambda x: F.struct(x["key"].alias("key"), x["title"].alias("title"))).alias("subtopics"))
    choices = F.array(*[F.struct(F.lit(str(i)).alias("key"), F.lit(f"choice {i}").alias("text")) for i in range(4)])
    o = t.raw("orders").join(los.withColumnRenamed("k", "o_custkey"), "o_custkey")
    q = o.select("lesson", F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 2 == 0, "mcq").otherwise("numeric").alias("type"), F.lit("basic").alias("tier"), F.concat(F.lit("What of "), "o_orderkey").alias("stem"), choices.alias("choices"), F.concat((F.col("o_orderkey") % 7).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ". so").otherwise("")).alias("answer"), F.when(F.col("o_orderkey") % 5 == 0, F.concat((F.col("o_orderkey") % 3).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ")").otherwise(""))).alias("reading"), F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("p:"), "lesson")).alias("passage_id"), F.lit(1).alias("source_page"))
    v = t.raw("part").selectExpr("p_partkey", "p_partkey % 150 AS k").join(los, "k").select("lesson", F.col("k").cast("string").alias("key"), F.lit("chart").alias("kind"), F.lit("{}").alias("spec"), F.col("p_partkey").cast("string").alias("caption"))
    p = lessons.select("lesson", F.concat(F.lit("p:"), "lesson").alias("id"), F.lit("poem").alias("kind"), F.col("lesson").endswith("-1").alias("sacred"), F.array(F.concat(F.lit(" one  "), "lesson"), F.lit("two")).alias("units"))
    return {"lessons": lessons, "questions": q, "visuals": v, "passages": p}


DRAFTS = """, lo AS (SELECT k, c_nationkey AS n, 'u' || c_nationkey || '-' || (k % 3 + 1) AS lesson, k % 3 + 1 AS part FROM lo_keys),
  l AS (SELECT *, row_number() OVER (PARTITION BY lesson ORDER BY k) AS i, 'lo:' || lesson || '-' || row_number() OVER (PARTITION BY lesson ORDER BY k) AS id FROM lo),
  e AS (SELECT 'm:' || n AS src, 'c:book' AS dst, 'part_of' AS type FROM (SELECT DISTINCT n FROM l) UNION ALL SELECT 'm:' || n, id, 'teaches' FROM l
    UNION ALL SELECT * FROM (SELECT lag(id) OVER (PARTITION BY n ORDER BY part, i) AS src, id AS dst, 'prerequisite' FROM l) WHERE src IS NOT NULL),
  q AS (SELECT lesson, 'q:' || lesson || '-' || i || ':' || printf('%03d', row_number() OVER (PARTITION BY lesson, i ORDER BY o_orderkey)) AS id, id AS lo_id, o_orderkey AS o, part,
    CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 7 < 4 THEN CAST(o_orderkey % 7 AS VARCHAR) END AS answer FROM orders JOIN l ON k = o_custkey),
  r AS (SELECT lesson, id, lo_id, answer, CASE WHEN answer IS NOT NULL AND (o % 5 != 0 OR o % 7 = o % 3) THEN 'verified' ELSE 'draft' END AS status, CASE WHEN o % 11 = 0 AND part = 1 THEN 'sealed' ELSE 'open' END AS sensitivity FROM q)
"""
BOOK = ("c:book", "Book"), ("sha-book", "Book", "book.pdf")


@query("q17_assembled_questions", DRAFTS + "SELECT lesson || '.json' AS file, id, lo_id, answer AS correct_answer, status, sensitivity AS sensitivity_class FROM r")
def _(t):
    return assembly.assemble(**drafts(t), course=BOOK[0], source=BOOK[1]).select("file", F.explode("questions").alias("q")).select("file", "q.id", "q.lo_id", "q.correct_answer", "q.status", "q.sensitivity_class")


@query("q17_assembled_edges", DRAFTS + "SELECT * FROM e")
def _(t):
    return assembly.assemble(**drafts(t), course=BOOK[0], source=BOOK[1]).select(F.explode("edges").alias("e")).select("e.*")


@query("q17_loaded_book", DRAFTS + """SELECT 'nodes' AS name, (SELECT count(*) FROM l) + (SELECT count(DISTINCT n) FROM l) + 1 AS n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'questions', count(*) FROM r UNION ALL SELECT 'live', count(*) FROM r WHERE status = 'verified' AND sensitivity = 'open' AND id NOT IN (SELECT id FROM q WHERE o % 11 = 0)
  UNION ALL SELECT 'visuals', count(*) FROM visuals UNION ALL SELECT 'source documents', 1""")
def _(t):
    """The assembled book through all gates of the loader; questions that are bound to a passage that nobody has approved are held."""
    root = f"{sinks.shared_folder(t.spark)}/book-{uuid.uuid4().hex}"
    _, change = loader.load(t.spark, root, assembly.parts(**drafts(t), course=BOOK[0], source=BOOK[1]))
    return change.filter("name NOT IN ('bridges', 'review')").select("name", F.col("after").alias("n"))
