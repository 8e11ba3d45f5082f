"""Filters, projections, joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph, rollup, temporal
from tessera.queries.registry import query

SLUG = r"regexp_replace(regexp_replace(lo_id, '^lo:', ''), '-[0-9]+$', '')"
LINEAGE = """, lin AS (
  SELECT lo.id AS lo_id, lo.label, lo.order_in_parent, m.id AS module_id, m.label AS module_label, m.order_in_parent AS module_order, c.id AS course_id, c.label AS course_label, c.subject
  FROM nodes lo LEFT JOIN edges t ON t.dst_id = lo.id AND t.edge_type = 'teaches' AND t.system_to IS NULL LEFT JOIN nodes m ON m.id = t.src_id AND m.kind = 'module'
  LEFT JOIN edges p ON p.src_id = m.id AND p.edge_type = 'part_of' AND p.system_to IS NULL LEFT JOIN nodes c ON c.id = p.dst_id AND c.kind = 'course' WHERE lo.kind = 'learning_objective')"""
LAST = "(SELECT max(ts) FROM events)"


def now(t):
    """The latest event time, as a one-row table."""
    return t.raw("events").agg(F.max("ts").alias("now"))


def lin(t):
    return graph.lineage(t.nodes, t.edges)


# --- filters and projections ---------------------------------------------------------------------


@query("f1_current_edges", "SELECT id, src_id, dst_id, edge_type FROM edges WHERE system_to IS NULL")
def _(t):
    return temporal.current(t.edges).select("id", "src_id", "dst_id", "edge_type")


@query("f2_live_questions", "SELECT id, lo_id, tier FROM questions WHERE status = 'live'")
def _(t):
    return t.questions.filter("status = 'live'").select("id", "lo_id", "tier")


@query("f3_kind_and_type", "SELECT n.id, n.label FROM nodes n WHERE kind = 'module' UNION ALL SELECT CAST(id AS VARCHAR), rationale FROM edges WHERE edge_type = 'relates_to'")
def _(t):
    return t.nodes.filter("kind = 'module'").select("id", "label").unionByName(t.edges.filter("edge_type = 'relates_to'").selectExpr("CAST(id AS STRING) AS id", "rationale AS label"))


@query("f4_lesson_prefix", "SELECT id, label FROM nodes WHERE id LIKE 'lo:u3-1-%'")
def _(t):
    return t.nodes.filter(F.col("id").startswith("lo:u3-1-")).select("id", "label")


@query("f5_member_of", "SELECT q.id, q.lo_id FROM questions q WHERE q.lo_id IN (SELECT lo_id FROM lo_keys WHERE c_nationkey = 3)")
def _(t):
    return t.questions.join(t.lo_keys.filter("c_nationkey = 3").select("lo_id"), "lo_id", "left_semi").select("id", "lo_id")


@query("f6_either_end", "SELECT id, src_id, dst_id FROM cur WHERE edge_type = 'relates_to' AND (src_id LIKE 'lo:u1-%' OR dst_id LIKE 'lo:u1-%')")
def _(t):
    return t.current.filter("edge_type = 'relates_to'").filter(F.col("src_id").startswith("lo:u1-") | F.col("dst_id").startswith("lo:u1-")).select("id", "src_id", "dst_id")


@query("f7_recent_attempts", f"SELECT id, student_id FROM attempts WHERE attempted_at > {LAST} - INTERVAL 2 DAY")
def _(t):
    return t.attempts.join(F.broadcast(now(t)), F.col("attempted_at") > F.col("now") - F.expr("INTERVAL 2 DAYS")).select("id", "student_id")


@query("f8_json_path", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'", prelude=False)
def _(t):
    return t.raw("events").filter(F.get_json_object("props", "$.k") == "42").select("event_id", "user_id")


@query("f9_is_distinct_from", "SELECT id FROM nodes WHERE subject IS DISTINCT FROM 'asia'")
def _(t):
    return t.nodes.filter(~F.col("subject").eqNullSafe("asia")).select("id")


@query("f10_not_like", "SELECT id, display_name FROM students WHERE display_name NOT LIKE '%7%'")
def _(t):
    return t.students.filter(~F.col("display_name").like("%7%")).select("id", "display_name")


@query("f11_both_ends_present", "SELECT e.id FROM cur e WHERE edge_type = 'relates_to' AND src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes)")
def _(t):
    return graph.both_present(t.current.filter("edge_type = 'relates_to'"), t.nodes).select("id")


@query("f12_subject_filter", LINEAGE + "SELECT lo_id FROM lin WHERE subject = 'europe'")
def _(t):
    return lin(t).filter("subject = 'europe'").select("lo_id")


@query("f13_course_filter", LINEAGE + f"SELECT DISTINCT {SLUG} AS slug FROM lin WHERE course_id = 'c:2'")
def _(t):
    return lin(t).filter("course_id = 'c:2'").selectExpr(f"{SLUG} AS slug").distinct()


@query("p1_defaults", LINEAGE + "SELECT lo_id, coalesce(subject, 'Unfiled') AS subject, coalesce(order_in_parent, 1) AS ord FROM lin")
def _(t):
    return lin(t).select("lo_id", F.coalesce("subject", F.lit("Unfiled")).alias("subject"), F.coalesce("order_in_parent", F.lit(1)).alias("ord"))


@query("p2_case_order", "SELECT kind, CASE kind WHEN 'course' THEN 1 WHEN 'module' THEN 2 ELSE 3 END AS ord, count(*) AS n FROM nodes GROUP BY 1, 2")
def _(t):
    return t.nodes.groupBy("kind", F.when(F.col("kind") == "course", 1).when(F.col("kind") == "module", 2).otherwise(3).alias("ord")).agg(F.count(F.lit(1)).alias("n"))


@query("p3_progress_bands", "SELECT student_id, lo_id, CAST(floor(score * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.5 THEN 'developing' WHEN score >= 0.3 THEN 'emerging' ELSE 'weak' END AS band FROM mastery WHERE system_to IS NULL")
def _(t):
    return temporal.current(t.mastery).select("student_id", "lo_id", rollup.half_up(F.col("score") * 100).alias("percent"), rollup.rank_label(F.col("score")).alias("band"))


@query("p5_growth", "SELECT student_id, lo_id, round(max(score) FILTER (system_to IS NULL) - arg_min(score, n), 9) AS growth FROM mastery GROUP BY ALL")
def _(t):
    return temporal.baseline_current(t.mastery, ["student_id", "lo_id"]).select("student_id", "lo_id", F.round(F.col("current") - F.col("baseline"), 9).alias("growth"))


@query("p6_subject_lookup", "SELECT p.id, s.key FROM (SELECT id FROM nodes WHERE kind IN ('course', 'module')) p LEFT JOIN (VALUES ('c:0', 'af'), ('c:2', 'as')) s(id, key) ON s.id = p.id")
def _(t):
    registry = t.spark.createDataFrame([("c:0", "af"), ("c:2", "as")], "id string, key string")
    return t.nodes.filter("kind IN ('course', 'module')").select("id").join(F.broadcast(registry), "id", "left")


@query("p7_lesson_slug", f"SELECT lo_id, {SLUG} AS slug FROM lo_keys")
def _(t):
    return t.lo_keys.selectExpr("lo_id", f"{SLUG} AS slug")


@query("p8_workflow_id", r"SELECT regexp_extract(src_id, '^m:([0-9]+)$', 1) AS module, CAST(regexp_extract(dst_id, 'u([0-9]+)-([0-9]+)-([0-9]+)$', 1) AS INT) AS unit, CAST(regexp_extract(dst_id, 'u([0-9]+)-([0-9]+)-([0-9]+)$', 2) AS INT) + 10 AS lesson FROM cur WHERE edge_type = 'teaches'")
def _(t):
    part = lambda i: F.regexp_extract("dst_id", r"u([0-9]+)-([0-9]+)-([0-9]+)$", i).cast("int")
    return t.current.filter("edge_type = 'teaches'").select(F.regexp_extract("src_id", "^m:([0-9]+)$", 1).alias("module"), part(1).alias("unit"), (part(2) + 10).alias("lesson"))


@query("p9_sanitize_slug", r"SELECT lo_id, CASE WHEN regexp_matches(substr(lo_id, 4), '^[a-z0-9]{1,12}-[0-9]{1,3}$') THEN substr(lo_id, 4) WHEN k % 2 = 0 THEN 'u1-1' END AS slug FROM lo_keys")
def _(t):
    raw = F.expr("substr(lo_id, 4)")
    return t.lo_keys.select("lo_id", F.when(raw.rlike("^[a-z0-9]{1,12}-[0-9]{1,3}$"), raw).when(F.col("k") % 2 == 0, "u1-1").alias("slug"))


# --- joins ---------------------------------------------------------------------------------------


@query("j1_lo_subject", "SELECT n.id, s.subject FROM nodes n LEFT JOIN node_subject s ON s.lo_id = n.id WHERE n.kind = 'learning_objective'")
def _(t):
    return t.nodes.filter("kind = 'learning_objective'").join(t.node_subject.withColumnsRenamed({"lo_id": "id", "subject": "s"}), "id", "left").select("id", F.col("s").alias("subject"))


@query("j2_question_run", "SELECT q.id, r.extractor FROM questions q LEFT JOIN runs r ON r.id = q.run_id")
def _(t):
    return t.questions.join(F.broadcast(t.runs.withColumnRenamed("id", "run_id")), "run_id", "left").select("id", "extractor")


@query("j3_lineage", LINEAGE + "SELECT lo_id, module_id, course_id, subject FROM lin")
def _(t):
    return lin(t).select("lo_id", "module_id", "course_id", "subject")


@query("j4_lineage_mastery", LINEAGE + "SELECT l.lo_id, l.course_id, round(m.score, 9) AS score FROM lin l LEFT JOIN mastery m ON m.lo_id = l.lo_id AND m.student_id = 1 AND m.system_to IS NULL")
def _(t):
    m = temporal.mastery_history(t.attempts.filter("student_id = 1"), ["student_id", "lo_id"]).filter("system_to IS NULL").select("lo_id", "score")
    return lin(t).join(m, "lo_id", "left").select("lo_id", "course_id", F.round("score", 9).alias("score"))


@query("j5_node_subject", "SELECT lo_id, subject FROM node_subject")
def _(t):
    return t.node_subject


@query("j6_bridge_roles", "SELECT b.id, s.label AS src_label, d.label AS dst_label, ss.subject AS src_subject, ds.subject AS dst_subject FROM cur b JOIN nodes s ON s.id = b.src_id JOIN nodes d ON d.id = b.dst_id LEFT JOIN node_subject ss ON ss.lo_id = b.src_id LEFT JOIN node_subject ds ON ds.lo_id = b.dst_id WHERE b.edge_type = 'relates_to'")
def _(t):
    b = t.current.filter("edge_type = 'relates_to'").select("id", "src_id", "dst_id")
    for role in ("src", "dst"):
        b = b.join(t.nodes.select(F.col("id").alias(f"{role}_id"), F.col("label").alias(f"{role}_label")), f"{role}_id")
    for role in ("src", "dst"):
        b = b.join(t.node_subject.withColumnsRenamed({"lo_id": f"{role}_id", "subject": f"{role}_subject"}), f"{role}_id", "left")
    return b.select("id", "src_label", "dst_label", "src_subject", "dst_subject")


@query("j7_visual_module", "SELECT v.id, n.label, m.label AS module FROM visuals v JOIN nodes n ON n.id = v.lo_id LEFT JOIN cur e ON e.dst_id = v.lo_id AND e.edge_type = 'teaches' LEFT JOIN nodes m ON m.id = e.src_id")
def _(t):
    modules = t.current.filter("edge_type = 'teaches'").select(F.col("dst_id").alias("lo_id"), F.col("src_id").alias("mid"))
    names = t.nodes.select(F.col("id").alias("mid"), F.col("label").alias("module"))
    return t.visuals.join(t.nodes.select(F.col("id").alias("lo_id"), "label"), "lo_id").join(modules, "lo_id", "left").join(names, "mid", "left").select("id", "label", "module")


@query("j8_question_label", "SELECT q.id, n.label FROM questions q JOIN nodes n ON n.id = q.lo_id WHERE q.status = 'live'")
def _(t):
    return t.questions.filter("status = 'live'").join(t.nodes.select(F.col("id").alias("lo_id"), "label"), "lo_id").select("id", "label")


@query("j9_course_of_lo", "SELECT a.dst_id AS lo_id, min(c.label) AS course FROM cur a JOIN cur p ON p.src_id = a.src_id AND p.edge_type = 'part_of' JOIN nodes c ON c.id = p.dst_id WHERE a.edge_type = 'teaches' GROUP BY 1")
def _(t):
    a = t.current.filter("edge_type = 'teaches'").select("src_id", F.col("dst_id").alias("lo_id"))
    p = t.current.filter("edge_type = 'part_of'").select("src_id", F.col("dst_id").alias("id"))
    return a.join(p, "src_id").join(t.nodes.select("id", "label"), "id").groupBy("lo_id").agg(F.min("label").alias("course"))


@query("j10_course_title", "SELECT n.id, 'book of ' || r_name AS title FROM nodes n JOIN region ON n.id = 'c:' || r_regionkey")
def _(t):
    books = t.raw("region").selectExpr("concat('c:', r_regionkey) AS id", "concat('book of ', r_name) AS title")
    return t.nodes.select("id").join(F.broadcast(books), "id")


@query("j11_backfill", "SELECT c.id, coalesce(c.subject, s.subject) AS subject FROM checks c LEFT JOIN (SELECT lo_keys.k % 100 AS kk, min(subject) AS subject FROM lo_keys JOIN node_subject USING (lo_id) GROUP BY 1) s ON s.kk = c.id % 100")
def _(t):
    known = t.lo_keys.join(t.node_subject, "lo_id").groupBy((F.col("k") % 100).alias("kk")).agg(F.min("subject").alias("s"))
    return t.checks.join(F.broadcast(known), F.col("id") % 100 == F.col("kk"), "left").select("id", F.coalesce("subject", "s").alias("subject"))


@query("j12_left_with_default", "SELECT k.lo_id, round(coalesce(max(m.score), 0), 9) AS score FROM lo_keys k LEFT JOIN mastery m ON m.lo_id = k.lo_id AND m.student_id = 2 AND m.system_to IS NULL GROUP BY 1")
def _(t):
    m = temporal.mastery_history(t.attempts.filter("student_id = 2"), ["student_id", "lo_id"]).filter("system_to IS NULL").select("lo_id", "score")
    return t.lo_keys.join(m, "lo_id", "left").select("lo_id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


@query("j13_semi", "SELECT id, src_id FROM cur WHERE edge_type = 'relates_to' AND dst_id IN (SELECT id FROM nodes)")
def _(t):
    return t.current.filter("edge_type = 'relates_to'").join(t.nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("id", "src_id")


@query("j14_anti", "SELECT id, dst_id FROM cur WHERE edge_type = 'relates_to' AND dst_id NOT IN (SELECT id FROM nodes)")
def _(t):
    return t.current.filter("edge_type = 'relates_to'").join(t.nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_anti").select("id", "dst_id")


@query(
    "j15_far_ends",
    """, here AS (SELECT DISTINCT lo_id AS id FROM node_subject WHERE subject = 'asia'),
    o AS (SELECT id, rationale, CASE WHEN src_id IN (FROM here) THEN src_id ELSE dst_id END AS this_id, CASE WHEN src_id IN (FROM here) THEN dst_id ELSE src_id END AS other_id FROM cur
          WHERE edge_type = 'relates_to' AND (src_id IN (FROM here) OR dst_id IN (FROM here))),
    u AS (SELECT this_id, other_id, arg_min(rationale, id) AS rationale FROM o GROUP BY 1, 2)
    SELECT u.*, s.subject FROM u JOIN (SELECT lo_id, min(subject) AS subject FROM node_subject WHERE subject IS NOT NULL GROUP BY 1) s ON s.lo_id = u.other_id""",
)
def _(t):
    return graph.far_ends(t.current.filter("edge_type = 'relates_to'"), t.node_subject.filter("subject = 'asia'").select(F.col("lo_id").alias("id")).distinct(), t.node_subject)


@query("j16_as_of", "SELECT c.id, round(m.score, 9) AS score FROM checks c LEFT JOIN mastery m ON m.student_id = c.student_id AND m.lo_id LIKE 'lo:%-7' AND m.system_from <= c.created_at AND (m.system_to > c.created_at OR m.system_to IS NULL)")
def _(t):
    facts = t.mastery.filter(F.col("lo_id").like("lo:%-7")).select("student_id", "system_from", "score")
    return temporal.as_of_join(t.checks.select("id", "student_id", "created_at"), facts, ["student_id"], "created_at", "system_from", ["score"]).select("id", F.round("score", 9).alias("score"))


@query(
    "j17_product",
    """SELECT x, y, TRUE AS is_pair FROM (SELECT DISTINCT r_name AS x FROM region ORDER BY 1 LIMIT 4), (SELECT DISTINCT n_name AS y FROM nation ORDER BY 1 LIMIT 4)
    UNION ALL SELECT y, x, FALSE FROM (SELECT x, y FROM (SELECT DISTINCT r_name AS x FROM region ORDER BY 1 LIMIT 4), (SELECT DISTINCT n_name AS y FROM nation ORDER BY 1 LIMIT 4) ORDER BY y, x LIMIT 3)""",
    prelude=False,
)
def _(t):
    return rollup.product_with_decoys(t.raw("region").selectExpr("r_name AS v"), t.raw("nation").selectExpr("n_name AS v"))


@query(
    "j18_nearest_place",
    """SELECT e.vec_id, arg_min(p.pid, sqrt((e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y)) / p.r * 1e6 + p.pid * 1e-9) AS place FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) e
    JOIN (SELECT n_nationkey AS pid, (n_nationkey % 5 - 2) * 0.1 AS x, (n_nationkey // 5 - 2) * 0.1 AS y, 0.05 + n_nationkey * 0.001 AS r FROM nation) p
    ON sqrt((e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y)) <= p.r * 1.35 GROUP BY 1""",
    prelude=False,
)
def _(t):
    places = t.raw("nation").selectExpr("n_nationkey AS pid", "CAST((n_nationkey % 5 - 2) * 0.1 AS DOUBLE) AS px", "CAST((n_nationkey div 5 - 2) * 0.1 AS DOUBLE) AS py", "CAST(0.05 + n_nationkey * 0.001 AS DOUBLE) AS r")
    points = t.raw("embeddings").selectExpr("vec_id", "CAST(embedding[0] AS DOUBLE) AS x", "CAST(embedding[1] AS DOUBLE) AS y")
    from tessera.operators.places import nearest_place

    return nearest_place(points, places, "vec_id", "pid", slack=1.35)


@query("j19_alias_lookup", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON lower('nation ' || (p_partkey % 30)) = replace(lower(n_name), '_', ' ')", prelude=False)
def _(t):
    from tessera.operators.places import resolve_names

    places = t.raw("nation").selectExpr("n_nationkey AS place", "n_name AS name", "CAST(array() AS array<string>) AS aliases")
    names = t.raw("part").selectExpr("p_partkey", "concat('NATION  ', p_partkey % 30) AS name")
    return resolve_names(names, places, "name").select("p_partkey", F.col("place").alias("n_nationkey")).filter("n_nationkey IS NOT NULL")


@query("j20_needle_section", "SELECT c_custkey, coalesce(list_filter(['AUTO', 'MACH', 'HOUSE'], lambda x: contains(c_mktsegment, x))[1], 'other') AS section FROM customer", prelude=False)
def _(t):
    return t.raw("customer").select("c_custkey", F.coalesce(F.get(F.filter(F.array(*map(F.lit, ("AUTO", "MACH", "HOUSE"))), lambda x: F.contains("c_mktsegment", x)), F.lit(0)), F.lit("other")).alias("section"))


@query("j21_exploded_ids", "SELECT x.eid AS event_id, x.pos, n.label FROM (SELECT event_id AS eid, unnest([0, 1, 2]) AS pos FROM events) x JOIN lo_keys l ON l.k = x.eid * 7 + x.pos JOIN nodes n ON n.id = l.lo_id")
def _(t):
    ids = t.raw("events").select("event_id", F.posexplode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda p: F.col("event_id") * 7 + p)).alias("pos", "k"))
    return ids.join(t.lo_keys, "k").join(t.nodes.select(F.col("id").alias("lo_id"), "label"), "lo_id").select("event_id", "pos", "label")


# --- aggregations --------------------------------------------------------------------------------


@query("a1_home_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM cur) AS edges, (SELECT count(*) FROM questions WHERE status = 'live') AS live, (SELECT count(*) FROM attempts) AS attempts, (SELECT count(*) FROM visuals) AS visuals")
def _(t):
    return rollup.dashboard(nodes=t.nodes, edges=t.current, live=t.questions.filter("status = 'live'"), attempts=t.attempts, visuals=t.visuals)


@query("a2_count_by_kind", "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def _(t):
    return rollup.counts_by(t.nodes, ["kind"])


@query("a3_count_by_type", "SELECT edge_type, count(*) AS n, min(syllabus_version) AS version FROM cur GROUP BY 1")
def _(t):
    return t.current.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("syllabus_version").alias("version"))


@query("a4_count_filter", "SELECT count(*) FILTER (WHERE status = 'live') AS live, count(*) FILTER (WHERE status = 'review') AS review, count(*) AS n FROM questions")
def _(t):
    return t.questions.agg(F.count_if(F.col("status") == "live").alias("live"), F.count_if(F.col("status") == "review").alias("review"), F.count(F.lit(1)).alias("n"))


@query("a5_recent_per_question", f"SELECT a.student_id, a.question_id, count(*) AS recent FROM attempts a JOIN questions q ON q.id = a.question_id AND q.status = 'live' WHERE a.attempted_at > {LAST} - INTERVAL 2 DAY GROUP BY 1, 2")
def _(t):
    dated = t.attempts.crossJoin(F.broadcast(now(t)))  # one row
    return rollup.recent_counts(t.questions.filter("status = 'live'"), dated, F.col("now"))


@query("a5_recent_for_student", f"SELECT q.id AS question_id, (SELECT count(*) FROM attempts a WHERE a.student_id = 1 AND a.question_id = q.id AND a.attempted_at > {LAST} - INTERVAL 2 DAY) AS recent FROM questions q WHERE q.status = 'live'")
def _(t):
    live = t.questions.filter("status = 'live'")
    dated = t.attempts.filter("student_id = 1").crossJoin(F.broadcast(now(t)))  # one row
    return rollup.recent_for(F.lit(1), live, rollup.recent_counts(live, dated, F.col("now")))


@query("a6_roster", "SELECT s.id, s.display_name, count(a.id) AS attempts, coalesce(max(m.n), 0) AS open_rows, round(coalesce(max(m.s), 0) / greatest((SELECT count(*) FROM lo_keys), 1), 6) AS average FROM students s LEFT JOIN attempts a ON a.student_id = s.id LEFT JOIN (SELECT student_id, count(*) AS n, sum(score) AS s FROM mastery WHERE system_to IS NULL GROUP BY 1) m ON m.student_id = s.id GROUP BY 1, 2")
def _(t):
    return rollup.roster(t.students, t.attempts, t.mastery, t.lo_keys.agg(F.count(F.lit(1)).alias("n_los"))).withColumn("average", F.round("average", 6))


@query("a7_subject_rollup", LINEAGE + f""", s AS (SELECT l.*, coalesce(m.score, 0) AS score, {SLUG.replace("lo_id", "l.lo_id")} AS slug, row_number() OVER (ORDER BY module_order, order_in_parent, l.lo_id) AS o FROM lin l LEFT JOIN mastery m ON m.lo_id = l.lo_id AND m.student_id = 3 AND m.system_to IS NULL WHERE subject IS NOT NULL)
SELECT subject, count(*) AS los, round(sum(score) / count(*), 9) AS mean_score, count(DISTINCT slug) AS lessons, arg_min(slug, o) AS first_lesson, arg_min(lo_id, (score, o)) AS weakest FROM s GROUP BY 1""")
def _(t):
    m = temporal.mastery_history(t.attempts.filter("student_id = 3"), ["student_id", "lo_id"]).filter("system_to IS NULL").select("lo_id", "score")
    return rollup.subject_rollup(lin(t), m, F.expr(SLUG)).withColumn("mean_score", F.round("mean_score", 9))


@query("a8_last_check", "SELECT student_id, subject, arg_max(score, (created_at, id)) AS score FROM checks GROUP BY 1, 2")
def _(t):
    return rollup.latest_by(t.checks, ["student_id", "subject"], [F.col("created_at").desc(), F.col("id").desc()]).select("student_id", "subject", "score")


@query("a9_baseline_current", "SELECT student_id, lo_id, round(arg_min(score, n), 9) AS baseline, round(max(score) FILTER (system_to IS NULL), 9) AS current, min(system_from) AS baseline_at, max(system_from) FILTER (system_to IS NULL) AS current_at FROM mastery GROUP BY 1, 2")
def _(t):
    return temporal.baseline_current(t.mastery, ["student_id", "lo_id"]).withColumns({"baseline": F.round("baseline", 9), "current": F.round("current", 9)})


@query("a9b_dates_of_last_lo", "SELECT student_id, arg_max(f, lo_id) AS baseline_date FROM (SELECT student_id, lo_id, min(system_from) AS f FROM mastery GROUP BY 1, 2) GROUP BY 1")
def _(t):
    first = t.mastery.groupBy("student_id", "lo_id").agg(F.min("system_from").alias("f"))
    return first.groupBy("student_id").agg(F.max_by("f", "lo_id").alias("baseline_date"))


@query("a10_gallery", "SELECT e.src_id AS module_id, count(*) AS visuals, count(DISTINCT v.lo_id) AS los, arg_min(v.id, v.id) AS first_visual FROM visuals v JOIN cur e ON e.dst_id = v.lo_id AND e.edge_type = 'teaches' GROUP BY 1")
def _(t):
    m = t.current.filter("edge_type = 'teaches'").select(F.col("dst_id").alias("lo_id"), F.col("src_id").alias("module_id"))
    return t.visuals.join(m, "lo_id").groupBy("module_id").agg(F.count(F.lit(1)).alias("visuals"), F.count_distinct("lo_id").alias("los"), F.min("id").alias("first_visual"))


@query("a11_by_lo_and_tier", "SELECT lo_id, tier, count(*) AS n, min(id) AS first_id FROM questions GROUP BY 1, 2")
def _(t):
    return t.questions.groupBy("lo_id", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("a12_coverage_index", "SELECT lo_id, string_agg(tier || ' ' || n, ', ' ORDER BY tier) AS listing FROM (SELECT lo_id, tier, count(*) AS n FROM questions GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return rollup.pieces_of(rollup.counts_by(t.questions, ["lo_id", "tier"]).withColumn("p", F.concat_ws(" ", "tier", "n")), ["lo_id"], "p", "tier")


@query("a13_pages", "SELECT source_page FROM questions WHERE status = 'live' UNION SELECT source_page FROM visuals")
def _(t):
    return t.questions.filter("status = 'live'").select("source_page").union(t.visuals.select("source_page")).distinct()


@query("a14_mean_over_visible", "SELECT round(coalesce(sum(coalesce(m.score, 0)), 0) / greatest(count(*), 1), 9) AS mean FROM lo_keys k LEFT JOIN mastery m ON m.lo_id = k.lo_id AND m.student_id = 4 AND m.system_to IS NULL WHERE k.c_nationkey = 3")
def _(t):
    m = temporal.mastery_history(t.attempts.filter("student_id = 4"), ["student_id", "lo_id"]).filter("system_to IS NULL").select("lo_id", "score")
    return t.lo_keys.filter("c_nationkey = 3").join(m, "lo_id", "left").agg(F.round(F.coalesce(F.sum(F.coalesce("score", F.lit(0.0))), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 9).alias("mean"))


@query("a15_session_delta", "SELECT user_id, event_type, event_id // 1000 AS session, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS delta FROM events GROUP BY 1, 2, 3", prelude=False)
def _(t):
    e = t.raw("events").withColumn("session", F.expr("event_id div 1000"))
    return temporal.session_delta(e, ["user_id", "event_type", "session"], "value", ["ts", "event_id"]).select("user_id", "event_type", "session", F.round("delta", 6).alias("delta"))


@query("a16_session_turns", "SELECT conv_id, surface, count(*) FILTER (role = 'user') AS turns FROM turns GROUP BY 1, 2")
def _(t):
    return t.turns.groupBy("conv_id", "surface").agg(F.count_if(F.col("role") == "user").alias("turns"))


@query("a17_exclusive_topics", "SELECT dst_id AS topic FROM (SELECT src_id, 't:' || (id % 200) AS dst_id FROM cur WHERE edge_type = 'teaches') GROUP BY 1 HAVING bool_and(src_id IN (SELECT 'm:' || n_nationkey FROM nation WHERE n_regionkey < 4))")
def _(t):
    about = t.current.filter("edge_type = 'teaches'").selectExpr("src_id", "concat('t:', id % 200) AS topic")
    return rollup.exclusive(about, "topic", "src_id", t.raw("nation").filter("n_regionkey < 4").selectExpr("concat('m:', n_nationkey) AS id"))


@query("a18_snapshot_delta", "SELECT 'questions' AS name, (SELECT count(*) FROM questions) AS before, (SELECT count(*) FROM questions WHERE status = 'live') AS after, (SELECT count(*) FROM questions WHERE status = 'live') - (SELECT count(*) FROM questions) AS delta UNION ALL SELECT 'edges', (SELECT count(*) FROM edges), (SELECT count(*) FROM cur), (SELECT count(*) FROM cur) - (SELECT count(*) FROM edges)")
def _(t):
    return rollup.snapshot_delta(rollup.dashboard(questions=t.questions, edges=t.edges), rollup.dashboard(questions=t.questions.filter("status = 'live'"), edges=t.current), ["questions", "edges"])


@query("a19_status_listing", "SELECT status, count(*) AS n, string_agg(id, ', ' ORDER BY id) AS listing FROM questions GROUP BY 1")
def _(t):
    return t.questions.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.expr("listagg(id, ', ') WITHIN GROUP (ORDER BY id)").alias("listing"))


@query("a20_affected_rows", "SELECT count(*) AS promoted FROM questions WHERE status = 'review'")
def _(t):
    return t.questions.filter("status = 'review'").agg(F.count(F.lit(1)).alias("promoted"))


@query("a21_set_sizes", "SELECT lo_id, CAST(len(list_distinct(list(tier))) AS INT) AS tiers, CAST(count(*) AS INT) AS n FROM questions GROUP BY 1")
def _(t):
    return t.questions.groupBy("lo_id").agg(F.collect_list("tier").alias("a")).select("lo_id", F.size(F.array_distinct("a")).alias("tiers"), F.size("a").alias("n"))


@query("a22_validation_summary", "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", prelude=False)
def _(t):
    return t.raw("documents").select("doc_id", "source").join(t.raw("labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("a23_step_count", "SELECT vec_id, CAST(len(list_distinct(list_transform(embedding, lambda e, i: CASE WHEN e > 0 THEN CAST(floor(e * 20) AS INT) ELSE i END))) AS INT) AS steps FROM embeddings", prelude=False)
def _(t):
    return t.raw("embeddings").select("vec_id", F.size(F.array_distinct(F.transform("embedding", lambda e, i: F.when(e > 0, F.floor(e.cast("float") * 20).cast("int")).otherwise(i + 1)))).alias("steps"))


@query("a24_spend", "SELECT conv_id, surface, student_id, round(sum(coalesce(cost_usd, 0)), 6) AS usd, round(sum(coalesce(cost_usd, 0)) * 48, 6) AS local, count(*) AS turns FROM turns GROUP BY 1, 2, 3")
def _(t):
    usd = F.sum(F.coalesce("cost_usd", F.lit(0.0)))
    return t.turns.groupBy("conv_id", "surface", "student_id").agg(F.round(usd, 6).alias("usd"), F.round(usd * 48, 6).alias("local"), F.count(F.lit(1)).alias("turns"))


@query("a25_matrix", "SELECT o_orderpriority AS row_key, min(o_orderkey) FILTER (o_orderstatus = 'F') AS F, min(o_orderkey) FILTER (o_orderstatus = 'O') AS O, min(o_orderkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1", prelude=False)
def _(t):
    return rollup.matrix(t.raw("orders").withColumnRenamed("o_orderpriority", "row_key"), "row_key", "o_orderstatus", "o_orderkey", ["F", "O", "P"])


@query("a26_page_range", "SELECT lo_id, min(source_page) AS first_page, max(source_page) AS last_page FROM questions GROUP BY 1")
def _(t):
    return t.questions.groupBy("lo_id").agg(F.min("source_page").alias("first_page"), F.max("source_page").alias("last_page"))


# --- sorts, limits, sets -------------------------------------------------------------------------


@query("o1_nulls_last", LINEAGE + "SELECT lo_id, subject, row_number() OVER (ORDER BY subject NULLS LAST, module_order, order_in_parent, lo_id) AS place FROM lin")
def _(t):
    return rollup.places(lin(t).select("lo_id", "subject", "module_order", "order_in_parent"), [F.asc_nulls_last("subject"), "module_order", "order_in_parent", "lo_id"]).select("lo_id", "subject", "place")


@query("o2_preferred_first", "SELECT id, lo_id FROM questions WHERE status = 'live' ORDER BY (id = 'q:17') DESC, id LIMIT 1")
def _(t):
    return t.questions.filter("status = 'live'").orderBy(graph.pinned(F.col("id") == "q:17"), "id").limit(1).select("id", "lo_id")


@query("o3_latest_row", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1", prelude=False)
def _(t):
    return t.raw("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id")


@query("o4_first_document", "SELECT r_regionkey, r_name FROM region ORDER BY r_name, r_regionkey LIMIT 1", prelude=False)
def _(t):
    return t.raw("region").orderBy("r_name", "r_regionkey").limit(1)


@query("o5_stable_by_score", LINEAGE + "SELECT m.student_id, l.lo_id, l.subject, row_number() OVER (PARTITION BY m.student_id, l.subject ORDER BY m.score, l.module_order, l.order_in_parent, l.lo_id) AS place FROM lin l JOIN mastery m ON m.lo_id = l.lo_id AND m.system_to IS NULL")
def _(t):
    """Every student's scored LOs of every subject; equal scores keep the teaching order."""
    scored = temporal.current(t.mastery).select("student_id", "lo_id", "score").join(lin(t), "lo_id")
    place = F.row_number().over(Window.partitionBy("student_id", "subject").orderBy("score", "module_order", "order_in_parent", "lo_id"))
    return scored.select("student_id", "lo_id", "subject", place.alias("place"))


@query("o6_focus_set", "SELECT student_id, lo_id FROM (SELECT student_id, lo_id, row_number() OVER (PARTITION BY student_id ORDER BY (lo_id LIKE 'lo:%-3') DESC, score, lo_id) AS r FROM mastery WHERE system_to IS NULL) WHERE r <= 8")
def _(t):
    w = Window.partitionBy("student_id").orderBy(graph.pinned(F.col("lo_id").like("lo:%-3")), "score", "lo_id")
    return temporal.current(t.mastery).withColumn("r", F.row_number().over(w)).filter("r <= 8").select("student_id", "lo_id")


@query("o7_ranked_pick", """, tg AS (SELECT student_id, lo_id, CASE WHEN score < 0.4 THEN 'basic' WHEN score < 0.7 THEN 'standard' ELSE 'advanced' END AS target FROM mastery WHERE system_to IS NULL),
rc AS (SELECT student_id, question_id, count(*) AS recent FROM attempts GROUP BY 1, 2)
SELECT student_id, lo_id, target, question_id FROM (SELECT tg.*, q.id AS question_id, row_number() OVER (PARTITION BY tg.student_id, tg.lo_id ORDER BY (q.tier != tg.target), coalesce(rc.recent, 0), q.id) AS r FROM tg JOIN questions q ON q.lo_id = tg.lo_id AND q.status = 'live' LEFT JOIN rc ON rc.student_id = tg.student_id AND rc.question_id = q.id) WHERE r = 1""")
def _(t):
    targets = temporal.current(t.mastery).select("student_id", "lo_id", rollup.tier_for(F.col("score")).alias("target"))
    counts = t.attempts.groupBy("student_id", "question_id").agg(F.count(F.lit(1)).alias("recent"))
    live = t.questions.filter("status = 'live'").select("lo_id", F.col("id").alias("question_id"), "tier")
    return rollup.least_drilled(targets, live, counts)


@query("o8_pseudo_shuffle", "SELECT p_partkey, CAST(list_reduce(list_prepend(7, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda x, c: (x * 31 + c) % 100003) AS BIGINT) AS h FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", rollup.pseudo_shuffle_key(F.col("p_name")).alias("h"))


@query("o9_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3", prelude=False)
def _(t):
    return rollup.top_per_parent(t.raw("conversations").withColumn("back", -F.col("turn")), "conv_id", ["back"], 3).select("conv_id", "turn")


@query("o10_first_two_kinds", "SELECT lo_id, kind, r FROM (SELECT lo_id, kind, row_number() OVER (PARTITION BY lo_id ORDER BY f) AS r FROM (SELECT lo_id, kind, min(CAST(substr(id, 3) AS INT)) AS f FROM visuals GROUP BY 1, 2)) WHERE r <= 2")
def _(t):
    first = t.visuals.groupBy("lo_id", "kind").agg(F.min(F.expr("CAST(substr(id, 3) AS INT)")).alias("f"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("lo_id").orderBy("f"))).filter("r <= 2").select("lo_id", "kind", "r")


@query("o12_children_per_parent", "SELECT src_id, dst_id FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY id) AS r FROM cur WHERE edge_type = 'teaches') WHERE r <= 5")
def _(t):
    return rollup.top_per_parent(t.current.filter("edge_type = 'teaches'"), "src_id", ["id"], 5).select("src_id", "dst_id")


@query("o13_schedule", "SELECT vec_id, label, 100 + (dense_rank() OVER (PARTITION BY vec_id % 10 ORDER BY label) - 1) * 250 AS offset_ms FROM embeddings", prelude=False)
def _(t):
    e = t.raw("embeddings").withColumn("g", F.col("vec_id") % 10)
    return rollup.dense_schedule(e, ["g"], "label", 100, 250).select("vec_id", "label", F.col("offset").cast("long").alias("offset_ms"))


@query("s2_set_algebra", "SELECT id FROM ((SELECT lo_id AS id FROM lo_keys WHERE k % 3 = 0 UNION SELECT lo_id FROM lo_keys WHERE k % 5 = 0) INTERSECT (SELECT lo_id FROM lo_keys WHERE k % 2 = 0) EXCEPT (SELECT lo_id FROM lo_keys WHERE k % 7 = 0))")
def _(t):
    pick = lambda m: t.lo_keys.filter(f"k % {m} = 0").selectExpr("lo_id AS id")
    return pick(3).union(pick(5)).distinct().intersect(pick(2)).subtract(pick(7))


@query("s3_scalar_subqueries", "SELECT id, (SELECT count(*) FROM attempts) AS total FROM students")
def _(t):
    return t.students.select("id").crossJoin(t.attempts.agg(F.count(F.lit(1)).alias("total")))  # one row


@query("s4_correlated", "SELECT s.id, (SELECT count(*) FROM attempts a WHERE a.student_id = s.id AND a.is_correct) AS correct FROM students s")
def _(t):
    c = t.attempts.filter("is_correct").groupBy(F.col("student_id").alias("id")).agg(F.count(F.lit(1)).alias("correct"))
    return t.students.select("id").join(c, "id", "left").select("id", F.coalesce("correct", F.lit(0)).alias("correct"))


@query("s5_first_wins", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1", prelude=False)
def _(t):
    return rollup.latest_by(t.raw("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("s6_later_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1", prelude=False)
def _(t):
    return t.raw("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


# --- history -------------------------------------------------------------------------------------


@query("n2_mastery_history", "SELECT student_id, lo_id, n, round(score, 9) AS score, system_from, system_to FROM mastery")
def _(t):
    return t.mastery.withColumn("score", F.round("score", 9)).withColumn("n", F.col("n").cast("long"))


@query("b1_current_mastery", "SELECT student_id, lo_id, round(score, 9) AS score FROM mastery WHERE system_to IS NULL")
def _(t):
    return temporal.current(t.mastery).select("student_id", "lo_id", F.round("score", 9).alias("score"))


@query("b2_snapshot", "SELECT student_id, lo_id, round(score, 9) AS score FROM mastery WHERE system_from <= TIMESTAMP '2024-01-15' AND (system_to > TIMESTAMP '2024-01-15' OR system_to IS NULL)")
def _(t):
    return temporal.as_of(t.mastery, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("student_id", "lo_id", F.round("score", 9).alias("score"))


@query("b4_scoped_replace", "SELECT id, lo_id FROM questions WHERE lo_id NOT IN (SELECT lo_id FROM lo_keys WHERE c_nationkey = 3) UNION ALL SELECT 'new:' || lo_id, lo_id FROM lo_keys WHERE c_nationkey = 3")
def _(t):
    scope = t.lo_keys.filter("c_nationkey = 3")
    return temporal.scoped_replace(t.questions.select("id", "lo_id"), scope.selectExpr("concat('new:', lo_id) AS id", "lo_id"), scope, "lo_id")


@query("b5_cascade_counts", "SELECT 'questions' AS name, count(*) AS n FROM questions WHERE lo_id IN (SELECT lo_id FROM lo_keys WHERE c_nationkey = 3) UNION ALL SELECT 'visuals', count(*) FROM visuals WHERE lo_id IN (SELECT lo_id FROM lo_keys WHERE c_nationkey = 3) UNION ALL SELECT 'attempts', count(*) FROM attempts WHERE lo_id IN (SELECT lo_id FROM lo_keys WHERE c_nationkey = 3)")
def _(t):
    scope = t.lo_keys.filter("c_nationkey = 3").select("lo_id")
    parts = [df.join(scope, "lo_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("questions", t.questions), ("visuals", t.visuals), ("attempts", t.attempts))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b8_promote", "SELECT id, CASE WHEN status = 'review' THEN 'live' ELSE status END AS status FROM questions")
def _(t):
    return t.questions.select("id", F.when(F.col("status") == "review", "live").otherwise(F.col("status")).alias("status"))


@query("b9_bridge_reset", "SELECT id, edge_type FROM cur WHERE edge_type != 'relates_to' UNION ALL SELECT k, 'relates_to' FROM lo_keys WHERE k % 50 = 0")
def _(t):
    return t.current.filter("edge_type != 'relates_to'").select("id", "edge_type").unionByName(t.lo_keys.filter("k % 50 = 0").selectExpr("k AS id", "'relates_to' AS edge_type"))


@query("b10_add_column", "SELECT c.id, s.subject AS filled FROM checks c LEFT JOIN (SELECT lower(r_name) AS subject FROM region WHERE r_regionkey < 4) s ON s.subject = c.subject")
def _(t):
    known = t.raw("region").filter("r_regionkey < 4").selectExpr("lower(r_name) AS subject", "lower(r_name) AS filled")
    return t.checks.join(F.broadcast(known), "subject", "left").select("id", "filled")


@query("snk1_insert_new", "SELECT id, lo_id FROM (SELECT 'q:' || (o_orderkey % 20000) AS id, 'lo:x' || o_orderkey AS lo_id, row_number() OVER (PARTITION BY o_orderkey % 20000 ORDER BY o_orderkey) AS r FROM (SELECT o_orderkey * 3 AS o_orderkey FROM orders)) WHERE r = 1 AND id NOT IN (SELECT id FROM questions)")
def _(t):
    incoming = t.raw("orders").selectExpr("concat('q:', o_orderkey * 3 % 20000) AS id", "concat('lo:x', o_orderkey * 3) AS lo_id", "o_orderkey AS o")
    return temporal.insert_new(t.questions, incoming, "id", "o").select("id", "lo_id")


@query("snk4_question_status", "SELECT id, CASE WHEN status = 'draft' THEN 'review' ELSE status END AS status, CASE WHEN status = 'live' THEN 'loader' END AS reviewed_by FROM questions")
def _(t):
    return t.questions.select("id", F.when(F.col("status") == "draft", "review").otherwise(F.col("status")).alias("status"), F.when(F.col("status") == "live", "loader").alias("reviewed_by"))


@query("snk11_cache_key", "SELECT event_id, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS key FROM events", prelude=False)
def _(t):
    return t.raw("events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("key"))


# --- graph ---------------------------------------------------------------------------------------

PRE = "SELECT src_id, dst_id FROM cur WHERE edge_type = 'prerequisite'"


def pre(t):
    return t.current.filter("edge_type = 'prerequisite'").select("src_id", "dst_id")


@query("g1_layers", f", pre AS ({PRE}), lay AS (SELECT id, 0 AS layer FROM nodes WHERE kind = 'learning_objective' UNION SELECT p.dst_id, l.layer + 1 FROM lay l JOIN pre p ON p.src_id = l.id) SELECT id, max(layer) AS layer FROM lay GROUP BY 1")
def _(t):
    return graph.layers(t.nodes.filter("kind = 'learning_objective'"), pre(t))


@query("g2_descendants", ", reach AS (SELECT id AS root, id FROM nodes WHERE kind = 'course' UNION SELECT r.root, e.src_id FROM reach r JOIN cur e ON e.dst_id = r.id AND e.edge_type = 'part_of') SELECT root, id FROM reach")
def _(t):
    return graph.reachable(t.current.filter("edge_type = 'part_of'"), t.nodes.filter("kind = 'course'").selectExpr("id AS root"), forward=False)


@query("g3_ancestors", f", pre AS ({PRE}), reach AS (SELECT lo_id AS root, lo_id AS id FROM lo_keys UNION SELECT r.root, p.src_id FROM reach r JOIN pre p ON p.dst_id = r.id) SELECT root, id FROM reach")
def _(t):
    return graph.reachable(pre(t), t.lo_keys.selectExpr("lo_id AS root"), forward=False)


@query("g4_course_subtree", "SELECT 'c:1' AS id UNION SELECT src_id FROM cur WHERE edge_type = 'part_of' AND dst_id = 'c:1' UNION SELECT dst_id FROM cur WHERE edge_type = 'teaches' AND src_id IN (SELECT src_id FROM cur WHERE edge_type = 'part_of' AND dst_id = 'c:1')")
def _(t):
    return graph.course_subtree(t.nodes, t.current, "c:1")


@query("g5_prerequisite_chain", f", pre AS ({PRE}), ch AS (SELECT lo_id AS root, lo_id AS id, 0 AS depth FROM lo_keys UNION SELECT c.root, p.src_id, c.depth + 1 FROM ch c JOIN pre p ON p.dst_id = c.id) SELECT root, id, depth FROM ch WHERE depth > 0")
def _(t):
    return graph.prerequisite_chain(pre(t), t.lo_keys.selectExpr("lo_id AS root"))


@query("g6_cycles", ", e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), reach AS (SELECT a AS r, b AS x FROM e UNION SELECT r.r, e.b FROM reach r JOIN e ON e.a = r.x) SELECT DISTINCT r AS id FROM reach WHERE r = x")
def _(t):
    e = t.raw("nation").selectExpr("n_nationkey AS src_id", "(n_nationkey * 3 + 1) % 25 AS dst_id")
    return graph.cycle_members(e)


BACK = "(((k - 1) {0} 2 - 1) {0} 2 - 1) {0} 2"  # three steps up the tree


@query("g6_components", f""", e AS (SELECT (k - 1) // 2 AS a, k AS b FROM lo_keys WHERE k > 0 UNION ALL SELECT k, {BACK.format('//')} FROM lo_keys WHERE k % 40 = 39),
    reach AS (SELECT a AS r, b AS x FROM e UNION SELECT r.r, e.b FROM reach r JOIN e ON e.a = r.x) SELECT f.r AS id, min(f.x) AS component FROM reach f JOIN reach b ON b.r = f.x AND b.x = f.r GROUP BY 1""")
def _(t):
    tree = t.lo_keys.filter("k > 0").selectExpr("(k - 1) div 2 AS src_id", "k AS dst_id")
    back = t.lo_keys.filter("k % 40 = 39").selectExpr("k AS src_id", f"{BACK.format('div')} AS dst_id")
    return graph.cycle_components(tree.union(back))


@query("g7_adjacency", f"SELECT dst_id AS id, string_agg(src_id, ',' ORDER BY src_id) AS prerequisites FROM ({PRE}) GROUP BY 1")
def _(t):
    return graph.adjacency(pre(t)).withColumn("prerequisites", F.array_join("prerequisites", ","))


@query("g8_eligibility", f", pre AS ({PRE}), st AS (SELECT 1 AS student_id, lo_id FROM lo_keys) SELECT st.student_id, st.lo_id, bool_and(p.src_id IS NULL OR coalesce(m.score, 0) >= 0.5) AS eligible FROM st LEFT JOIN pre p ON p.dst_id = st.lo_id LEFT JOIN mastery m ON m.student_id = st.student_id AND m.lo_id = p.src_id AND m.system_to IS NULL GROUP BY 1, 2")
def _(t):
    pairs = t.lo_keys.selectExpr("CAST(1 AS BIGINT) AS student_id", "lo_id")  # one student
    return graph.eligibility(pairs, pre(t), temporal.current(t.mastery))


@query("g9_series", ", s AS (SELECT n_regionkey, 'm:' || n_nationkey AS id, lead('m:' || n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS dst FROM nation) SELECT id AS src_id, dst AS dst_id FROM s WHERE dst IN (SELECT id FROM nodes WHERE id != 'm:7') AND id != 'm:7'")
def _(t):
    series = t.raw("nation").selectExpr("n_regionkey AS g", "n_nationkey AS o", "concat('m:', n_nationkey) AS id")
    return graph.consecutive_edges(series, t.nodes.filter("id != 'm:7'"), ["g"], ["o"], "id")


@query("g10_lesson_chain", f"SELECT lo_id AS src_id, nxt AS dst_id FROM (SELECT lo_id, lead(lo_id) OVER (PARTITION BY {SLUG} ORDER BY k) AS nxt FROM lo_keys) WHERE nxt IS NOT NULL")
def _(t):
    series = t.lo_keys.selectExpr(f"{SLUG} AS g", "k AS o", "lo_id AS id")
    return graph.consecutive_edges(series, t.nodes, ["g"], ["o"], "id")


@query("g11_dangling", "SELECT id, src_id, dst_id FROM cur WHERE src_id NOT IN (SELECT id FROM nodes) OR dst_id NOT IN (SELECT id FROM nodes)")
def _(t):
    return graph.dangling(t.current, t.nodes).select("id", "src_id", "dst_id")


@query("g12_merge_installments", "SELECT n_regionkey AS topic, string_agg('a' || n_nationkey || ',b' || n_nationkey, ',' ORDER BY n_nationkey) AS clauses, count(*) AS installments FROM nation GROUP BY 1", prelude=False)
def _(t):
    rules = t.raw("nation").selectExpr("n_regionkey AS topic", "n_nationkey AS ord", "array(concat('a', n_nationkey), concat('b', n_nationkey)) AS clauses")
    return graph.merge_installments(rules, "topic", "clauses", "ord").withColumn("clauses", F.array_join("clauses", ","))


@query("o11_barycentric")
def _(t):
    los = t.nodes.filter("kind = 'learning_objective'")
    e = graph.both_present(pre(t), los)
    return graph.barycentric_order(los, e, graph.layers(los, e))
