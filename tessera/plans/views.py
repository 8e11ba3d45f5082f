"""Composite serving views, built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, rollup, temporal
from tessera.plans import study_plan


#: Graded attempts on live questions and the scores that they lead to, behind the prelude of the domain tables.
GRADED = """, ga AS (SELECT a.id, a.student_id, q.lo_id, a.question_id, a.given_answer, a.attempted_at, coalesce(CASE WHEN q.question_type = 'numeric' THEN abs(CAST(q.correct_answer AS DOUBLE) - CAST(a.given_answer AS DOUBLE)) < 1e-6 ELSE q.correct_answer = a.given_answer END, FALSE) AS correct FROM attempts a JOIN questions q ON q.id = a.question_id WHERE q.status = 'live'),
gn AS (SELECT *, row_number() OVER (PARTITION BY student_id, lo_id ORDER BY attempted_at, id) AS n FROM ga),
gf AS (SELECT student_id, lo_id, n, attempted_at, least(0.98, greatest(0.02, 0.3::DOUBLE + 0.15 * (correct::INT - 0.3::DOUBLE))) AS score FROM gn WHERE n = 1
  UNION ALL SELECT x.student_id, x.lo_id, x.n, x.attempted_at, least(0.98, greatest(0.02, f.score + 0.15 * (x.correct::INT - f.score))) FROM gf f JOIN gn x ON x.student_id = f.student_id AND x.lo_id = f.lo_id AND x.n = f.n + 1) """


def home_stats(t) -> DataFrame:
    """The counts of the start page, one row each."""
    parts = {"courses": t.nodes.filter("kind = 'course'"), "learning objectives": t.nodes.filter("kind = 'learning_objective'"), "edges": t.current, "live questions": t.questions.filter("status = 'live'"), "visuals": t.visuals}
    counts = rollup.dashboard(**parts)
    return counts.select(F.explode(F.create_map(*[x for name in parts for x in (F.lit(name), F.col(name))])).alias("name", "n"))


def scores_of(t, student_id: int) -> DataFrame:
    """(lo_id, score) of one student now; only that student's attempts are folded."""
    m = temporal.mastery_history(t.attempts.filter(F.col("student_id") == student_id), ["student_id", "lo_id"])
    return temporal.current(m).select("lo_id", "score")


def plan_of(t, students: DataFrame, los: DataFrame) -> DataFrame:
    """Study plans of the students over the given LOs (lo_id)."""
    los = graph.cut(los.select("lo_id"))
    info = t.nodes.select(F.col("id").alias("lo_id"), "order_in_parent").join(los, "lo_id")
    live = t.questions.filter("status = 'live'").join(los, "lo_id", "left_semi").select("id", "lo_id", "tier")
    pre = t.current.filter("edge_type = 'prerequisite'").select("src_id", "dst_id")
    recent = rollup.counts_by(t.attempts, ["student_id", "question_id"], "recent")
    return study_plan.study_plan(info, pre, temporal.current(t.mastery).select("student_id", "lo_id", "score"), live, recent, students)


def spine_los(t, student_id: int) -> DataFrame:
    """Every LO with its layer, subject, baseline and current score, and number of prerequisites and questions."""
    pre = t.current.filter("edge_type = 'prerequisite'").select("src_id", "dst_id")
    layered = graph.layers(t.nodes.filter("kind = 'learning_objective'"), pre).withColumnRenamed("id", "lo_id")
    m = temporal.mastery_history(t.attempts.filter(F.col("student_id") == student_id), ["student_id", "lo_id"])
    scores = temporal.baseline_current(m, ["lo_id"]).select("lo_id", "baseline", "current")
    n_pre = pre.groupBy(F.col("dst_id").alias("lo_id")).agg(F.count(F.lit(1)).alias("prerequisites"))
    n_q = t.questions.groupBy("lo_id").agg(F.count(F.lit(1)).alias("questions"))
    subject = graph.lineage(t.nodes, t.edges).select("lo_id", "subject")
    out = subject.join(layered, "lo_id").join(scores, "lo_id", "left").join(n_pre, "lo_id", "left").join(n_q, "lo_id", "left")
    return out.fillna(0, ["baseline", "current", "prerequisites", "questions"])


def lesson_catalog(t, slug: Column, student_id: int) -> DataFrame:
    """Lessons with their LOs, questions and mean score of one student."""
    q = t.questions.filter("status = 'live'").groupBy("lo_id").agg(F.count(F.lit(1)).alias("_q"))
    rows = t.lo_keys.select("lo_id").join(scores_of(t, student_id), "lo_id", "left").join(q, "lo_id", "left").withColumn("slug", slug)
    return rows.groupBy("slug").agg(F.count(F.lit(1)).alias("los"), F.sum(F.coalesce("_q", F.lit(0))).alias("questions"), (F.sum(F.coalesce("score", F.lit(0.0))) / F.count(F.lit(1))).alias("mean_score"), F.min("lo_id").alias("first_lo"))


def lesson_data(t, slug: str) -> DataFrame:
    """LOs of a lesson with label, live questions and visuals."""
    lo = t.nodes.filter(F.col("id").startswith(f"lo:{slug}-")).select(F.col("id").alias("lo_id"), "label")
    q = t.questions.filter("status = 'live'").groupBy("lo_id").agg(F.count(F.lit(1)).alias("questions"), F.min("source_page").alias("first_page"))
    v = t.visuals.groupBy("lo_id").agg(F.count(F.lit(1)).alias("visuals"))
    return lo.join(q, "lo_id", "left").join(v, "lo_id", "left").fillna(0, ["questions", "visuals"])


def focus_slice(t, student_id: int, k: int = 8) -> DataFrame:
    """The k weakest LOs of a student as lines of text."""
    from pyspark.sql import Window

    rows = t.nodes.select(F.col("id").alias("lo_id"), "label").join(scores_of(t, student_id), "lo_id")
    rank = F.row_number().over(Window.orderBy("score", "lo_id"))  # one student's LOs
    return rows.withColumn("place", rank).filter(F.col("place") <= k).select("place", F.concat_ws(" | ", "lo_id", "label", F.format_number("score", 2)).alias("line"))


def gallery(t) -> DataFrame:
    """Per module: kinds with their counts, most frequent first."""
    from pyspark.sql import Window

    m = t.current.filter("edge_type = 'teaches'").select(F.col("dst_id").alias("lo_id"), F.col("src_id").alias("module_id"))
    n = t.visuals.join(m, "lo_id").groupBy("module_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("n"), "kind")))


def visual_rows(t, ids: DataFrame | None = None, lo_ids: DataFrame | None = None) -> DataFrame:
    """Visuals with their LO and module and their place within the module (by the LO's order, then id): all, those of some ids (id), or those of some LOs (lo_id)."""
    from pyspark.sql import Window

    rows = t.visuals
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    if lo_ids is not None:
        rows = rows.join(lo_ids.select("lo_id"), "lo_id", "left_semi")
    lo = t.nodes.filter("kind = 'learning_objective'").select(F.col("id").alias("lo_id"), "label", "order_in_parent")
    m = t.current.filter("edge_type = 'teaches'").select(F.col("dst_id").alias("lo_id"), F.col("src_id").alias("module_id"))
    place = F.row_number().over(Window.partitionBy("module_id").orderBy("order_in_parent", "id"))
    return rows.join(lo, "lo_id").join(m, "lo_id", "left").select("id", "lo_id", "kind", "caption", "label", "module_id", place.alias("place"))


def pipeline_los(t, student_id: int) -> DataFrame:
    """Every LO with its layer and the score of one student (0 without one), in the order of layers."""
    pre = t.current.filter("edge_type = 'prerequisite'").select("src_id", "dst_id")
    los = t.nodes.filter("kind = 'learning_objective'")
    layered = graph.layers(los, pre)
    return los.select("id", "label").join(layered, "id").join(scores_of(t, student_id).withColumnRenamed("lo_id", "id"), "id", "left").select("id", "label", F.coalesce("layer", F.lit(0)).alias("layer"), F.coalesce("score", F.lit(0.0)).alias("score"))


def pipeline_facts(t, exemplar: str) -> DataFrame:
    """(name, value) of the overview's single facts: the newest extraction run, live and reviewed questions, the exemplar question (the preferred one if it is live, else the first) and its LO, the last chat turn."""
    q = t.questions.agg(F.count_if(F.col("status") == "live").alias("live"), F.count_if(F.col("status") != "draft").alias("reviewed"))
    one = t.questions.filter("status = 'live'").orderBy(graph.pinned(F.col("id") == exemplar), "id").limit(1)
    shown = one.join(t.nodes.select(F.col("id").alias("lo_id"), "label"), "lo_id")
    run = t.runs.agg(F.max_by("extractor", "id").alias("run"))
    turn = t.turns.agg(F.max_by("surface", F.struct("conv_id", "turn")).alias("turn"))
    rows = [q.select(F.explode(F.create_map(F.lit("live"), F.col("live").cast("string"), F.lit("reviewed"), F.col("reviewed").cast("string"))).alias("name", "value")), shown.select(F.explode(F.create_map(F.lit("exemplar"), F.col("id"), F.lit("exemplar lo"), F.col("label"))).alias("name", "value"))]
    rows += [run.select(F.lit("run").alias("name"), F.col("run").alias("value")), turn.select(F.lit("turn").alias("name"), F.col("turn").alias("value"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def attempt_result(t) -> DataFrame:
    """Attempts on live questions and the score of the question's LO behind them."""
    from tessera.functions import numbers

    q = t.questions.filter("status = 'live'").select(F.col("id").alias("question_id"), "lo_id", "question_type", "correct_answer")
    a = t.attempts.drop("lo_id").join(q, "question_id").withColumn("is_correct", numbers.grade(F.col("question_type"), F.col("correct_answer"), F.col("given_answer")))
    return temporal.mastery_history(a, ["student_id", "lo_id"]).select("student_id", "lo_id", "n", "score")


def register(query, slug: str, pre) -> None:
    lineage = ", lin AS (SELECT lo.id AS lo_id, c.subject FROM nodes lo LEFT JOIN cur t ON t.dst_id = lo.id AND t.edge_type = 'teaches' LEFT JOIN cur p ON p.src_id = t.src_id AND p.edge_type = 'part_of' LEFT JOIN nodes c ON c.id = p.dst_id WHERE lo.kind = 'learning_objective')"

    @query("q2_spine_los", lineage + """, pre AS (SELECT src_id, dst_id FROM cur WHERE edge_type = 'prerequisite'),
      lay AS (SELECT id, 0 AS layer FROM nodes WHERE kind = 'learning_objective' UNION SELECT p.dst_id, l.layer + 1 FROM lay l JOIN pre p ON p.src_id = l.id),
      top AS (SELECT id, max(layer) AS layer FROM lay GROUP BY 1), b AS (SELECT lo_id, arg_min(score, n) AS baseline, max(score) FILTER (system_to IS NULL) AS current FROM mastery WHERE student_id = 1 GROUP BY 1)
      SELECT lin.lo_id, subject, layer, round(coalesce(baseline, 0), 9) AS baseline, round(coalesce(current, 0), 9) AS current, (SELECT count(*) FROM pre WHERE dst_id = lin.lo_id) AS prerequisites, (SELECT count(*) FROM questions q WHERE q.lo_id = lin.lo_id) AS questions
      FROM lin JOIN top ON top.id = lin.lo_id LEFT JOIN b ON b.lo_id = lin.lo_id""")
    def _(t):
        return spine_los(t, 1).withColumns({"baseline": F.round("baseline", 9), "current": F.round("current", 9)})

    @query("q2_spine_bridges", "SELECT id, src_id, dst_id FROM cur WHERE edge_type = 'relates_to' AND dst_id IN (SELECT id FROM nodes)")
    def _(t):
        return graph.both_present(t.current.filter("edge_type = 'relates_to'"), t.nodes).select("id", "src_id", "dst_id")

    @query("q3_student_plan")
    def _(t):
        return plan_of(t, t.students, t.lo_keys)

    @query("q4_pipeline_overview", "SELECT kind AS name, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT edge_type, count(*) FROM cur GROUP BY 1 UNION ALL SELECT status, count(*) FROM questions GROUP BY 1")
    def _(t):
        parts = [rollup.counts_by(df.withColumnRenamed(c, "name"), ["name"]) for df, c in ((t.nodes, "kind"), (t.current, "edge_type"), (t.questions, "status"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @query("q5_subject_summaries", lineage + "SELECT subject, count(*) AS los, round(sum(coalesce(m.score, 0)) / count(*), 9) AS mean_score, (SELECT arg_max(c.score, (c.created_at, c.id)) FROM checks c WHERE c.student_id = 1 AND c.subject = lin.subject) AS last_check FROM lin LEFT JOIN mastery m ON m.lo_id = lin.lo_id AND m.student_id = 1 AND m.system_to IS NULL WHERE subject IS NOT NULL GROUP BY subject")
    def _(t):
        lin = graph.lineage(t.nodes, t.edges).select("lo_id", "subject").filter("subject IS NOT NULL").join(scores_of(t, 1), "lo_id", "left")
        last = rollup.latest_by(t.checks.filter("student_id = 1"), ["subject"], [F.desc("created_at"), F.desc("id")]).select("subject", F.col("score").alias("last_check"))
        out = lin.groupBy("subject").agg(F.count(F.lit(1)).alias("los"), F.round(F.sum(F.coalesce("score", F.lit(0.0))) / F.count(F.lit(1)), 9).alias("mean_score"))
        return out.join(last, "subject", "left")

    @query("q6_lesson_bridges", "SELECT b.src_id AS this_id, b.dst_id AS other_id, min(s.subject) AS subject FROM cur b JOIN node_subject s ON s.lo_id = b.dst_id WHERE b.edge_type = 'relates_to' AND b.src_id LIKE 'lo:u3-%' AND s.subject IS NOT NULL GROUP BY 1, 2 UNION SELECT b.dst_id, b.src_id, min(s.subject) FROM cur b JOIN node_subject s ON s.lo_id = b.src_id WHERE b.edge_type = 'relates_to' AND b.dst_id LIKE 'lo:u3-%' AND b.src_id NOT LIKE 'lo:u3-%' AND s.subject IS NOT NULL GROUP BY 1, 2")
    def _(t):
        here = t.nodes.filter(F.col("id").startswith("lo:u3-")).select("id")
        return graph.far_ends(t.current.filter("edge_type = 'relates_to'"), here, t.node_subject).select("this_id", "other_id", "subject")

    @query("q7_lesson_catalog", f"SELECT {slug.replace('lo_id', 'k.lo_id')} AS slug, count(*) AS los, CAST(sum((SELECT count(*) FROM questions q WHERE q.lo_id = k.lo_id AND q.status = 'live')) AS BIGINT) AS questions, round(sum(coalesce(m.score, 0)) / count(*), 9) AS mean_score, min(k.lo_id) AS first_lo FROM lo_keys k LEFT JOIN mastery m ON m.lo_id = k.lo_id AND m.student_id = 1 AND m.system_to IS NULL GROUP BY 1")
    def _(t):
        return lesson_catalog(t, F.expr(slug), 1).withColumn("mean_score", F.round("mean_score", 9))

    @query("q8_lesson_data", "SELECT n.id AS lo_id, n.label, (SELECT count(*) FROM questions q WHERE q.lo_id = n.id AND q.status = 'live') AS questions, (SELECT min(source_page) FROM questions q WHERE q.lo_id = n.id AND q.status = 'live') AS first_page, (SELECT count(*) FROM visuals v WHERE v.lo_id = n.id) AS visuals FROM nodes n WHERE n.id LIKE 'lo:u3-1-%'")
    def _(t):
        return lesson_data(t, "u3-1")

    @query("q9_focus_slice", "SELECT place, lo_id || ' | ' || label || ' | ' || printf('%.2f', score) AS line FROM (SELECT row_number() OVER (ORDER BY score, lo_id) AS place, lo_id, n.label, score FROM mastery JOIN nodes n ON n.id = lo_id WHERE student_id = 1 AND system_to IS NULL) WHERE place <= 8")
    def _(t):
        return focus_slice(t, 1)

    @query("q11_gallery", "SELECT module_id, kind, n, row_number() OVER (PARTITION BY module_id ORDER BY n DESC, kind) AS place FROM (SELECT e.src_id AS module_id, v.kind, count(*) AS n FROM visuals v JOIN cur e ON e.dst_id = v.lo_id AND e.edge_type = 'teaches' GROUP BY 1, 2)")
    def _(t):
        return gallery(t)

    @query("q12_roster", "SELECT s.id, count(a.id) AS attempts, coalesce(max(m.n), 0) AS open_rows FROM students s LEFT JOIN attempts a ON a.student_id = s.id LEFT JOIN (SELECT student_id, count(*) AS n FROM mastery WHERE system_to IS NULL GROUP BY 1) m ON m.student_id = s.id GROUP BY s.id")
    def _(t):
        return rollup.roster(t.students, t.attempts, t.mastery, t.lo_keys.agg(F.count(F.lit(1)).alias("n_los"))).select("id", "attempts", "open_rows")

    @query("q13_attempt_result", GRADED + "SELECT student_id, lo_id, n, round(score, 9) AS score FROM gf")
    def _(t):
        return attempt_result(t).withColumn("score", F.round("score", 9))

    @query("q15_content_status", "SELECT string_agg(status || '=' || n, ' ' ORDER BY status) AS listing FROM (SELECT status, count(*) AS n FROM questions GROUP BY 1)")
    def _(t):
        n = rollup.counts_by(t.questions, ["status"]).withColumn("g", F.lit(1)).withColumn("p", F.concat_ws("=", "status", "n"))
        return rollup.pieces_of(n, ["g"], "p", "status", " ").select("listing")

    @query("q16_audit", "SELECT 'V1' AS rule, count(*) AS n FROM edges WHERE dst_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'V31', count(*) FROM checks WHERE score > 90")
    def _(t):
        from tessera.operators import gates

        return gates.edge_endpoints(t.edges, t.nodes).unionByName(gates.in_range(t.checks, "score", 0, 90)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))

    @query("q4_pipeline_los", """, pre AS (SELECT src_id, dst_id FROM cur WHERE edge_type = 'prerequisite'), lay AS (SELECT id, 0 AS layer FROM nodes WHERE kind = 'learning_objective' UNION SELECT p.dst_id, l.layer + 1 FROM lay l JOIN pre p ON p.src_id = l.id)
      SELECT n.id, label, max(layer) AS layer, round(coalesce(max(m.score), 0), 9) AS score FROM nodes n JOIN lay ON lay.id = n.id LEFT JOIN mastery m ON m.lo_id = n.id AND m.student_id = 1 AND m.system_to IS NULL GROUP BY 1, 2""")
    def _(t):
        return pipeline_los(t, 1).withColumn("score", F.round("score", 9))

    @query("q4_pipeline_facts", """SELECT 'live' AS name, CAST(count(*) FILTER (status = 'live') AS VARCHAR) AS value FROM questions UNION ALL SELECT 'reviewed', CAST(count(*) FILTER (status != 'draft') AS VARCHAR) FROM questions
      UNION ALL SELECT unnest(['exemplar', 'exemplar lo']), unnest([id, label]) FROM (SELECT q.id, n.label FROM questions q JOIN nodes n ON n.id = q.lo_id WHERE q.status = 'live' ORDER BY (q.id = 'q:17') DESC, q.id LIMIT 1)
      UNION ALL SELECT 'run', arg_max(extractor, id) FROM runs UNION ALL SELECT 'turn', arg_max(surface, (conv_id, turn)) FROM turns""")
    def _(t):
        return pipeline_facts(t, "q:17")

    visuals = "SELECT v.id, v.lo_id, v.kind, v.caption, n.label, e.src_id AS module_id, row_number() OVER (PARTITION BY e.src_id ORDER BY n.order_in_parent, v.id) AS place FROM visuals v JOIN nodes n ON n.id = v.lo_id LEFT JOIN cur e ON e.dst_id = v.lo_id AND e.edge_type = 'teaches'"

    @query("q11_visuals", visuals)
    def _(t):
        return visual_rows(t)

    @query("q11_visuals_of_los", f"{visuals} WHERE v.lo_id IN (SELECT lo_id FROM lo_keys WHERE k % 3 = 0)")
    def _(t):
        return visual_rows(t, lo_ids=t.lo_keys.filter("k % 3 = 0"))

    @query("q11_visuals_by_id", f"{visuals} WHERE v.id IN (SELECT DISTINCT 'v:' || (event_id % 1000) FROM events)")
    def _(t):
        return visual_rows(t, ids=t.raw("events").selectExpr("concat('v:', event_id % 1000) AS id"))
