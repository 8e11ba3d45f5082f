"""What the physical plans must and must not hold."""

import numpy as np
import pandas as pd

from tessera.plans import study_plan
from tessera.plans.study_plan import choose
from tessera.queries import QUERIES
from tessera.sources.domain import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Tables(spark, SF).raw("orders").filter("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_no_cartesian_products(spark):
    for name in ("j3_lineage", "j18_nearest_place", "a6_roster", "x15_contaminated", "o7_ranked_pick", "n2_mastery_history"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_plain_expressions_stay_in_the_jvm(spark):
    for name in ("n2_mastery_history", "n5_grade_slots", "n20_replays", "x4_fold_words", "c1_citations", "x15_contaminated"):
        text = plan(QUERIES[name](spark, SF))
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def row(lo, order, score, eligible, *questions):
    return {"student_id": 1, "lo_id": lo, "ord": order, "score": score, "eligible": eligible, "questions": [{"id": q, "tier": tier, "recent": n} for q, tier, n in questions]}


def picks(*rows):
    return [tuple(r) for r in choose(pd.DataFrame(rows))[["lo_id", "question_id", "reason"]].itertuples(index=False)]


def test_plan_goes_round_and_backfills():
    a = row("a", 1, 0.1, True, ("q1", "basic", 0), ("q2", "basic", 0), ("q3", "advanced", 0))
    b = row("b", 2, 0.2, True, ("q4", "basic", 3), ("q5", "basic", 0))
    assert picks(a, b) == [("a", "q1", "weakest"), ("b", "q5", "weakest"), ("a", "q2", "weakest"), ("a", "q3", "weakest"), ("b", "q4", "weakest")]


def test_plan_review_and_stretch():
    a = row("a", 1, 0.1, True, ("q1", "basic", 0))
    r = row("r", 2, 0.9, True, ("q2", "advanced", 0))
    s = row("s", 3, 0.0, False, ("q3", "standard", 0), ("q4", "basic", 5))
    assert picks(a, r, s) == [("a", "q1", "weakest"), ("r", "q2", "review"), ("s", "q4", "stretch"), ("s", "q3", "weakest")]


def test_plan_without_questions():
    assert picks(row("a", 1, 0.1, True), row("b", 2, 0.9, True)) == []


def test_pruned_plans_are_those_over_everything(spark):
    """Plans from the short lists against the choice among all LOs and questions, on random students."""
    rng = np.random.default_rng(5)
    for round_ in range(3):
        los = [(f"l{i:02d}", int(rng.integers(4))) for i in range(25)]
        pre = [(los[int(rng.integers(i))][0], los[i][0]) for i in range(3, 25) if rng.random() < 0.8 for _ in range(2)]
        pre = sorted(set(pre))
        students = list(range(12))
        scores = [(s, lo, float(rng.choice([0.02, 0.3, 0.5, 0.72, 0.9]))) for s in students for lo, _ in los if rng.random() < (0.0, 0.2, 0.9)[s % 3]]
        questions = [(f"q{i:03d}", lo, str(rng.choice(study_plan.TIERS))) for i, lo in enumerate(str(x) for x in rng.choice([x for x, _ in los[:: 1 + round_]], 60))]
        recent = [(s, q, int(rng.integers(1, 4))) for s in students for q, _, _ in questions if rng.random() < 0.3]
        got = study_plan.study_plan(
            spark.createDataFrame(los, "lo_id string, order_in_parent int"), spark.createDataFrame(pre, "src_id string, dst_id string"), spark.createDataFrame(scores, "student_id long, lo_id string, score double"),
            spark.createDataFrame(questions, "id string, lo_id string, tier string"), spark.createDataFrame(recent, "student_id long, question_id string, recent long"), spark.createDataFrame([(s,) for s in students], "id long"),
        ).collect()
        score, seen = {(s, lo): x for s, lo, x in scores}, {(s, q): n for s, q, n in recent}
        want = []
        for s in students:
            full = [{"student_id": s, "lo_id": lo, "ord": (o, lo), "score": score.get((s, lo), 0.0), "eligible": all(score.get((s, a), 0.0) >= study_plan.GATE for a, b in pre if b == lo),
                     "questions": [{"id": q, "tier": tier, "recent": seen.get((s, q), 0)} for q, of, tier in questions if of == lo]} for lo, o in los]
            want += list(choose(pd.DataFrame(full)).itertuples(index=False, name=None))
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 30


def test_plans_of_many_students_meet_short_lists(spark):
    """Students that have touched little, over many LOs: what is joined by place holds what they can reach, not all LOs; heads of banks are made once for each LO."""
    n, pupils = 400, 60
    los = spark.range(n).selectExpr("concat('l', lpad(id, 3, '0')) AS lo_id", "CAST(id AS INT) AS order_in_parent")
    pre = spark.range(n // 2, n).selectExpr("concat('l', lpad(id - 200, 3, '0')) AS src_id", "concat('l', lpad(id, 3, '0')) AS dst_id")
    scores = spark.range(pupils).selectExpr("id AS student_id", "'l000' AS lo_id", "CAST(0.9 AS DOUBLE) AS score")
    questions = spark.range(n * 9).selectExpr("concat('q', lpad(id, 4, '0')) AS id", "concat('l', lpad(id % 400, 3, '0')) AS lo_id", "element_at(array('basic', 'standard', 'advanced'), CAST(id % 3 AS INT) + 1) AS tier")
    recent = spark.range(pupils).filter("id % 2 = 0").selectExpr("id AS student_id", "'q0001' AS question_id", "2L AS recent")
    students = spark.range(pupils)
    met, cut = [], study_plan.graph.cut
    try:
        study_plan.graph.cut = lambda df: met.append(df) or cut(df)
        got = study_plan.study_plan(los, pre, scores, questions, recent, students).collect()
    finally:
        study_plan.graph.cut = cut
    lists = [df for df in met if "place" in df.columns]
    assert len(lists) == 3 and all(df.count() <= 2 + 2 * study_plan.ITEMS for df in lists)
    heads = [df for df in met if "_head" in df.columns]
    assert len(heads) == 1 and heads[0].count() < 40
    by = {s: [tuple(r)[2:] for r in sorted(got) if r.student_id == s] for s in range(pupils)}
    assert by[1] == [("l001", "q0801", "basic", "weakest"), ("l002", "q0402", "basic", "weakest"), ("l003", "q0003", "basic", "weakest"), ("l000", "q0800", "advanced", "review"), ("l201", "q0201", "basic", "stretch")]
    assert all(by[s] == by[1] for s in range(1, pupils, 2)) and all(len(x) == study_plan.ITEMS for x in by.values())
