"""Study plans: a short list of questions for each student.

What a choice can reach is found by joins and windows, a few LOs and questions for each student; the
greedy choice itself, which goes round and round over the weakest LOs, is sequential and runs per student on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph, rollup

GATE, REVIEW, ITEMS, WEAK = 0.5, 0.72, 5, 3
TIERS = ("basic", "standard", "advanced")
STUDENTS = 256  # that Python holds at a time
SCHEMA = "student_id long, position int, lo_id string, question_id string, tier string, reason string"


def target_tier(score: float) -> str:
    return "basic" if score < 0.4 else "standard" if score < 0.7 else "advanced"


def choose(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one student: LO, order, score, eligible, and the LO's questions as (recent, id, tier)."""
    rows = frame.to_dict("records")
    return pd.DataFrame([(int(rows[0]["student_id"]), i + 1, *x) for i, x in enumerate(chosen(rows))], columns=["student_id", "position", "lo_id", "question_id", "tier", "reason"])


def chosen(rows: list[dict]) -> list[tuple]:
    """(lo_id, question_id, tier, reason) of one student's choice, in order."""
    rows = sorted(rows, key=lambda r: tuple(r["ord"].values()) if isinstance(r["ord"], dict) else r["ord"])
    by_score = sorted(rows, key=lambda r: r["score"])
    weak = [r for r in by_score if r["eligible"] and r["score"] < REVIEW]
    review = sorted((r for r in rows if r["score"] >= REVIEW), key=lambda r: -r["score"])
    stretch = [r for r in by_score if not r["eligible"]]
    used: set[str] = set()
    items: list[tuple] = []

    def add(row: dict, reason: str, tier: str | None = None) -> None:
        tier = tier or target_tier(row["score"])
        free = [q for q in row["questions"] if q["id"] not in used]
        if free and len(items) < ITEMS:
            q = min(free, key=lambda q: (q["tier"] != tier, q["recent"], q["id"]))
            used.add(q["id"])
            items.append((row["lo_id"], q["id"], q["tier"], reason))

    at = 0
    while len(items) < WEAK and at < 2 * len(weak):
        add(weak[at % len(weak)], "weakest")
        at += 1
    if review:
        add(review[0], "review")
    if stretch:
        add(stretch[0], "stretch", "basic")
    for row in by_score:
        add(row, "weakest")
    return items


def _chosen_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Students (student_id, rows: what ``chosen`` takes), a few hundred at a time."""
    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, STUDENTS):
            out = [(s["student_id"], i + 1, *x) for s in batch.slice(at, STUDENTS).to_pylist() for i, x in enumerate(chosen(s["rows"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _first(df: DataFrame, keys: list[str], order: list, n: int | Column) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def _up_to(students: DataFrame, more: int, most: int, los: DataFrame) -> DataFrame:
    """(student_id and the columns of ``los``): the first ``_past + more`` LOs in teaching order for each student, met by place. ``most`` is the greatest ``_past``: what lies behind isn't kept, so that the list that all meet is short."""
    ranked = graph.cut(rollup.places(los, ["order_in_parent", "lo_id"]).filter(F.col("place") <= most + more))
    asked = students.select("student_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_past") + more)).alias("place"))
    return asked.join(ranked, "place").drop("place")


def candidates(los: DataFrame, prerequisites: DataFrame, scores: DataFrame, banked: DataFrame, students: DataFrame) -> DataFrame:
    """(student_id, lo_id, order_in_parent, score, eligible, has) of the LOs that the choice can look at, never students times LOs.

    What a student hasn't touched scores 0, so among those only the first in teaching order count:
    enough of the LOs without prerequisites, of all others, and of all with questions that as many as the
    student has touched or opened can be left out. Beside them stand the touched LOs and those that touched ones open.
    Many students meet the same few LOs, so what is known of a LO is joined to the distinct ones of them first. All rows of
    a student lie in one partition.
    """
    pre = graph.cut(prerequisites.select(F.col("dst_id").alias("lo_id"), F.col("src_id").alias("pre_id")).distinct())
    needs = pre.groupBy("lo_id").agg(F.count(F.lit(1)).alias("_needs"))
    los = graph.cut(los.select("lo_id", "order_in_parent").join(needs, "lo_id", "left").join(banked.select("lo_id", F.lit(True).alias("has")), "lo_id", "left").select("lo_id", "order_in_parent", "_needs", F.coalesce("has", F.lit(False)).alias("has")))
    students = graph.cut(students.select(F.col("id").alias("student_id")).distinct())
    scores = graph.cut(scores.join(students, "student_id", "left_semi").select("student_id", "lo_id", F.coalesce("score", F.lit(0.0)).alias("score")))
    touched = graph.cut(scores.select("lo_id").distinct().join(los, "lo_id"))
    behind = graph.cut(touched.select(F.col("lo_id").alias("pre_id")).join(pre, "pre_id").join(los, "lo_id"))
    known = graph.cut(scores.join(touched, "lo_id"))
    met = known.filter(F.col("score") >= GATE).select("student_id", F.col("lo_id").alias("pre_id")).join(behind, "pre_id")
    opened = graph.cut(met.groupBy("student_id", "lo_id", "order_in_parent", "_needs", "has").agg(F.count(F.lit(1)).alias("_met")).filter("_met = _needs").drop("_met"))
    n = students.join(rollup.counts_by(known, ["student_id"], "_known"), "student_id", "left").join(rollup.counts_by(opened, ["student_id"], "_opened"), "student_id", "left").fillna(0)
    n = graph.cut(n.select("student_id", (F.col("_known") + F.col("_opened")).alias("_past")))
    most = n.agg(F.max("_past")).first()[0] or 0
    first = [_up_to(n, WEAK, most, los.filter("_needs IS NULL AND has")), _up_to(n, 1, most, los.filter("_needs IS NOT NULL")), _up_to(n, 2 * ITEMS, most, los.filter("has"))]
    pairs = known.select("student_id", "lo_id", "order_in_parent", "_needs", "has", "score", F.lit(False).alias("_open"))
    for part, is_open in ((opened, True), *((p, False) for p in first)):
        pairs = pairs.unionByName(part.select("student_id", "lo_id", "order_in_parent", "_needs", "has", F.lit(None).cast("double").alias("score"), F.lit(is_open).alias("_open")))
    rows = pairs.repartition("student_id").groupBy("student_id", "lo_id", "order_in_parent", "_needs", "has").agg(F.max("score").alias("score"), F.max("_open").alias("_open"))
    return rows.select("student_id", "lo_id", "order_in_parent", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("_needs").isNull() | F.col("_open")).alias("eligible"), "has")


def shortlist(rows: DataFrame) -> DataFrame:
    """Of the candidates the LOs that the choice can reach: the first weak ones with questions, the first to review, the first to stretch to, and the weakest with questions."""
    weakest = ["score", "order_in_parent", "lo_id"]
    review = F.col("score") >= REVIEW
    kinds = [(F.col("eligible") & ~review & F.col("has"), weakest, WEAK), (review, [F.desc("score"), "order_in_parent", "lo_id"], 1), (~F.col("eligible"), weakest, 1), (F.col("has"), weakest, 2 * ITEMS)]
    rows = rows.select("*", *[kind.alias(f"_is{i}") for i, (kind, _, _) in enumerate(kinds)])
    rows = rows.select("*", *[F.row_number().over(Window.partitionBy("student_id", f"_is{i}").orderBy(*order)).alias(f"_n{i}") for i, (_, order, _) in enumerate(kinds)])
    within = [F.col(f"_is{i}") & (F.col(f"_n{i}") <= n) for i, (_, _, n) in enumerate(kinds)]
    return rows.filter(within[0] | within[1] | within[2] | within[3]).select("student_id", "lo_id", "order_in_parent", "score", "eligible", "has")


def study_plan(los: DataFrame, prerequisites: DataFrame, scores: DataFrame, questions: DataFrame, recent: DataFrame, students: DataFrame) -> DataFrame:
    """(student_id, position, lo_id, question_id, tier, reason).

    ``los`` (lo_id, order_in_parent), ``scores`` (student_id, lo_id, score; missing is 0), live
    ``questions`` (id, lo_id, tier), ``recent`` (student_id, question_id, recent), ``students`` (id).
    To the choice go at most ``WEAK + 2 + 2 * ITEMS`` LOs of a student and of each tier of those the
    ``ITEMS`` questions with the fewest recent attempts: no choice can reach beyond. What a student hasn't drilled is the same for
    all, so the head of a tier is made once for each LO; where they have drilled, the bank is met by its rank, so a student's rows don't grow with it.
    """
    questions = graph.cut(questions.select(F.col("id").alias("question_id"), "lo_id", "tier"))
    picked = graph.cut(shortlist(candidates(los, prerequisites, scores, questions.select("lo_id").distinct(), students)))
    keys = ["student_id", "lo_id", "tier"]
    drilled = graph.cut(recent.select("student_id", "question_id", F.col("recent").cast("long").alias("recent")).join(questions, "question_id").join(picked.select("student_id", "lo_id"), ["student_id", "lo_id"], "left_semi"))
    asked = graph.cut(picked.select("lo_id").distinct())
    bank = graph.cut(questions.join(asked, "lo_id", "left_semi").withColumn("_rank", F.row_number().over(Window.partitionBy("lo_id", "tier").orderBy("question_id"))))
    listed = lambda recent: F.collect_list(F.struct(F.col("question_id").alias("id"), "tier", recent.alias("recent")))
    heads = graph.cut(bank.filter(F.col("_rank") <= ITEMS).groupBy("lo_id").agg(listed(F.lit(0).cast("long")).alias("_head")))
    ranks = rollup.counts_by(drilled, keys, "_drilled").select(*keys, F.explode(F.sequence(F.lit(1), (F.col("_drilled") + ITEMS).cast("int"))).alias("_rank"))
    fresh = ranks.join(bank, ["lo_id", "tier", "_rank"]).select(*keys, "question_id").join(drilled.select("student_id", "question_id"), ["student_id", "question_id"], "left_anti").withColumn("recent", F.lit(0).cast("long"))
    few = _first(fresh.unionByName(drilled.select(*keys, "question_id", "recent")), keys, ["recent", "question_id"], ITEMS)
    lists = few.groupBy("student_id", "lo_id").agg(listed(F.col("recent")).alias("_own"), F.collect_set("tier").alias("_tiers"))
    none = F.expr("CAST(array() AS array<struct<id:string,tier:string,recent:bigint>>)")
    others = F.filter(F.coalesce("_head", none), lambda q: ~F.coalesce(F.array_contains("_tiers", q["tier"]), F.lit(False)))
    rows = picked.join(heads, "lo_id", "left").join(lists, ["student_id", "lo_id"], "left").withColumn("questions", F.concat(others, F.coalesce("_own", none)))
    of = rows.groupBy("student_id").agg(F.collect_list(F.struct("lo_id", F.struct("order_in_parent", "lo_id").alias("ord"), "score", "eligible", "questions")).alias("rows"))
    return of.mapInArrow(_chosen_of_all, SCHEMA)


def targets(scores: DataFrame) -> DataFrame:
    return scores.withColumn("target", rollup.tier_for(F.col("score")))
