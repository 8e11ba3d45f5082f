"""Aggregations, rankings and set operations of the serving views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph


def counts_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def dashboard(**tables: DataFrame) -> DataFrame:
    """One row of independent counts."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def rank_label(score: Column) -> Column:
    return F.when(score >= 0.75, "strong").when(score >= 0.5, "developing").when(score >= 0.3, "emerging").otherwise("weak")


def half_up(x: Column) -> Column:
    """Round half up to an integer."""
    return F.floor(x + 0.5)


def tier_for(score: Column) -> Column:
    return F.when(score < 0.4, "basic").when(score < 0.7, "standard").otherwise("advanced")


def recent_counts(questions: DataFrame, attempts: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """(student_id, question_id, recent): attempts on the given questions (id) within a window before ``as_of``; pairs without any have no row."""
    recent = attempts.filter(F.col("attempted_at") > as_of - F.expr(f"INTERVAL {days} DAYS")).groupBy("student_id", "question_id").agg(F.count(F.lit(1)).alias("recent"))
    return recent.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi").select("student_id", "question_id", "recent")


def recent_for(student: Column, questions: DataFrame, recent: DataFrame) -> DataFrame:
    """One student's view of ``recent_counts``: every question, 0 where there are no attempts."""
    mine = recent.filter(F.col("student_id") == student).select("question_id", "recent")
    return questions.select(F.col("id").alias("question_id")).join(mine, "question_id", "left").fillna(0, ["recent"])


def places(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with its place (from 1) in a whole order: ranges of the order are numbered on their own and begin behind the rows of those before them, so no task holds all rows."""
    ranged = graph.cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))  # one row for each range
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(before, "_range").withColumn(name, F.col("_before") + F.col("_n")).drop("_range", "_before", "_n")


def roster(students: DataFrame, attempts: DataFrame, mastery: DataFrame, n_los: DataFrame) -> DataFrame:
    """Every student with attempts, open mastery rows, and the sum of open scores over ALL LOs."""
    a = attempts.groupBy(F.col("student_id").alias("id")).agg(F.count(F.lit(1)).alias("attempts"))
    m = mastery.filter("system_to IS NULL").groupBy(F.col("student_id").alias("id")).agg(F.count(F.lit(1)).alias("open_rows"), F.sum("score").alias("_sum"))
    base = students.select("id", "display_name").join(a, "id", "left").join(m, "id", "left").crossJoin(n_los)  # one row
    return base.select("id", "display_name", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("open_rows", F.lit(0)).alias("open_rows"), (F.coalesce("_sum", F.lit(0.0)) / F.greatest(F.col("n_los"), F.lit(1))).alias("average"))


def subject_rollup(lineage: DataFrame, scores: DataFrame, slug: Column) -> DataFrame:
    """Per subject: LOs, mean score (missing is 0), distinct lessons, first lesson in teaching order, weakest LO (first wins). ``scores`` is (lo_id, score)."""
    ord_ = F.struct("module_order", "order_in_parent", "lo_id")
    rows = lineage.filter("subject IS NOT NULL").join(scores, "lo_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("_slug", slug)
    return rows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("los"), (F.sum("score") / F.count(F.lit(1))).alias("mean_score"), F.count_distinct("_slug").alias("lessons"),
        F.min_by("_slug", ord_).alias("first_lesson"), F.min_by("lo_id", F.struct(F.col("score"), ord_)).alias("weakest"),
    )


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_per_parent(df: DataFrame, parent: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def dense_schedule(df: DataFrame, partition: list[str], step: str, base: int, gap: int) -> DataFrame:
    """Offset of each step value: base plus gap for each distinct value before it."""
    return df.withColumn("offset", F.lit(base) + (F.dense_rank().over(Window.partitionBy(*partition).orderBy(step)) - 1) * gap)


def exclusive(edges: DataFrame, group: str, member: str, allowed: DataFrame) -> DataFrame:
    """Groups all of whose members are in ``allowed`` (id)."""
    known = edges.join(allowed.select(F.col("id").alias(member), F.lit(True).alias("_in")), member, "left")
    return known.groupBy(group).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("_all")).filter("_all").select(group)


def coverage_tally(topics: DataFrame, claims: DataFrame, questions: DataFrame, most: int = 40) -> DataFrame:
    """For each topic (key): its claims and questions, and the first ``most`` claim texts; the verdict on them (covered, thin, missing) is not a count and is left to the reader."""
    order = Window.partitionBy("key").orderBy("ord")
    first = claims.withColumn("_n", F.row_number().over(order))
    texts = first.groupBy("key").agg(F.count(F.lit(1)).alias("claims_count"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "text")))).alias("_texts"))
    texts = texts.select("key", "claims_count", F.transform("_texts", lambda x: x["text"]).alias("claim_texts"))
    out = topics.select("key").join(texts, "key", "left").join(counts_by(questions, ["key"], "questions_count"), "key", "left").fillna(0, ["claims_count", "questions_count"])
    return out.withColumn("claim_texts", F.coalesce("claim_texts", F.expr("CAST(array() AS array<string>)")))


def snapshot_delta(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """Before, after and change of one-row counts, one row for each name."""
    stack = ", ".join(f"'{n}', `{n}`" for n in names)
    b = before.selectExpr(f"stack({len(names)}, {stack}) AS (name, before)")
    a = after.selectExpr(f"stack({len(names)}, {stack}) AS (name, after)")
    return b.join(a, "name").withColumn("delta", F.col("after") - F.col("before"))


def pseudo_shuffle_key(key: Column, seed: int = 7) -> Column:
    """Order key of the deterministic shuffle: x = (x * 31 + code point) mod 100003 over the key's characters."""
    return F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(seed).cast("long"), lambda x, c: (x * 31 + F.ascii(c)) % 100003)


def ranked_pick(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (student_id, lo_id, target): the question with the target tier first, then fewest recent attempts, then id."""
    rows = targets.join(questions, "lo_id")
    rank = F.row_number().over(Window.partitionBy("student_id", "lo_id").orderBy((F.col("tier") != F.col("target")).cast("int"), "recent", "question_id"))
    return rows.withColumn("_n", rank).filter("_n = 1").drop("_n")


def matrix(cells: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Cells laid out over declared columns."""
    return cells.groupBy(row).pivot(column, columns).agg(F.min(value))


def product_with_decoys(left: DataFrame, right: DataFrame, most: int = 4, decoys: int = 3) -> DataFrame:
    """All pairs of two short lists (at most ``most`` each, by their order), then decoys that are no such pair: (y, x), (x, x), (y, y)."""
    x = left.select(F.col("v").alias("x")).distinct().orderBy("x").limit(most)
    y = right.select(F.col("v").alias("y")).distinct().orderBy("y").limit(most)
    pairs = x.crossJoin(y)  # at most most * most rows
    swapped = pairs.select(F.lit(0).alias("_o"), F.col("y").alias("x"), F.col("x").alias("y"))
    twice = x.select(F.lit(1).alias("_o"), "x", F.col("x").alias("y")).unionByName(y.select(F.lit(2).alias("_o"), F.col("y").alias("x"), "y"))
    fake = swapped.unionByName(twice).groupBy("x", "y").agg(F.min("_o").alias("_o")).join(pairs, ["x", "y"], "left_anti").orderBy("_o", "x", "y").limit(decoys)
    return pairs.withColumn("is_pair", F.lit(True)).unionByName(fake.select("x", "y", F.lit(False).alias("is_pair")))


def pieces_of(df: DataFrame, keys: list[str], part: str, order: str, sep: str = ", ") -> DataFrame:
    """Ordered text of each group."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(part).alias("_p")))), lambda r: r["_p"]), sep).alias("listing"))


def least_drilled(targets: DataFrame, bank: DataFrame, drilled: DataFrame, tiers: tuple[str, ...] = ("basic", "standard", "advanced")) -> DataFrame:
    """(student_id, lo_id, target, question_id): for each target (student_id, lo_id, target) the question of its LO that is of the target tier (of any other if there is none), least drilled, of least id.

    ``bank`` is (lo_id, question_id, tier), ``drilled`` is (student_id, question_id, recent). The bank is numbered once for each LO and
    target; a student meets the questions that they have drilled and the first one that they haven't, by its number, so
    students never meet the whole bank.
    """
    wanted = F.explode(F.array(*map(F.lit, tiers))).alias("target")
    offered = bank.select("lo_id", "question_id", "tier", wanted).withColumn("_other", F.col("tier") != F.col("target"))
    of = Window.partitionBy("lo_id", "target")
    ranked = offered.withColumn("_least", F.min("_other").over(of)).filter("_other = _least").withColumn("_rank", F.row_number().over(of.orderBy("question_id"))).select("lo_id", "target", "question_id", "_rank")
    known = drilled.join(ranked, "question_id").join(targets, ["student_id", "lo_id", "target"])
    by_rank = Window.partitionBy("student_id", "lo_id").orderBy("_rank")
    gaps = known.withColumn("_i", F.row_number().over(by_rank)).groupBy("student_id", "lo_id").agg(
        F.coalesce(F.min(F.when(F.col("_rank") > F.col("_i"), F.col("_i"))), (F.max("_i") + 1).cast("int")).alias("_gap"), F.min_by("question_id", F.struct("recent", "question_id")).alias("_again"),
    )
    asked = targets.join(gaps, ["student_id", "lo_id"], "left").withColumn("_rank", F.coalesce("_gap", F.lit(1)))
    fresh = asked.join(ranked, ["lo_id", "target", "_rank"], "left")
    return fresh.withColumn("question_id", F.coalesce("question_id", "_again")).filter("question_id IS NOT NULL").select("student_id", "lo_id", "target", "question_id")
