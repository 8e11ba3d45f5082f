"""Putting lesson drafts together to seed bundles, which ``loader.load`` takes as they are.

A draft lesson has subtopics, questions with answers as they were typed, visuals and passages. Assembly gives every part its
id, resolves answers to keys, lets questions inherit what their passages are, seals passages in their stored form and
draws the edges: module in course, LO in module, and each LO after the one before it, across lessons too.
``parts`` gives all of it as rows, none of which is longer for what else its lesson holds; the loader takes these. ``assemble``
gathers them to bundles, each of which is one row, as large as its lesson.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import gates, graph
from tessera.sources import bundles as B


def numbered_subtopics(lessons: DataFrame) -> DataFrame:
    """(lesson, module_id, ord, key, title, i, lo_id, before): the LOs in order, and the one before each within its module."""
    subs = lessons.select("lesson", "module_id", "ord", F.posexplode("subtopics").alias("_p", "s")).select("lesson", "module_id", "ord", "s.key", "s.title", (F.col("_p") + 1).alias("i"))
    subs = subs.withColumn("lo_id", F.concat(F.lit("lo:"), "lesson", F.lit("-"), F.col("i").cast("string")))
    inside = F.lag("lo_id").over(Window.partitionBy("lesson").orderBy("i"))
    # a lesson's first LO follows the last one of the lesson before: one row for each lesson meets its neighbour
    ends = subs.groupBy("module_id", "lesson", "ord").agg(F.max_by("lo_id", "i").alias("_last"))
    ends = ends.select("lesson", F.lag("_last").over(Window.partitionBy("module_id").orderBy("ord", "lesson")).alias("_across"))
    return subs.withColumn("_inside", inside).join(ends, "lesson").withColumn("before", F.coalesce("_inside", F.when(F.col("i") == 1, F.col("_across")))).drop("_inside", "_across")


def resolved(kind: Column, answer: Column, choices: Column) -> Column:
    """The key that an answer names (multiple choice), or the answer itself; null if there is none."""
    return F.when(kind == "mcq", N.mcq_key(answer, choices)).otherwise(F.nullif(F.trim(answer), F.lit("")))


def assembled_questions(drafts: DataFrame, subs: DataFrame, passages: DataFrame, bad_claims: DataFrame | None = None, n: int = 4) -> DataFrame:
    """Draft questions (lesson, key, n, type, tier, stem, choices, answer, reading, passage_id, source_page, claims) as (lesson, i, pos, fields of a bundle's question).

    Verified is one whose answer resolves and whose second reading (null: none was made) resolves to the same. One that is bound to a sacred passage,
    or quotes ``n`` words of one in its stem, is sealed. ``bad_claims`` (id, claim) go; a question of nothing but those goes too.
    """
    q = drafts.join(subs.select("lesson", "key", "i", "lo_id"), ["lesson", "key"])
    at = F.row_number().over(Window.partitionBy("lesson", "i").orderBy("n"))
    q = q.withColumn("pos", at).withColumn("id", F.concat(F.lit("q:"), "lesson", F.lit("-"), F.col("i").cast("string"), F.lit(":"), F.format_string("%03d", "pos")))
    if bad_claims is not None:
        q = gates.drop_claims(q, bad_claims)
    key, again = resolved(F.col("type"), F.col("answer"), F.col("choices")), resolved(F.col("type"), F.col("reading"), F.col("choices"))
    q = q.withColumn("correct_answer", key).withColumn("status", F.when(key.isNotNull() & (F.col("reading").isNull() | (key == again)), "verified").otherwise("draft"))
    q = graph.cut(q)  # answers are resolved once, for the check of quotes and for the rows
    sacred = passages.filter("sacred")
    # few or none; as tables of known size they don't make all questions move to meet them
    quoting = graph.cut(T.contaminated(q.select("id", "stem"), sacred.select(F.array_join("units", "\n").alias("text")), "id", "stem", "text", n).withColumn("_quotes", F.lit(True)))
    bound = graph.cut(sacred.select(F.col("id").alias("passage_id"), F.lit(True).alias("_bound")).distinct())
    q = q.join(quoting, "id", "left").join(bound, "passage_id", "left")
    return q.withColumn("sensitivity_class", F.when(F.coalesce("_quotes", "_bound", F.lit(False)), "sealed").otherwise("open"))


def sealed_passages(passages: DataFrame) -> DataFrame:
    """Passages (lesson, id, kind, sacred, units) in their stored form with their seals; one with a unit that can't be stored has no seal."""
    units = F.transform("units", lambda u, i: F.struct((i + 1).cast("int").alias("n"), F.lit(None).cast("int").alias("printed_n"), u.alias("text_ar")))
    # composed before the lambdas, which hold no Python
    stored = passages.select("*", F.posexplode_outer("units").alias("_n", "_u")).withColumn("_s", T.store_form(F.col("_u")))
    kept = stored.groupBy("lesson", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_s"))), lambda u: u["_s"]).alias("_units"), F.bool_and(F.col("_s").isNotNull() | F.col("_u").isNull()).alias("_fine"))
    out = passages.drop("units").join(kept.withColumnRenamed("_units", "units"), ["lesson", "id"])
    return out.select("lesson", "id", "kind", F.when(F.col("sacred"), "sealed").otherwise("open").alias("sensitivity_class"), units.alias("units"), F.when(F.col("_fine"), T.seal(F.col("units"))).alias("text_sha256"))


def _fields(kind: str, has: list[str]) -> list[Column]:
    """The fields of a bundle's type from the columns that there are; the others are null."""
    return [(F.col(n) if n in has else F.lit(None)).cast(t).alias(n) for n, t in B.fields_of(kind)]


def parts(lessons: DataFrame, questions: DataFrame, visuals: DataFrame, passages: DataFrame, course: tuple[str, str], source: tuple[str, str, str], bad_claims: DataFrame | None = None) -> B.Parts:
    """Parts of bundles, one for each lesson (lesson, module_id, module_title, ord, subtopics: array<struct<key, title>>) that has subtopics.

    ``visuals`` is (lesson, key, kind, spec, caption), ``course`` is (id, label), ``source`` is (sha256, title, file path). The first lesson declares the course and the source.
    """
    subs = graph.cut(numbered_subtopics(lessons))
    by_course, by_module = Window.orderBy("ord", "lesson"), Window.partitionBy("module_id").orderBy("ord", "lesson")
    listed = lessons.select("lesson", "module_id", "module_title", F.row_number().over(by_course).alias("ord"), (F.row_number().over(by_module) == 1).alias("_opens"))  # one row for each lesson
    first = F.col("ord") == 1
    heads = graph.cut(listed.join(subs.filter("i = 1").select("lesson", "before"), "lesson").select(
        "lesson", "module_id", "module_title", "_opens", F.concat(F.col("lesson"), F.lit(".json")).alias("file"), "ord",
        F.when(first, F.struct(*[F.lit(x).alias(n) for x, n in zip(source, ("sha256", "title", "file_path"), strict=True)])).alias("source_document"), F.when(~first, F.lit(source[2])).alias("source_file"),
        F.expr("named_struct('extractor', 'assembly', 'extractor_version', '1', 'schema_version', '1')").alias("extraction_run"), F.lit("v1").alias("syllabus_version"),
        F.array_compact(F.array(F.when(~first, F.lit(course[0])), F.when(~F.col("_opens"), F.col("module_id")), F.col("before"))).alias("external_node_refs"),
    ))

    def placed(rows: DataFrame, kind: str, *pos: str | Column) -> DataFrame:
        rows = rows.drop("ord").join(heads.select("lesson", "file", "ord"), "lesson")
        return rows.select("file", "ord", F.struct(*pos).alias("pos"), *_fields(kind, rows.columns))

    # (rank, n) orders what several tables give: the course, modules, LOs; what a module is part of, what it teaches, what comes before
    node = lambda rows, rank, n, id_, kind, label, at: rows.select("lesson", F.lit(rank).alias("_rank"), n.alias("_n"), id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), at.alias("order_in_parent"))
    edge = lambda rows, rank, n, src, dst, kind: rows.select("lesson", F.lit(rank).alias("_rank"), n.alias("_n"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    opening, one, i, lo, module = heads.filter("_opens"), F.lit(1), F.col("i"), F.col("lo_id"), F.col("module_id")
    nodes = gates.all_of(
        node(heads.filter(first), 0, one, F.lit(course[0]), "course", F.lit(course[1]), one),
        node(opening, 1, one, module, "module", F.col("module_title"), F.col("ord")),
        node(subs, 2, i, lo, "learning_objective", F.col("title"), i),
    )
    edges = gates.all_of(
        edge(opening, 0, one, module, F.lit(course[0]), "part_of"),
        edge(subs, 1, i, module, lo, "teaches"),
        edge(subs.filter("before IS NOT NULL"), 2, i, F.col("before"), lo, "prerequisite"),
    )
    q = assembled_questions(questions, subs, passages, bad_claims)
    v = visuals.join(subs.select("lesson", "key", "i", "lo_id"), ["lesson", "key"]).withColumn("_n", F.row_number().over(Window.partitionBy("lesson", "i").orderBy("kind", "caption", "spec")))
    v = v.withColumn("id", F.concat(F.lit("v:"), "lesson", F.lit("-"), F.col("i").cast("string"), F.lit(":"), F.format_string("%03d", "_n")))
    p = sealed_passages(passages)
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("lesson", "id").orderBy(*_fields(B.PASSAGE, p.columns))))
    return B.Parts(
        heads.select(*B.HEAD, "external_node_refs"), placed(nodes, B.NODE, "_rank", "_n"), placed(edges, B.EDGE, "_rank", "_n"),
        placed(q, B.QUESTION, "i", F.col("pos").alias("n")), placed(v, B.VISUAL, "i", "_n"), placed(p, B.PASSAGE, "id", "_n"),
    )


def assemble(lessons: DataFrame, questions: DataFrame, visuals: DataFrame, passages: DataFrame, course: tuple[str, str], source: tuple[str, str, str], bad_claims: DataFrame | None = None) -> DataFrame:
    """Bundles (as ``bundles.read_bundles`` gives them) of the parts of lessons, one row for each lesson."""
    return B.gathered(parts(lessons, questions, visuals, passages, course, source, bad_claims))
