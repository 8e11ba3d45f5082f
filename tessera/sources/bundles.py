"""Seed bundles and lesson files: JSON documents with nested arrays, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graph

NODE = "struct<id:string,kind:string,label:string,description:string,syllabus_ref:string,order_in_parent:int,source_page:int>"
EDGE = "struct<src:string,dst:string,type:string>"
CHOICE = "struct<key:string,text:string>"
QUESTION = f"struct<id:string,lo_id:string,tier:string,type:string,stem:string,choices:array<{CHOICE}>,correct_answer:string,status:string,source_page:int,passage_id:string,sensitivity_class:string>"
VISUAL = "struct<id:string,lo_id:string,question_id:string,kind:string,spec:string,caption:string>"
UNIT = "struct<n:int,printed_n:int,text_ar:string>"
PASSAGE = f"struct<id:string,kind:string,fidelity:string,sensitivity_class:string,units:array<{UNIT}>,text_sha256:string,approved_by:string,approved_sha256:string>"
BUNDLE = (
    "source_document struct<sha256:string,title:string,file_path:string>, source_file string, extraction_run struct<extractor:string,extractor_version:string,schema_version:string>, syllabus_version string, "
    f"nodes array<{NODE}>, edges array<{EDGE}>, questions array<{QUESTION}>, visuals array<{VISUAL}>, text_passages array<{PASSAGE}>, external_node_refs array<string>"
)
LESSON = (
    "lessonId string, title string, subtopics array<struct<key:string,title:string,exposition:string>>, key_terms array<struct<term_ar:string,definition_ar:string>>, "
    "passages array<struct<id:string,kind:string,title_ar:string,sacred:boolean,units:array<string>>>, out_of_scope array<struct<text:string,reason:string>>, _corrupt_record string"
)
SLUG = "^[a-z0-9]{1,12}-[0-9]{1,3}$"
#: Of a bundle: the lists of content with the type of an element, and the rest.
LISTS = {"nodes": NODE, "edges": EDGE, "questions": QUESTION, "visuals": VISUAL, "text_passages": PASSAGE}
HEAD = ["file", "ord", "source_document", "source_file", "extraction_run", "syllabus_version"]


def fields_of(kind: str) -> list[tuple[str, str]]:
    """(name, type) of the fields of a struct type."""
    parts, depth = [""], 0
    for ch in kind[len("struct<") : -1]:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [tuple(p.split(":", 1)) for p in parts]


def widened(df: DataFrame, column: str, kind: str) -> Column:
    """An array of structs as one of the struct type ``kind``: fields by name, null where there is none."""
    has = df.schema[column].dataType.elementType.fieldNames()
    return F.transform(column, lambda x: F.struct(*[(x[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in fields_of(kind)]))


def read_bundles(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """Bundles (files that have an extraction run) with ``file`` and ``ord``: the listed files in their order, unknown ones behind them by name."""
    rows = spark.read.schema(BUNDLE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter("extraction_run IS NOT NULL")
    rows = rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    known = spark.createDataFrame([(f, i) for i, f in enumerate(order)] or [("", 0)], "file string, _o int")
    rows = rows.join(F.broadcast(known), "file", "left")
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(F.col("_o").asc_nulls_last(), "file"))).withColumn("listed", F.col("_o").isNotNull()).drop("_o")  # one row for each file


def unfolded(bundles: DataFrame, name: str) -> DataFrame:
    """All elements of one array of the bundles with file and load order."""
    return bundles.select("file", "ord", F.posexplode(name).alias("pos", "x")).select("file", "ord", "pos", "x.*")


@dataclass(frozen=True)
class Parts:
    """Bundles as rows, none of which is longer for what else its file holds: ``heads`` (``HEAD`` and external_node_refs) has one for each file, the others (file, ord, pos, fields) one for each element; ``pos`` orders those of a file."""

    heads: DataFrame
    nodes: DataFrame
    edges: DataFrame
    questions: DataFrame
    visuals: DataFrame
    text_passages: DataFrame


def parts(bundles: DataFrame) -> Parts:
    return Parts(bundles.select(*HEAD, "external_node_refs"), **{name: unfolded(bundles, name) for name in LISTS})


def gathered(p: Parts) -> DataFrame:
    """Bundles of their parts, one row for each file."""
    out = p.heads
    for name, kind in LISTS.items():
        fields = F.struct(*[n for n, _ in fields_of(kind)])
        lists = getattr(p, name).groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", fields.alias("_x")))), lambda r: r["_x"]).alias(name))
        out = out.join(lists, "ord", "left").withColumn(name, F.coalesce(name, F.expr(f"CAST(array() AS array<{kind}>)")))
    return out.select(*HEAD, *LISTS, "external_node_refs")


def first_of_each(rows: DataFrame) -> DataFrame:
    """The first of equal ids, in load order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ord", "pos"))).filter("_n = 1").drop("_n")


def part(bundles: DataFrame, name: str) -> DataFrame:
    """Elements of one array of the bundles with file and load order; the first of equal ids wins."""
    rows = unfolded(bundles, name)
    return first_of_each(rows) if "id" in rows.columns else rows


def bundles_for_root(bundles: DataFrame, root: str, superseded: list[str] | None = None) -> DataFrame:
    """Bundles that define a node of a course's subtree, without superseded files."""
    edges = part(bundles, "edges").select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("type").alias("edge_type"))
    nodes = part(bundles, "nodes")
    inside = graph.course_subtree(nodes, edges, root)
    files = bundles.select("file", F.explode("nodes.id").alias("id")).join(inside, "id", "left_semi").select("file").distinct()
    return bundles.join(files, "file", "left_semi").filter(~F.col("file").isin(superseded or [""]))


def read_lessons(spark: SparkSession, path: str, lesson_id: str | None = None) -> DataFrame:
    """Lesson files; corrupt ones and ids outside of the grammar go, missing sections are empty lists."""
    rows = spark.read.schema(LESSON).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.filter(F.col("_corrupt_record").isNull() & F.col("lessonId").rlike(SLUG)).drop("_corrupt_record")
    for c, kind in rows.dtypes:
        if kind.startswith("array"):
            rows = rows.withColumn(c, F.coalesce(c, F.expr(f"CAST(array() AS {kind})")))
    return rows if lesson_id is None else rows.filter(F.col("lessonId") == lesson_id)


def sealed_corpus(lessons: DataFrame) -> DataFrame:
    """Every sealed passage as one text, units joined by line breaks."""
    p = lessons.select("lessonId", F.explode("passages").alias("p")).filter("p.sacred")
    return p.select("lessonId", F.col("p.id").alias("id"), F.array_join("p.units", "\n").alias("text"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of a gazetteer file: (place, kind, px, py, r, aliases)."""
    rows = spark.read.schema("places map<string, struct<kind:string,at:array<double>,r:double,aliases:array<string>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("places").alias("place", "p")).select("place", "p.kind", F.col("p.at")[0].alias("px"), F.col("p.at")[1].alias("py"), "p.r", "p.aliases")


def names_by_kind(places: DataFrame, kinds: list[str]) -> DataFrame:
    """Names of each kind in a fixed order of kinds."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return places.groupBy("kind").agg(F.array_sort(F.collect_list("place")).alias("names")).withColumn("ord", rank).filter("ord > 0")


def reference_units(spark: SparkSession, path: str, citations: DataFrame, book: str = "book", first: str = "first", last: str = "last") -> DataFrame:
    """Units of local reference files, JSON arrays of (key ``book:n``, text), for citations (id, book, first, last): (id, units) in order, without citations of which a unit is missing."""
    known = spark.read.schema("key string, text string").option("multiLine", True).json(path)
    wanted = citations.select("id", F.posexplode(F.sequence(F.col(first), F.col(last))).alias("_at", "_n"), F.col(book).alias("_book"))
    found = wanted.withColumn("key", F.concat_ws(":", "_book", "_n")).join(known, "key", "left")
    whole = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_units"), F.bool_and(F.col("text").isNotNull()).alias("_all"))
    return whole.filter("_all").select("id", F.transform("_units", lambda u: u["text"]).alias("units"))


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def optional(df: DataFrame, column: str, kind: str) -> Column:
    """A column if the table has it, else nulls."""
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)
