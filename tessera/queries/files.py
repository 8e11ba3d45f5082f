"""Queries over files: bundles, lessons, gazetteers and snapshots that are written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.queries.registry import query
from tessera.sources import bundles, sinks


def one_file_each(t, rows, name: str) -> str:
    """Write every text of a column ``value`` as a file of its own in the shared folder."""
    path = f"{sinks.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def written_bundles(t):
    """One bundle for each course, with its modules and their edges, and one file that is no bundle."""
    node = lambda id_, kind, label: F.struct(id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    course, module = F.concat(F.lit("c:"), "r_regionkey"), F.concat(F.lit("m:"), "n_nationkey")
    run = F.struct(F.lit("x").alias("extractor"), F.lit("1").alias("extractor_version"), F.lit("1").alias("schema_version"))
    rows = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(
        F.collect_list(node(module, "module", F.col("n_name"))).alias("modules"), F.collect_list(F.struct(module.alias("src"), course.alias("dst"), F.lit("part_of").alias("type"))).alias("edges"))
    body = F.struct(run.alias("extraction_run"), F.concat(F.array(node(course, "course", F.col("r_name"))), "modules").alias("nodes"), "edges")
    files = rows.select(F.to_json(body).alias("value")).unionByName(t.spark.createDataFrame([('{"hello": 1}',)], "value string"))
    return bundles.read_bundles(t.spark, one_file_each(t, files, "bundles"), [])


@query("src2_bundles", "SELECT id, kind, label FROM nodes WHERE kind IN ('course', 'module')")
def _(t):
    return bundles.part(written_bundles(t), "nodes").select("id", "kind", "label")


@query("src3_bundles_for_course", "SELECT 'c:1' AS id UNION ALL SELECT 'm:' || n_nationkey FROM nation WHERE n_regionkey = 1", prelude=False)
def _(t):
    return bundles.part(bundles.bundles_for_root(written_bundles(t), "c:1"), "nodes").select("id")


def written_lessons(t):
    """One lesson file for each module; every fifth has an id outside of the grammar, every seventh no passages, and one file is broken."""
    unit = lambda k: F.concat(F.lit(f"{k} of "), "n_name")
    passage = lambda kind, sacred, *units: F.struct(F.concat(F.lit(f"t:{kind}"), "n_nationkey").alias("id"), F.lit(kind).alias("kind"), F.lit(sacred).alias("sacred"), F.array(*units).alias("units"))
    passages = F.when(F.col("n_nationkey") % 7 != 0, F.array(passage("a", True, unit("one"), unit("two")), passage("b", False, unit("three"))))
    body = F.struct(F.when(F.col("n_nationkey") % 5 == 0, F.lit("../etc")).otherwise(F.concat(F.lit("u"), "n_nationkey", F.lit("-1"))).alias("lessonId"), F.col("n_name").alias("title"), passages.alias("passages"))
    files = t.raw("nation").select(F.to_json(body).alias("value")).unionByName(t.spark.createDataFrame([("{broken",)], "value string"))
    return bundles.read_lessons(t.spark, one_file_each(t, files, "lessons"))


@query("src4_lessons", "SELECT 'u' || n_nationkey || '-1' AS lesson_id, n_name AS title, CASE WHEN n_nationkey % 7 != 0 THEN 2 ELSE 0 END AS passages FROM nation WHERE n_nationkey % 5 != 0", prelude=False)
def _(t):
    return written_lessons(t).select(F.col("lessonId").alias("lesson_id"), "title", F.size("passages").alias("passages"))


@query("src5_sealed_corpus", "SELECT 't:a' || n_nationkey AS id, 'one of ' || n_name || chr(10) || 'two of ' || n_name AS text FROM nation WHERE n_nationkey % 5 != 0 AND n_nationkey % 7 != 0", prelude=False)
def _(t):
    return bundles.sealed_corpus(written_lessons(t)).select("id", "text")


@query("src6_gazetteer", "SELECT kind, string_agg(n_name, ',' ORDER BY n_name) AS names, CASE kind WHEN 'river' THEN 1 ELSE 2 END AS ord FROM (SELECT n_name, CASE n_nationkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'river' ELSE 'sea' END AS kind FROM nation) WHERE kind != 'sea' GROUP BY 1", prelude=False)
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("city", "river", "sea"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    place = F.struct(kind.alias("kind"), F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("at"), F.lit(2.0).alias("r"), F.array(F.lower("n_name")).alias("aliases"))
    file = t.raw("nation").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("n_name", place))).alias("places"))).alias("value"))
    places = bundles.gazetteer(t.spark, one_file_each(t, file, "gazetteer"))
    return bundles.names_by_kind(places, ["river", "city"]).select("kind", F.array_join("names", ",").alias("names"), F.col("ord").cast("int").alias("ord"))


@query("src10_catalog_probe", "SELECT n_nationkey, n_name AS label, CAST(NULL AS VARCHAR) AS subject FROM nation", prelude=False)
def _(t):
    n = t.raw("nation").withColumnRenamed("n_name", "label")
    if bundles.has_table(t.spark, f"no_such_{uuid.uuid4().hex}"):
        raise ValueError("a table that was never made exists")
    return n.select("n_nationkey", bundles.optional(n, "label", "string").alias("label"), bundles.optional(n, "subject", "string").alias("subject"))


@query("snk10_snapshot", "SELECT 'nodes' AS name, id FROM nodes UNION ALL SELECT 'edges', CAST(id AS VARCHAR) FROM edges")
def _(t):
    """A dump of two tables, restored once its marker is there."""
    path = f"{sinks.shared_folder(t.spark)}/dump-{uuid.uuid4().hex}"
    sinks.write_snapshot({"nodes": t.nodes, "edges": t.edges}, path)
    back = sinks.read_snapshot(t.spark, path)
    return back["nodes"].select(F.lit("nodes").alias("name"), "id").unionByName(back["edges"].select(F.lit("edges").alias("name"), F.col("id").cast("string").alias("id")))
