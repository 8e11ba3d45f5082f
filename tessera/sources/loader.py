"""Loading seed bundles into the domain tables: whole or for one course, checked, and published as one version.

The plan of a load is lazy: ``plan_load`` gives every table as it will be, and a dry run counts that very plan. A load
for one course replaces the course's subtree: its nodes, edges, questions and visuals go, with what students have
done on them; bridges (``relates_to`` edges) that lead out of the subtree are kept aside as they are, with their
temporal columns and rationale, and come back if both their ends exist afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import gates, graph
from tessera.sources import bundles as B
from tessera.sources import versions

NODES = "id string, kind string, label string, description string, syllabus_ref string, order_in_parent int, source_sha256 string, source_page int, run_id long, subject string"
EDGES = "src_id string, dst_id string, edge_type string, syllabus_version string, system_from timestamp_ntz, system_to timestamp_ntz, run_id long, rationale string"
QUESTIONS = f"id string, lo_id string, tier string, question_type string, stem string, choices array<{B.CHOICE}>, correct_answer string, status string, reviewed_by string, source_sha256 string, source_page int, run_id long"
VISUALS = "id string, lo_id string, question_id string, kind string, spec string, caption string, run_id long"
DOCUMENTS = "sha256 string, title string, file_path string"
RUNS = "id long, file string, source_sha256 string, extractor string, extractor_version string, schema_version string"
CONTENT = {"nodes": NODES, "edges": EDGES, "questions": QUESTIONS, "visuals": VISUALS, "source_documents": DOCUMENTS, "runs": RUNS}
#: What students have done, by the column that leads to content; any other columns are carried along.
STUDENT_DATA = {"attempts": "question_id", "explanations": "question_id", "mastery": "lo_id", "checks": "lo_id"}
BRIDGE = "relates_to"


class Refused(Exception):
    """A load that the gates don't let through; ``problems`` has (rule, id, detail)."""

    def __init__(self, problems: DataFrame):
        self.problems = problems
        super().__init__("; ".join(f"{r.rule} {r.id}: {r.detail}" for r in problems.limit(20).collect()))


@dataclass(frozen=True)
class Options:
    scope: str | None = None  # a course; None replaces everything
    approve_all: bool = False
    bulk_reviewer: str = "bulk"
    verified_reviewer: str = "dual check"
    subjects: dict[str, str] = field(default_factory=dict)  # of courses
    loaded_at: Column | None = None


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``; those that ``df`` lacks are null."""
    columns = [c.strip().split(" ", 1) for c in _split(schema)]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in CONTENT.items()}


class Batch:
    """The content of some bundles, or of their parts, as rows for the tables."""

    def __init__(self, bundles: DataFrame | B.Parts, current: dict[str, DataFrame], options: Options):
        at = F.current_timestamp().cast("timestamp_ntz") if options.loaded_at is None else options.loaded_at
        last = current["runs"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
        known = current["source_documents"].filter("file_path IS NOT NULL").groupBy(F.col("file_path").alias("path")).agg(F.min("sha256").alias("sha256"))
        # each part is put together and unfolded once; the gates and the plan read what is written here
        parts = bundles if isinstance(bundles, B.Parts) else B.parts(bundles)
        heads = graph.cut(parts.heads)
        unfolded = {n: graph.cut(getattr(parts, n)) for n in B.LISTS}
        listed = heads.withColumn("sha256", F.col("source_document.sha256")).withColumn("_all", F.lit(1))
        resolved = gates.resolve_sources(listed, known, "_all", "ord").select("ord", "resolved")  # one row for each file
        self.heads = heads
        self.defined = unfolded["nodes"].select("ord", F.col("id").alias("ref")).unionByName(heads.select("ord", F.explode("external_node_refs").alias("ref"))).distinct()
        runs = heads.join(resolved, "ord").crossJoin(last)  # one row
        self.runs = graph.cut(runs.select("ord", (F.col("_last") + F.col("ord")).alias("id"), "file", F.col("resolved").alias("source_sha256"), "extraction_run.*", "syllabus_version"))
        run = F.broadcast(self.runs.select("ord", F.col("id").alias("run_id"), "source_sha256", "syllabus_version"))
        subject = F.create_map(*[F.lit(x) for kv in options.subjects.items() for x in kv])[F.col("id")] if options.subjects else F.lit(None)
        self.nodes = B.first_of_each(unfolded["nodes"]).join(run, "ord").withColumn("subject", F.when(F.col("kind") == "course", subject))
        edges = unfolded["edges"].join(run, "ord")
        self.edges = edges.select("ord", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("type").alias("edge_type"), "syllabus_version", at.alias("system_from"), "run_id")
        raw = unfolded["questions"].drop("file")
        self.passages = B.first_of_each(unfolded["text_passages"])
        fit = self.passages.select("id", (F.col("sensitivity_class") == "sealed").alias("sacred"), F.when(F.col("approved_sha256") == F.col("text_sha256"), F.col("approved_by")).alias("approved_by"))
        self.held = gates.held_back(raw.withColumnRenamed("sensitivity_class", "sensitivity"), fit)
        q = raw.join(self.held.select("id", F.lit(True).alias("_held")).distinct(), "id", "left").withColumn("_held", F.coalesce("_held", F.lit(False))).withColumn("_verified", F.coalesce(F.col("status") == "verified", F.lit(False))).join(run, "ord")
        live = (F.lit(options.approve_all) | F.col("_verified")) & ~F.col("_held")
        reviewer = F.when(live, options.bulk_reviewer if options.approve_all else options.verified_reviewer)
        self.questions = q.withColumn("status", F.when(live, "live").otherwise("review")).withColumn("reviewed_by", reviewer).withColumnRenamed("type", "question_type")
        self.visuals = unfolded["visuals"].drop("file", "pos").join(run, "ord")
        self.external = heads.select(F.explode("external_node_refs").alias("id")).distinct()
        declared = heads.filter("source_document IS NOT NULL").select("ord", "source_document.*")
        self.documents = declared.groupBy("sha256").agg(F.min_by(F.struct("title", "file_path"), "ord").alias("_d")).select("sha256", "_d.*")


def subtree(current: dict[str, DataFrame], scope: str) -> DataFrame:
    """(id): what belongs to the course alone; empty if it isn't there yet."""
    inside = graph.course_subtree(current["nodes"], current["edges"], scope)
    return graph.cut(inside.join(current["nodes"].select("id"), "id", "left_semi"))


def ancestors(current: dict[str, DataFrame], scope: str) -> DataFrame:
    """(id): what the course is a part of, which its bundles may declare again."""
    up = current["edges"].filter("edge_type = 'part_of'").select("src_id", "dst_id")
    roots = current["nodes"].sparkSession.createDataFrame([(scope,)], "root string")
    return graph.reachable(up, roots).select("id").filter(F.col("id") != scope)


def problems(current: dict[str, DataFrame], batch: Batch, inside: DataFrame | None, options: Options) -> DataFrame:
    """(rule, id, detail) of everything that forbids the load."""
    nodes = batch.nodes.select("id")
    if inside is None:
        survivors = nodes.limit(0)
    else:
        survivors = current["nodes"].select("id").join(inside, "id", "left_anti")
    known = nodes.unionByName(survivors)
    found = [
        gates.one_source(batch.heads.select(F.col("file").alias("id"), "source_document", "source_file")),
        gates.broken(batch.runs, "V21", F.col("source_sha256").isNull(), "file", F.lit("no source")),
        *_strays(batch),
        gates.acyclic(batch.edges.filter("edge_type = 'prerequisite'").select("src_id", "dst_id"), batch.nodes.select("id", "ord", "pos")),
        gates.unknown_refs(batch.external.withColumn("ref", F.col("id")), "V22", "ref", known),
        _repeated(batch.questions, "question"), _repeated(batch.visuals, "visual"),
    ]
    kept = lambda name: current[name].join(inside.withColumnRenamed("id", "lo_id"), "lo_id", "left_anti").select("id")
    if inside is not None:
        clash = nodes.join(survivors, "id", "left_semi").join(ancestors(current, options.scope), "id", "left_anti")
        unknown = nodes.sparkSession.createDataFrame([(options.scope,)], "id string").join(nodes.unionByName(current["nodes"].select("id")), "id", "left_anti")
        twice = batch.questions.select("id").join(kept("questions"), "id", "left_semi")
        found += [d.select(F.lit("V22").alias("rule"), "id", F.lit(what).alias("detail")) for d, what in ((unknown, "no such course"), (clash, "outside of the course"), (twice, "question of another course"))]
    return gates.all_of(*found)


def _strays(batch: Batch) -> list[DataFrame]:
    """References of a bundle to what it neither defines nor names as external."""
    refs = [("V1", batch.edges, F.concat_ws(">", "src_id", "dst_id"), "src_id"), ("V1", batch.edges, F.concat_ws(">", "src_id", "dst_id"), "dst_id"), ("V2", batch.questions, F.col("id"), "lo_id"), ("V2", batch.visuals, F.col("id"), "lo_id")]
    lost = [rows.select("ord", name.alias("id"), F.col(c).alias("ref")).filter("ref IS NOT NULL").join(batch.defined, ["ord", "ref"], "left_anti").select(F.lit(rule).alias("rule"), "id", F.col("ref").alias("detail")) for rule, rows, name, c in refs]
    asked = batch.visuals.filter("question_id IS NOT NULL").join(batch.questions.select(F.col("id").alias("question_id")), "question_id", "left_anti")
    return [*lost, asked.select(F.lit("V2").alias("rule"), "id", F.col("question_id").alias("detail"))]


def _repeated(rows: DataFrame, what: str) -> DataFrame:
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.lit("V22").alias("rule"), "id", F.lit(f"{what} twice").alias("detail"))


def detached(current: dict[str, DataFrame], inside: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the subtree, and the bridges that touch it."""
    on = lambda c: inside.withColumnRenamed("id", c)
    gone = current["questions"].join(on("lo_id"), "lo_id", "left_semi").select(F.col("id").alias("question_id")).distinct()
    edges = current["edges"]
    touching = lambda df: df.join(on("src_id").withColumn("_s", F.lit(True)), "src_id", "left").join(on("dst_id").withColumn("_d", F.lit(True)), "dst_id", "left")
    touched = touching(edges)
    hit = F.coalesce("_s", "_d", F.lit(False))
    left = dict(current)
    left["nodes"] = current["nodes"].join(inside, "id", "left_anti")
    left["edges"] = touched.filter(~hit).select(*edges.columns)
    left["questions"] = current["questions"].join(on("lo_id"), "lo_id", "left_anti").select(*current["questions"].columns)
    visuals = current["visuals"]
    left["visuals"] = visuals.join(on("lo_id"), "lo_id", "left_anti").join(gone, "question_id", "left_anti").select(*visuals.columns)
    for name, key in STUDENT_DATA.items():
        if name in current:
            left[name] = current[name].join(gone if key == "question_id" else on("lo_id"), key, "left_anti").select(*current[name].columns)
    return left, touched.filter(hit & (F.col("edge_type") == BRIDGE)).select(*edges.columns)


def reattached(bridges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The bridges whose ends exist and that no edge of ``edges`` draws already."""
    there = edges.filter(F.col("edge_type") == BRIDGE).select("src_id", "dst_id").distinct()
    return graph.both_present(bridges, nodes.select("id")).join(there, ["src_id", "dst_id"], "left_anti").select(*bridges.columns)


def plan_load(current: dict[str, DataFrame], batch: Batch, inside: DataFrame | None) -> dict[str, DataFrame]:
    """All tables as they are after the load."""
    if inside is None:
        spark = batch.nodes.sparkSession
        left, bridges = {n: spark.createDataFrame([], df.schema) for n, df in current.items()}, None
    else:
        left, bridges = detached(current, inside)
    new = {n: shaped(getattr(batch, n), CONTENT[n]) for n in ("nodes", "edges", "questions", "visuals")}
    new["source_documents"], new["runs"] = shaped(batch.documents, DOCUMENTS), shaped(batch.runs, RUNS)
    after = {n: shaped(df, CONTENT[n]) if n in CONTENT else df for n, df in left.items()}
    for name, key in (("nodes", "id"), ("source_documents", "sha256")):  # what is there stays as it is
        new[name] = new[name].join(after[name].select(key), key, "left_anti").select(*new[name].columns)
    for name, rows in new.items():
        after[name] = after[name].unionByName(rows)
    if bridges is not None:
        back = reattached(shaped(bridges, EDGES), after["nodes"], after["edges"])
        after["edges"] = after["edges"].unionByName(back)
    return after


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): what a reader of a load looks at."""
    n = lambda name, label, cond: tables[name].agg(F.count_if(cond).alias("n")).select(F.lit(label).alias("name"), "n")
    every = F.lit(True)
    return gates.all_of(
        n("nodes", "nodes", every), n("edges", "edges", every), n("edges", "bridges", F.col("edge_type") == BRIDGE), n("questions", "questions", every), n("questions", "live", F.col("status") == "live"),
        n("questions", "review", F.col("status") == "review"), n("visuals", "visuals", every), n("source_documents", "source documents", every), *[n(t, t, every) for t in STUDENT_DATA if t in tables],
    )


def delta(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, before, after, delta) of the counts of two states."""
    return counts(before).withColumnRenamed("n", "before").join(counts(after).withColumnRenamed("n", "after"), "name").select("name", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def prepare(current: dict[str, DataFrame], bundles: DataFrame | B.Parts, options: Options) -> dict[str, DataFrame]:
    """The checked plan of a load; ``Refused`` if a gate doesn't let it through."""
    batch = Batch(bundles, current, options)
    inside = subtree(current, options.scope) if options.scope else None
    wrong = graph.cut(problems(current, batch, inside, options))
    if not wrong.isEmpty():
        raise Refused(wrong)
    return plan_load(current, batch, inside)


def load(spark: SparkSession, root: str, bundles: DataFrame | B.Parts, options: Options = Options(), dry_run: bool = False) -> tuple[versions.Version | None, DataFrame]:
    """Load bundles (as ``bundles.read_bundles`` gives them, or as parts) into the tables at ``root``: the new version, and what changed.

    A dry run gives (None, what would change). Nothing is visible before the version is published, and all of it is then.
    """
    base = versions.latest(spark, root)
    current = {**empty_tables(spark), **(base.all() if base else {})}
    after = prepare(current, bundles, options)
    if dry_run:
        return None, delta(current, after)
    new = versions.commit(spark, root, base, after)
    return new, delta(current, new.all())
