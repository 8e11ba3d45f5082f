"""Loading bundles: gates, scope, bridges, dry runs, broken-off and competing loads."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import bundles, loader, versions

RUN = {"extractor": "x", "extractor_version": "1", "schema_version": "1"}


def bundle(course, module, los, external=(), questions=(), edges=(), source=True, passages=()):
    out = {"extraction_run": RUN, "syllabus_version": "v1", "external_node_refs": list(external), "text_passages": list(passages), "visuals": [{"id": f"v:{los[0]}", "lo_id": los[0], "kind": "chart", "spec": "{}", "caption": "c"}] if los else []}
    out["nodes"] = [{"id": course, "kind": "course", "label": course}, {"id": module, "kind": "module", "label": module}, *[{"id": x, "kind": "learning_objective", "label": x} for x in los]]
    out["edges"] = [{"src": module, "dst": course, "type": "part_of"}, *[{"src": module, "dst": x, "type": "teaches"} for x in los], *[dict(zip(("src", "dst", "type"), e)) for e in edges]]
    out["questions"] = [{"id": f"q:{x}", "lo_id": x, "type": "numeric", "correct_answer": "1", "status": "verified"} for x in los] + list(questions)
    out["source_document"] = {"sha256": f"sha-{course}", "title": course, "file_path": f"{course}.pdf"} if source else None
    out["source_file"] = None if source else "gone.pdf"
    return out


def read(spark, folder, files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name).write_text(json.dumps(content))
    return bundles.read_bundles(spark, str(folder), list(files))


@pytest.fixture
def base(spark, tmp_path):
    """Two courses with a bridge between them, curated by hand and so with its own date, and what students did."""
    files = {"a.json": bundle("c:a", "m:a", ["lo:a1", "lo:a2"], edges=[("lo:a1", "lo:a2", "prerequisite")]), "b.json": bundle("c:b", "m:b", ["lo:b1"])}
    root = f"file://{tmp_path}/tables"
    first, change = loader.load(spark, root, read(spark, tmp_path / "one", files))
    assert first.number == 1 and {r.name: r.after for r in change.collect()}["live"] == 3
    day = datetime.datetime(2020, 1, 2)
    bridges = spark.createDataFrame([("lo:a1", "lo:b1", "relates_to", "v0", day, None, 1, "curated"), ("lo:a2", "lo:b1", "relates_to", "v0", day, None, 1, "lost")], loader.EDGES)
    students = {"attempts": spark.createDataFrame([(1, "q:lo:a1"), (2, "q:lo:b1")], "id long, question_id string"), "mastery": spark.createDataFrame([(1, "lo:a1"), (1, "lo:b1")], "student_id long, lo_id string")}
    versions.commit(spark, root, first, {"edges": first.table("edges").unionByName(bridges), **students})
    return root


def test_scoped_load_keeps_bridges_and_the_other_course(spark, tmp_path, base):
    before = versions.latest(spark, base)
    again = read(spark, tmp_path / "two", {"a.json": bundle("c:a", "m:a", ["lo:a1", "lo:a9"])})
    options = loader.Options(scope="c:a", subjects={"c:a": "math"})
    nothing, dry = loader.load(spark, base, again, options, dry_run=True)
    assert nothing is None and versions.numbers(spark, base) == [1, 2]
    dry = {tuple(r) for r in dry.collect()}
    new, change = loader.load(spark, base, again, options)
    assert {tuple(r) for r in change.collect()} == dry and new.number == 3
    kept = [tuple(r) for r in new.table("edges").filter("edge_type = 'relates_to'").select("src_id", "dst_id", "system_from", "rationale").collect()]
    assert kept == [("lo:a1", "lo:b1", datetime.datetime(2020, 1, 2), "curated")]  # the other's end is gone
    assert {r.id for r in new.table("nodes").collect()} == {"c:a", "m:a", "lo:a1", "lo:a9", "c:b", "m:b", "lo:b1"}
    assert [r.id for r in new.table("attempts").collect()] == [2] and [r.lo_id for r in new.table("mastery").collect()] == ["lo:b1"]
    assert new.table("nodes").filter("id = 'c:a'").first().subject == "math"
    # a reader of the version before sees what it saw
    assert {r.id for r in before.table("nodes").collect()} == {"c:a", "m:a", "lo:a1", "lo:a2", "c:b", "m:b", "lo:b1"} and before.table("attempts").count() == 2


CYCLE = [("lo:a1", "lo:a2", "prerequisite"), ("lo:a2", "lo:a1", "prerequisite")]


@pytest.mark.parametrize(
    "content, scope, problems",
    [
        (
            bundle("c:a", "m:a", ["lo:a1", "lo:a2", "lo:b1"], external=["lo:none"], edges=[*CYCLE, ("lo:a1", "lo:b2", "prerequisite")], questions=[{"id": "q:lo:a1", "lo_id": "lo:a1"}, {"id": "q:lo:b1", "lo_id": "lo:a1"}, {"id": "q:x", "lo_id": "lo:x"}]), "c:a",
            # a node of the other course, an unknown reference, one that isn't named as external, a cycle, an id twice, a question of the other course, one of nothing
            {("V22", "lo:b1"), ("V22", "lo:none"), ("V1", "lo:a1>lo:b2"), ("V3", "lo:a1"), ("V3", "lo:a2"), ("V22", "q:lo:a1"), ("V22", "q:lo:b1"), ("V2", "q:x")},
        ),
        (bundle("c:z", "m:z", ["lo:z"], source=False), "c:y", {("V22", "c:y"), ("V21", "x.json")}),
    ],
)
def test_refused(spark, tmp_path, base, content, scope, problems):
    with pytest.raises(loader.Refused) as e:
        loader.load(spark, base, read(spark, tmp_path / "bad", {"x.json": content}), loader.Options(scope=scope))
    assert {(r.rule, r.id) for r in e.value.problems.collect()} == problems and versions.numbers(spark, base) == [1, 2]


def test_held_questions_never_go_live(spark, tmp_path, base):
    q = lambda n, **k: {"id": f"q:{n}", "lo_id": "lo:a1", "status": "verified", **k}
    passages = [{"id": "p1", "text_sha256": "t", "approved_sha256": "t", "approved_by": "e", "sensitivity_class": "open"}, {"id": "p2", "text_sha256": "t", "approved_sha256": "old", "approved_by": "e", "sensitivity_class": "open"}]
    files = {"x.json": bundle("c:a", "m:a", ["lo:a1"], questions=[q(1, sensitivity_class="sealed"), q(2, passage_id="p1"), q(3, passage_id="p2"), q(4, status="draft")], passages=passages)}
    for approve, live in ((False, {"q:lo:a1", "q:2"}), (True, {"q:lo:a1", "q:2", "q:4"})):
        new, _ = loader.load(spark, f"{base}-{approve}", read(spark, tmp_path / "held", files), loader.Options(approve_all=approve))
        assert {r.id for r in new.table("questions").filter("status = 'live'").collect()} == live
        assert {r.reviewed_by for r in new.table("questions").filter("status = 'review'").collect()} == {None}


def test_full_load_replaces_everything(spark, tmp_path, base):
    new, _ = loader.load(spark, base, read(spark, tmp_path / "full", {"n.json": bundle("c:n", "m:n", ["lo:n"])}))
    assert {r.id for r in new.table("nodes").collect()} == {"c:n", "m:n", "lo:n"} and new.table("attempts").isEmpty() and new.table("source_documents").count() == 1


def test_a_load_that_is_broken_off_changes_nothing(spark, tmp_path, base, monkeypatch):
    again = read(spark, tmp_path / "two", {"a.json": bundle("c:a", "m:a", ["lo:a1"])})

    def broken(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", broken)  # all tables are written by then
        with pytest.raises(OSError):
            loader.load(spark, base, again, loader.Options(scope="c:a"))
    last = versions.latest(spark, base)
    assert last.number == 2 and last.table("nodes").count() == 7
    assert loader.load(spark, base, again, loader.Options(scope="c:a"))[0].number == 3


def test_one_of_two_loads_wins(spark, base):
    last = versions.latest(spark, base)
    one = {"nodes": last.table("nodes").limit(1)}
    assert versions.commit(spark, base, last, one).number == 3
    with pytest.raises(versions.Conflict):
        versions.commit(spark, base, last, one)
    assert versions.numbers(spark, base) == [1, 2, 3] and versions.latest(spark, base).table("edges").count() == last.table("edges").count()


def test_bundles_are_put_together_once(spark, tmp_path):
    """However many gates look at the questions, whoever makes the bundles makes them once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def stem(s):
        made.add(1)
        return s

    rows = read(spark, tmp_path / "one", {"a.json": bundle("c:a", "m:a", ["lo:a1", "lo:a2"])})
    asked = rows.select("ord", F.explode("questions").alias("q")).select("ord", "q", stem("q.id").alias("_s")).groupBy("ord").agg(F.collect_list(F.col("q").withField("stem", F.col("_s"))).alias("questions"))
    loader.load(spark, f"file://{tmp_path}/tables", rows.drop("questions").join(asked, "ord"))
    assert made.value == 2


def test_listed_order_proves_that_there_is_no_cycle(spark, monkeypatch):
    from tessera.operators import gates, graph

    listed = spark.createDataFrame([("z", 1, 0), ("b", 1, 1), ("a", 2, 0)], "id string, ord int, pos int")
    edges = lambda *e: spark.createDataFrame(e, "src_id string, dst_id string")
    assert {r.id for r in gates.acyclic(edges(("z", "b"), ("a", "z"), ("b", "a")), listed).collect()} == {"a", "b", "z"}
    assert {r.id for r in gates.acyclic(edges(("x", "y"), ("y", "x")), listed).collect()} == {"x", "y"}  # not listed
    assert {r.id for r in gates.acyclic(edges(("z", "z")), listed).collect()} == {"z"}
    assert gates.acyclic(edges(("a", "z"), ("z", "b")), listed).isEmpty()  # backward, and yet no cycle
    monkeypatch.setattr(graph, "cycle_members", None)  # not followed
    assert gates.acyclic(edges(("z", "b"), ("b", "a"), ("z", "a")), listed).collect() == []


def test_bundles_are_numbered_without_bringing_them_together(spark, tmp_path, monkeypatch):
    from tessera.operators import graph
    from tessera.queries import loading
    from tessera.sources.domain import Tables

    def cut(df):
        df.write.parquet(f"{tmp_path}/files")
        return spark.read.parquet(f"{tmp_path}/files")

    monkeypatch.setattr(graph, "cut", cut)
    got = loading.course_bundles(Tables(spark, "/root/testdata/sf0.001"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(spark.read.parquet(f"{tmp_path}/files").columns) == ["a", "b", "ord"]
    rows = sorted((r.ord, r.file) for r in got.select("ord", "file").collect())
    assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and rows[0][1] == "course.json" and len(rows) > 2


def test_tables_of_a_version_are_written_side_by_side(spark, tmp_path):
    import threading

    from tessera.sources import versions

    met = threading.Barrier(2, timeout=60)  # broken if one write waits for the other

    class Table:
        def __init__(self, df):
            self.df, self.schema = df, df.schema

        @property
        def write(self):
            met.wait()
            return self.df.write

    written = versions.write(spark, str(tmp_path), {n: Table(spark.range(k)) for n, k in (("a", 3), ("b", 5))})
    assert [spark.read.parquet(written[n][0]).count() for n in "ab"] == [3, 5]
