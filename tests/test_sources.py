import json

from pyspark.sql import functions as F

from tessera.operators import places
from tessera.sources import bundles, sinks

RUN = {"extractor": "x", "extractor_version": "1", "schema_version": "1"}


def write(path, files):
    for name, body in files.items():
        (path / name).write_text(body if isinstance(body, str) else json.dumps(body))
    return str(path)


def test_bundles(spark, tmp_path):
    node = lambda i, kind="module", label="x": {"id": i, "kind": kind, "label": label}
    path = write(tmp_path, {
        "b.json": {"extraction_run": RUN, "nodes": [node("m:1"), node("lo:1", "learning_objective", "first")], "edges": [{"src": "m:1", "dst": "c:1", "type": "part_of"}, {"src": "m:1", "dst": "lo:1", "type": "teaches"}]},
        "a.json": {"extraction_run": RUN, "nodes": [node("c:1", "course"), node("lo:1", "learning_objective", "second")], "edges": []},
        "z.json": {"extraction_run": RUN, "nodes": [node("c:9", "course")], "edges": []},
        "other.json": {"hello": 1},
    })
    b = bundles.read_bundles(spark, path, ["b.json", "a.json"])
    assert [(r.file, r.ord, r.listed) for r in b.orderBy("ord").collect()] == [("b.json", 1, True), ("a.json", 2, True), ("z.json", 3, False)]
    assert {r.id: r.label for r in bundles.part(b, "nodes").collect()}["lo:1"] == "first"
    assert {r.file for r in bundles.bundles_for_root(b, "c:1").collect()} == {"a.json", "b.json"}


def test_lessons(spark, tmp_path):
    path = write(tmp_path, {
        "1.json": {"lessonId": "u1-1", "passages": [{"id": "t1", "sacred": True, "units": ["a", "b"]}, {"id": "t2", "sacred": False, "units": ["c"]}]},
        "2.json": {"lessonId": "../etc"}, "3.json": "{broken",
    })
    lessons = bundles.read_lessons(spark, path)
    assert [(r.lessonId, r.key_terms) for r in lessons.collect()] == [("u1-1", [])]
    assert [(r.id, r.text) for r in bundles.sealed_corpus(lessons).collect()] == [("t1", "a\nb")]


def test_gazetteer(spark, tmp_path):
    path = write(tmp_path, {"g.json": {"places": {"Nile": {"kind": "river", "at": [1.0, 2.0], "r": 1.0, "aliases": ["the nile"]}, "Cairo": {"kind": "city", "at": [5.0, 5.0], "r": 2.0}}}})
    g = bundles.gazetteer(spark, path)
    assert [(r.kind, r.names) for r in bundles.names_by_kind(g, ["city", "river"]).orderBy("ord").collect()] == [("city", ["Cairo"]), ("river", ["Nile"])]
    pts = spark.createDataFrame([(1, 1.2, 2.1), (2, 40.0, 2.0), (3, 6.0, 6.9)], "id int, x double, y double")
    assert {(r.id, r.place) for r in places.nearest_place(pts, g, "id", "place", 1.15).collect()} == {(1, "Nile"), (3, "Cairo")}
    g = g.withColumn("name", F.col("place"))
    names = spark.createDataFrame([("THE  Nile",), ("x",)], "name string")
    assert {(r.name, r.place) for r in places.resolve_names(names, g, "name").collect()} == {("THE  Nile", "Nile"), ("x", None)}


def test_snapshots(spark, tmp_path):
    a = spark.range(3).select("id")
    sinks.write_snapshot({"a": a}, f"{tmp_path}/s")
    assert sinks.read_snapshot(spark, f"{tmp_path}/s")["a"].count() == 3 and not sinks.is_complete(spark, f"{tmp_path}/none")
    assert [tuple(r) for r in sinks.dry_run({"a": a}, {"a": a.filter(F.col("id") > 0)}).collect()] == [("a", 3, 2, -1)]


def test_batches_read_their_own_buckets(spark, tmp_path):
    """The state of a long log is as many files as that of a short one, a batch that comes again counts once, and one that was broken off is written again."""
    import datetime

    from tessera.sources import sinks

    questions = spark.createDataFrame([("q", "lo", "numeric", "1", [(1, "look")], "live")], "id string, lo_id string, question_type string, correct_answer string, canonical_solution array<struct<step:int,text_md:string>>, status string")
    path = f"file://{tmp_path}/log"
    at = datetime.datetime(2024, 1, 1)

    def batch(n):
        rows = [(n * 10 + k, k % 2, "q", "1" if (n + k) % 3 else "2", at + datetime.timedelta(minutes=n * 10 + k)) for k in range(4)]
        return spark.createDataFrame(rows, "id long, student_id long, question_id string, given_answer string, attempted_at timestamp_ntz")

    files = []
    for n in range(4):
        last = sinks.buckets_before(spark, path, n)
        files.append(len(sinks.read_state(spark, path, last).inputFiles()) if last else 0)
        sinks.record_attempts(batch(n), n, questions, path)
    sinks.record_attempts(batch(3), 3, questions, path)
    assert files[1:] == [files[1]] * 3 and len(sinks.committed(spark, path)) == 4
    every = sorted((r.student_id, r.n, round(r.score, 9), r.system_to is None) for r in sinks.read_mastery(spark, path).collect())
    assert [e[1] for e in every] == [*range(1, 9)] * 2 and [e[3] for e in every] == [*[False] * 7, True] * 2
    assert sorted((r.student_id, r.n, round(r.score, 9), True) for r in sinks.read_open_mastery(spark, path).collect()) == [e for e in every if e[3]]


def test_arrivals_and_questions_are_derived_once(monkeypatch):
    from types import SimpleNamespace

    from tessera.queries import content

    made, sent = [], {}
    monkeypatch.setattr(content.graph, "cut", lambda df: made.append(df) or ("cut", df))
    monkeypatch.setattr(content, "arrive", lambda t, df, name, parts, order, sink: sink("batch", 0, "path"))
    monkeypatch.setattr(content.sinks, "record_attempts", lambda batch, n, questions, path: sent.update(questions=questions))
    monkeypatch.setattr(content.F, "array", lambda *a: None)
    monkeypatch.setattr(content.F, "struct", lambda *a: SimpleNamespace(alias=lambda n: None))
    monkeypatch.setattr(content.F, "lit", lambda x: SimpleNamespace(alias=lambda n: None))
    monkeypatch.setattr(content.F, "concat", lambda *a: SimpleNamespace(alias=lambda n: None))
    bank = SimpleNamespace(withColumn=lambda *a: SimpleNamespace(filter=lambda cond: f"bank where {cond}"))
    content.record_all(SimpleNamespace(questions=bank, attempts=SimpleNamespace(select=lambda *a: "attempts")))
    assert made == ["bank where status = 'live'"] and sent["questions"] == ("cut", made[0])
