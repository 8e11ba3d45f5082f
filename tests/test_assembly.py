"""Assembly of lesson drafts, and the reveal of messages."""

from tessera.sources import assembly, loader, versions
from tessera.streaming import stateful


def test_drafts_become_bundles_that_load(spark, tmp_path):
    subtopic = "array<struct<key:string,title:string>>"
    lessons = spark.createDataFrame([("u1-1", "m:1", "One", 1, [("a", "A"), ("b", "B")]), ("u1-2", "m:1", "One", 2, [("c", "C")]), ("u2-1", "m:2", "Two", 3, [("d", "D")])], f"lesson string, module_id string, module_title string, ord int, subtopics {subtopic}")
    choices = [("أ", "النون"), ("ب", "الواو")]
    rows = [
        ("u1-1", "a", 1, "mcq", "basic", "s1", choices, "(ب) الواو", "ب", None, 1, ["c1", "c2"]),
        ("u1-1", "a", 2, "mcq", "basic", "s2", choices, "أ", "ب", None, 1, []),  # the readings differ
        ("u1-1", "b", 1, "numeric", "basic", "s3", choices, " 4 ", None, "p1", 1, []),  # of a sacred passage
        ("u1-2", "c", 1, "numeric", "basic", "they say one two three four here", choices, "5", None, None, 1, []),  # quotes it
        ("u2-1", "d", 1, "mcq", "basic", "s5", choices, "?", None, None, 1, ["c3"]),  # of bad claims only
        ("u2-1", "d", 2, "numeric", "basic", "s6", choices, "6", None, None, 1, ["c3", "c4"]),
    ]
    questions = spark.createDataFrame(rows, "lesson string, key string, n int, type string, tier string, stem string, choices array<struct<key:string,text:string>>, answer string, reading string, passage_id string, source_page int, claims array<string>")
    visuals = spark.createDataFrame([("u1-1", "b", "chart", "{}", "x"), ("u1-1", "b", "chart", "{}", "y")], "lesson string, key string, kind string, spec string, caption string")
    passages = spark.createDataFrame([("u1-1", "p1", "verse", True, ["one  two", "three four"]), ("u1-2", "p2", "prose", False, ["x‍y"])], "lesson string, id string, kind string, sacred boolean, units array<string>")
    bad = spark.createDataFrame([("q:u1-1-1:001", "c1"), ("q:u2-1-1:001", "c3"), ("q:u2-1-1:002", "c3")], "id string, claim string")
    made = assembly.assemble(lessons, questions, visuals, passages, ("c:1", "Book"), ("sha", "Book", "b.pdf"), bad)
    q = {r.id: (r.lo_id, r.correct_answer, r.status, r.sensitivity_class) for r in made.selectExpr("inline(questions)").collect()}
    assert q == {
        "q:u1-1-1:001": ("lo:u1-1-1", "ب", "verified", "open"), "q:u1-1-1:002": ("lo:u1-1-1", "أ", "draft", "open"), "q:u1-1-2:001": ("lo:u1-1-2", "4", "verified", "sealed"),
        "q:u1-2-1:001": ("lo:u1-2-1", "5", "verified", "sealed"), "q:u2-1-1:002": ("lo:u2-1-1", "6", "verified", "open"),
    }
    edges = {(r.src, r.dst) for r in made.selectExpr("inline(edges)").filter("type = 'prerequisite'").collect()}
    assert edges == {("lo:u1-1-1", "lo:u1-1-2"), ("lo:u1-1-2", "lo:u1-2-1")}  # across lessons, not across modules
    p = {r.id: ([u.text_ar for u in r.units], r.text_sha256 is None) for r in made.selectExpr("inline(text_passages)").collect()}
    assert p == {"p1": (["one two", "three four"], False), "p2": ([None], True)}
    assert [r.id for r in made.selectExpr("inline(visuals)").orderBy("id").collect()] == ["v:u1-1-2:001", "v:u1-1-2:002"]
    new, change = loader.load(spark, f"file://{tmp_path}/book", made)
    got = {r.name: r.after for r in change.collect()}
    assert (got["nodes"], got["questions"], got["live"], got["visuals"]) == (7, 5, 2, 2) and versions.latest(spark, f"file://{tmp_path}/book").number == new.number


def test_reveal(spark):
    text = 'One two. {{beat}} three four five six {{widget:viz:{"a": "b c. {{d}}"}}} seven'
    df = spark.createDataFrame([(1, text, None), (2, text, 3000), (3, "", None), (4, None, None)], "id int, text string, ended int")
    rows = stateful.reveal_schedule(df, ["id"], ended_ms="ended").orderBy("id", "tick").collect()
    plain = [(r.end, r.at_ms, r.dwell_ms) for r in rows if r.id == 1]
    widget = text.index("{{widget")
    end = text.index(" seven")
    assert [e for e, _, _ in plain] == [8, 17, text.index(" six"), end, len(text)] and widget < end
    assert [d for _, _, d in plain] == [1150, 1700, 850, 1500, 850] and [a for _, a, _ in plain] == [60, 1210, 2910, 3760, 5260]
    caught = [(r.at_ms, r.dwell_ms) for r in rows if r.id == 2]
    assert caught[:3] == [(60, 1150), (1210, 1700), (2910, 850)] and caught[3] == (3760, min(1500, 2000 / 1)) and {r.id for r in rows} == {1, 2}


def test_parts_of_lessons_are_the_rows_of_their_bundles(spark):
    from tessera.sources import bundles as B

    lessons = spark.createDataFrame([("u1-1", "m:1", "One", 5, [("a", "A"), ("b", "B")]), ("u1-2", "m:1", "One", 6, []), ("u1-3", "m:1", "One", 7, [("c", "C")])], "lesson string, module_id string, module_title string, ord int, subtopics array<struct<key:string,title:string>>")
    choices = "array(named_struct('key', 'x', 'text', 'yes'), named_struct('key', 'y', 'text', 'no')) AS choices"
    questions = spark.range(300).selectExpr("if(id < 250, 'u1-1', 'u1-3') AS lesson", "element_at(array('a', 'b', 'c'), if(id < 250, CAST(id % 3 AS INT) + 1, 3)) AS key", "1000 - id AS n", "'mcq' AS type", "'basic' AS tier", "concat('s', id) AS stem", choices, "'x' AS answer", "CAST(NULL AS STRING) AS reading", "if(id % 2 = 0, 'p', NULL) AS passage_id", "1 AS source_page")
    visuals = spark.createDataFrame([("u1-1", "b", "chart", "{}", c) for c in "zyx"], "lesson string, key string, kind string, spec string, caption string")
    passages = spark.createDataFrame([("u1-1", "p", "verse", True, ["one"]), ("u1-3", "p", "prose", False, ["two"]), ("u1-2", "q", "prose", False, ["three"])], "lesson string, id string, kind string, sacred boolean, units array<string>")
    drafts = lessons, questions, visuals, passages, ("c:1", "Book"), ("sha", "Book", "b.pdf")
    made, parts = B.parts(assembly.assemble(*drafts)), assembly.parts(*drafts)
    in_order = lambda df: df.orderBy("ord", "pos").drop("pos").collect()
    assert {n: in_order(getattr(parts, n)) for n in B.LISTS} == {n: in_order(getattr(made, n)) for n in B.LISTS}
    assert [r.file for r in parts.heads.orderBy("ord").collect()] == ["u1-1.json", "u1-3.json"]  # one without subtopics has no bundle
    assert parts.questions.count() == 250 - 83 + 50 and [r.id for r in in_order(parts.questions)][:2] == ["q:u1-1-1:001", "q:u1-1-1:002"]
    assert [(r.src, r.dst) for r in in_order(parts.edges) if r.type == "prerequisite"] == [("lo:u1-1-1", "lo:u1-1-2"), ("lo:u1-1-2", "lo:u1-3-1")]
    assert [r.file for r in B.first_of_each(parts.text_passages).collect()] == ["u1-1.json"]


def test_the_loader_takes_a_book_in_rows(spark, tmp_path, monkeypatch):
    """However many questions a lesson has, no row on the way to the loader holds them all."""
    import uuid

    from pyspark.sql import DataFrame

    from tessera.operators import graph
    from tessera.queries import QUERIES

    def cut(df):
        df.write.parquet(path := f"{tmp_path}/{uuid.uuid4().hex}")
        return spark.read.parquet(path)

    given = []
    monkeypatch.setattr(graph, "cut", cut)
    monkeypatch.setattr(loader, "load", lambda spark, root, book, *options: (given.append(book), spark.createDataFrame([], "name string, after long")))
    QUERIES["q17_loaded_book"](spark, "/root/testdata/sf0.001")
    (book,) = given
    assert not isinstance(book, DataFrame)
    for rows in (book.nodes, book.edges, book.questions, book.visuals):
        assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString() and not rows.isEmpty()
