"""Golden rows of functions that SQL can't express, and histories in chunks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.functions import protocol as P
from tessera.functions import text as T
from tessera.operators import graph, temporal
from tessera.streaming import stateful


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize(
    "text, find, nth, whole, want",
    [("كَتَبَ الولدُ", "كتب", 1, False, (0, 6)), ("a b a", "a", 2, False, (4, 5)), ("ab a", "a", 1, True, (3, 4)), ("abc", "x", 1, False, None), ("", "x", 1, False, None), ("أحمد", "احمد", 1, True, (0, 4))],
)
def test_locate(text, find, nth, whole, want):
    assert T._locate(text, find, nth, whole) == want


def test_store_form(spark):
    rows = [("é  x",), ("a​b",), ("x‍y",), ("كـت",), ("ی",), (None,)]
    got = values(spark, rows, "s string", T.store_form(F.col("s")), T.store_refusal(F.col("s")))
    assert got == [("é x", None), ("ab", None), (None, "joiner"), ("كت", None), (None, "foreign letter"), (None, None)]


def test_folds_differ(spark):
    assert values(spark, [("a-b C",)], "s string", T.compare_loose(F.col("s")), F.array_join(T.fold_words(F.col("s")), "|"), T.fold_compare(F.col("s"))) == [("ab C", "a|b|c", "a b C")]
    assert values(spark, [("é: a/b «c»",)], "s string", T.fold_compare(F.col("s"))) == [("é a/b c",)]


def test_stages(spark):
    assert values(spark, [("كَتَ",)], "s string", T.stage_vowelled("s")) == [(["كت", "كَت", "كَتَ"],)]


def test_names_and_ids(spark):
    rows = [(" Sara Ali ", "7", [1, 7]), ("سارة علي", "7; DROP", [3, 9]), ("", "", [])]
    got = values(spark, rows, "s string, raw string, known array<long>", T.short_name(F.col("s")), T.arabic_greeting_name(F.col("s")), T.pick_id(F.col("raw"), F.col("known")))
    assert got == [("Sara", None, 7), ("سارة", "سارة", 3), ("", None, 1)]


def test_longest_run(spark):
    assert values(spark, [("a b c d e", "x b c d y")], "a string, b string", T.longest_shared_run("a", "b")["length"], T.longest_shared_run("a", "b")["run"]) == [(3, "b c d")]


def test_directives_take_every_form():
    """The forms that a message can carry, and what is no directive."""
    got = [d[2:] for d in P.scan_directives('{{show_question:q:u1-4-1:002}} {{highlight:lo:u1-2-1, lo:u1-3-1}}{{widget:pair_plotter:{"prompt":"Plot (3,2)","target":[3,2]}}}{{widget:viz_ref:v:geo1-1:001}}{{show_passage:t:ara1-1:001}}{{finish_lesson}}')]
    assert got == [("question", None, "q:u1-4-1:002"), ("highlight", None, "lo:u1-2-1,lo:u1-3-1"), ("widget", "pair_plotter", '{"prompt":"Plot (3,2)","target":[3,2]}'), ("widget", "viz_ref", '{"id": "v:geo1-1:001"}'), ("passage_ref", None, "t:ara1-1:001"), ("finish", None, "")]
    one = lambda s: [d[2:] for d in P.scan_directives(s)]
    assert one('{{widget:viz:{"a": "\\"}}", "b": {"c": {}}} end') == [("widget", "viz", '{"a": "\\"}}", "b": {"c": {}}}')]  # one brace too few
    assert one('{{widget:viz:{"a" 1}}}') == [(None, None, None)] and one("{{widget:viz:[1]}} {{switch_subject:none}} {{beat") == []
    assert one('{{show_passage:{"id":"t:1","quote":" a ","unit":2.0,"view":"excerpt"}}}') == [("passage_ref", None, '{"id": "t:1", "quote": "a", "unit": 2, "view": "line"}')]
    assert one('{{show_passage:{"quote":"a"}}}') == [(None, None, None)] and one('{{show_passage:{"id":"a"') == []
    assert one("{{widget:viz:{" + '"a": "' + "x" * 5000 + '"}}}') == []
    assert one("{{{beat}}") == []


def test_tails_and_blocks():
    for s, want in (("hello [[lo:a", "hello "), ("a {{widget:viz:{\"x\": \"{{\"", "a "), ("a {{beat}}", "a {{beat}}"), ("a {{", "a "), ("cost \\$5 and $x", "cost \\$5 and "), ("hello [", "hello [")):
        assert P.cut_tail(s) == want
    got = list(P.blocks_of("one\ntwo\n- a [[lo:x]]\n• b\nthree\n\n{{beat}}\n\n1. no list"))
    assert [(k, lines) for k, _, _, lines in got] == [("para", ["one two"]), ("list", ["a [[lo:x]]", "b"]), ("para", ["three"]), ("beat", []), ("para", ["1. no list"])]
    assert list(P.inlines_of("a [[term?: x ]][[page:2]] b")) == [("text", "a "), ("term", "x"), ("page", "2"), ("text", " b")]


def test_spoken_forms(spark):
    rows = [(r"Is $a \neq b$ or $2^2 = 4$?",), ("no $ math",), ("{{beat}}[[lo:a]]",), (None,)]
    assert values(spark, rows, "s string", T.sanitize_speech(F.col("s"))) == [("Is a is not equal to b or 2 squared equals 4 ?",), ("no $ math",), ("",), (None,)]


def test_long_histories_cross_chunks(spark, monkeypatch):
    rows = [(1, "a", i, i * 7 % 3 == 0, i) for i in range(700)] + [(2, "a", i, True, i) for i in range(3)]
    df = spark.createDataFrame(rows, "student_id long, lo_id string, id long, is_correct boolean, attempted_at long")
    got = {(r.student_id, r.n): r.score for r in temporal.mastery_history(df, ["student_id", "lo_id"]).collect()}
    score = 0.3
    for i in range(700):
        score = min(0.98, max(0.02, score + 0.15 * ((i * 7 % 3 == 0) - score)))
        assert abs(got[1, i + 1] - score) < 1e-12
    assert len(got) == 703
    # a key that is cut into pieces has the same history
    want = sorted(map(tuple, temporal.mastery_history(df, ["student_id", "lo_id"]).collect()))
    pieces = temporal.mastery_history(df, ["student_id", "lo_id"], hot=100)
    got = sorted(map(tuple, pieces.collect()))
    assert [(*r[:3], *r[4:]) for r in got] == [(*r[:3], *r[4:]) for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_graph_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")], "src_id string, dst_id string")
    assert {r.id for r in graph.cycle_members(e).collect()} == {"a", "b", "c", "x"}
    roots = spark.createDataFrame([("a",)], "root string")
    assert {r.id for r in graph.reachable(e, roots).collect()} == {"a", "b", "c", "d"}
    assert graph.layers(spark.createDataFrame([("a",)], "id string"), e).count() == 5  # ends, whatever the layers
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src_id string, dst_id string")
    assert {(r.id, r.layer) for r in graph.layers(spark.createDataFrame([("z",)], "id string"), diamond).collect()} == {("z", 0), ("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}


def test_as_of_join(spark):
    probes = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    facts = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (3, 1, "c")], "k int, f int, v string")
    got = {(r.k, r.t): r.v for r in temporal.as_of_join(probes, facts, ["k"], "t", "f", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_batches_are_folded_in_pieces():
    texts = ["كَتَـبَ ΑΣ İa" * 5000, None, "", "Ab" * 40_000, "ة"] * 20
    got = list(T.fold_for_match.func(iter([pd.Series(texts)])))
    assert len(got) > 1
    marks = {*map(chr, range(0x64B, 0x660)), "ٰ", "ـ"}
    for s, folded, places in zip(texts, *(pd.concat(got)[c] for c in ("folded", "places")), strict=True):
        if s is None:
            assert folded is None and places is None
            continue
        letters = dict(zip(T.FOLD6_FROM, T.FOLD6_TO, strict=True))
        want = [(low, i) for i, ch in enumerate(s) if ch not in marks for low in letters.get(ch, ch).lower()]
        assert folded == "".join(low for low, _ in want) and list(places) == [i for _, i in want]


def test_messages_are_cut_to_tokens_in_pieces():
    texts = pd.Series(["one two. {{beat}} " * 5000] * 30)
    got = list(stateful._tokens.func(iter([texts])))
    assert len(got) > 1 and [len(x) for x in pd.concat(got)] == [15_000] * 30


def test_a_phrase_is_folded_once(spark):
    plan = spark.range(1).select(parsing.parse_phrase(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") <= 3  # of the phrase and of its words


def test_texts_are_folded_once_for_their_shingles(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e"), (2, "a b"), (3, None), (4, "x a b c d")], "id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    shingles = T.word_shingles(docs, T.fold_words(F.col("text")), ["id"])
    plan = shingles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    assert sorted(tuple(r) for r in shingles.collect()) == [(1, "a b c d"), (1, "b c d e"), (4, "a b c d"), (4, "x a b c")]
