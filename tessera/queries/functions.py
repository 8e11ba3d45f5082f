"""Text, protocol, grading, gate, plan and streaming queries over the synthetic tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import protocol as P
from tessera.functions import text as T
from tessera.operators import gates, graph, rollup, temporal
from tessera.plans import study_plan, views
from tessera.queries.registry import ORACLES, query
from tessera.queries.relational import SLUG, pre
from tessera.sources.sinks import shared_folder
from tessera.streaming import guard, jsonl, ordered, session_cache, stateful

PUNCT = r"[!-/:-@\[-`{-~]"


def docs(t):
    return t.raw("documents").select("doc_id", "text")


# --- text ----------------------------------------------------------------------------------------


@query("x3_compare_loose", rf"SELECT item_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\p{{P}}\p{{S}}]', '', 'g'), '\s+', ' ', 'g')) AS folded FROM benchmark", prelude=False)
def _(t):
    return t.raw("benchmark").select("item_id", T.compare_loose(F.col("text")).alias("folded"))


@query("x4_fold_words", r"SELECT item_id, CAST(len(list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}]', ' ', 'g'), '\s+'), lambda w: w != '')) AS INT) AS words FROM benchmark", prelude=False)
def _(t):
    return t.raw("benchmark").select("item_id", F.size(T.fold_words(F.col("text"))).alias("words"))


@query("x1_store_form", r"SELECT item_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS stored FROM benchmark", prelude=False)
def _(t):
    return t.raw("benchmark").select("item_id", T.store_form(F.col("text")).alias("stored"))


@query("x10_is_vowelled", "SELECT p_partkey, CASE WHEN p_partkey % 5 + p_partkey % 7 = 0 THEN FALSE ELSE (p_partkey % 5) * 1.0 / (p_partkey % 5 + p_partkey % 7) >= 0.2 END AS vowelled FROM part", prelude=False)
def _(t):
    words = F.concat(F.expr("repeat('كَتَبَ ', CAST(p_partkey % 5 AS INT))"), F.expr("repeat('كتب ', CAST(p_partkey % 7 AS INT))"))
    return t.raw("part").select("p_partkey", T.is_vowelled(words).alias("vowelled"))


@query(
    "x15_contaminated",
    r""", w AS (SELECT item_id AS id, list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}]', ' ', 'g'), '\s+'), lambda w: w != '') AS l FROM benchmark),
    c AS (SELECT DISTINCT array_to_string(l[i:i + 3], ' ') AS s FROM (SELECT l, unnest(range(1, len(l) - 2)) AS i FROM w WHERE len(l) >= 4)),
    d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}]', ' ', 'g'), '\s+'), lambda w: w != '') AS l FROM documents)
    SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(l[i:i + 3], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 2)) AS i FROM d WHERE len(l) >= 4)) WHERE s IN (SELECT s FROM c)""",
)
def _(t):
    return T.contaminated(docs(t), t.raw("benchmark"), "doc_id", "text", "text")


_FOLDED = r"list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}]', ' ', 'g'), '\s+'), lambda w: w != '')"


@query(
    "x14_longest_shared_run",
    f"""WITH a AS (SELECT doc_id, {_FOLDED} AS l FROM documents), b AS (SELECT item_id, {_FOLDED} AS l FROM benchmark),
    sa AS (SELECT doc_id, array_to_string(l[i:i + 3], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 2)) AS i FROM a)), sb AS (SELECT item_id, array_to_string(l[i:i + 3], ' ') AS s FROM (SELECT item_id, l, unnest(range(1, len(l) - 2)) AS i FROM b)),
    p AS (SELECT DISTINCT doc_id, item_id FROM sa JOIN sb USING (s)),
    wa AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM a WHERE doc_id IN (SELECT doc_id FROM p)), wb AS (SELECT item_id, unnest(l) AS w, unnest(range(len(l))) AS j FROM b),
    m AS (SELECT doc_id, item_id, i, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM p JOIN wa USING (doc_id) JOIN wb USING (item_id, w)),
    r AS (SELECT doc_id, item_id, min(i) AS i, count(*) AS n FROM m GROUP BY doc_id, item_id, d, g),
    best AS (SELECT doc_id, item_id, max(n) AS n, arg_min(i, (-n, i)) AS i FROM r GROUP BY ALL)
    SELECT doc_id, item_id, CAST(n AS INT) AS length, array_to_string(l[i + 1:i + n], ' ') AS run FROM best JOIN a USING (doc_id)""",
    prelude=False,
)
def _(t):
    hits = T.contaminated(docs(t), t.raw("benchmark"), "doc_id", "text", "text")
    return T.shared_runs(docs(t).join(hits, "doc_id", "left_semi"), t.raw("benchmark"), "doc_id", "item_id")


@query("x16_markers", "SELECT doc_id, contains(text, '@') AS at_sign, contains(text, 'http') AS link FROM documents", prelude=False)
def _(t):
    hits = T.marker_hits(F.col("text"), ["http"], {"at": "@"})
    return docs(t).select("doc_id", F.array_contains(hits, "at").alias("at_sign"), F.contains("text", F.lit("http")).alias("link"))


@query("x17_digits", "SELECT p_partkey, translate(CAST(p_partkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS shown FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", T.to_arabic_digits(F.col("p_partkey").cast("string")).alias("shown"))


@query("x18_seal", r"SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS seal FROM conversations GROUP BY 1", prelude=False)
def _(t):
    units = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("u"))
    return units.select("conv_id", T.seal(F.transform("u", lambda u: u["text"])).alias("seal"))


@query("x19_content_address", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN sha256(text) END, CASE WHEN doc_id % 3 = 1 THEN 'known' END, 'unavailable:' || substr(sha256(source || '|' || lang), 1, 32)) AS address FROM documents", prelude=False)
def _(t):
    d = t.raw("documents")
    return d.select("doc_id", T.source_address(F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)), F.when(F.col("doc_id") % 3 == 1, F.lit("known")), F.col("source"), F.col("lang")).alias("address"))


@query("x21_short_name", r"SELECT id, string_split(trim(display_name), ' ')[1] AS name FROM students")
def _(t):
    return t.students.select("id", T.short_name(F.col("display_name")).alias("name"))


@query("x22_pick_id", "SELECT event_id, CASE WHEN user_id < 50 THEN user_id WHEN TRUE THEN 1 END AS picked FROM events", prelude=False)
def _(t):
    return t.raw("events").select("event_id", T.pick_id(F.col("user_id").cast("string"), F.sequence(F.lit(0), F.lit(49)).cast("array<long>")).alias("picked"))


@query("x23_first_enum", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'R' WHEN contains(p_name, 'widget') THEN 'W' ELSE 'other' END AS kind FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", T.first_enum(F.col("p_name"), {"ring": "R", "widget": "W"}, "other").alias("kind"))


@query("x25_truncate", "SELECT doc_id, substr(text, 1, 140) AS head FROM documents", prelude=False)
def _(t):
    return docs(t).select("doc_id", T.truncate(F.col("text"), 140).alias("head"))


@query("x8_locate_span")
def _(t):
    rows = t.raw("benchmark").select("item_id", "text", F.element_at(F.split("text", " "), 3).alias("find"))
    return rows.select("item_id", "find", T.locate_span("text", "find", F.lit(1), F.lit(True)).alias("s")).select("item_id", "find", "s.start", "s.end")


@query("x9_tokens", r"SELECT item_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w != '')) AS INT) AS n FROM benchmark", prelude=False)
def _(t):
    return t.raw("benchmark").select("item_id", F.size(T.words_with_places("text")).alias("n"))


SPOKEN = r" **bold** • $a \times b = c^2$ {{widget:viz:{\"a\": 1}}} [[lo:x]] snake_case $\{ n(A) \}$ كتاب"


@query("x20_speech", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' bold a times b equals c squared snake_case n of A' || CASE WHEN turn % 2 = 0 THEN ' كتاب' ELSE '' END AS said FROM conversations", prelude=False)
def _(t):
    c = F.concat("text", F.lit(SPOKEN.replace('\\"', '"')))
    return t.raw("conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, T.sanitize_speech(c)).otherwise(T.sanitize_speech(c, keep_arabic=False)).alias("said"))


# --- protocol ------------------------------------------------------------------------------------


def chat(t):
    cite = F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" [[lo:"), F.col("conv_id") % 9, F.lit("]] and [[page:"), F.col("turn"), F.lit("]] [[lo:"), F.col("conv_id") % 9, F.lit("]]"))).otherwise(F.lit(""))
    return t.raw("conversations").select("conv_id", "turn", F.concat("text", cite).alias("text"))


@query("c1_citations", "SELECT conv_id, turn, CAST(unnest([1, 2]) AS INT) AS place, unnest(['lo', 'page']) AS kind, unnest(['lo:' || (conv_id % 9), CAST(turn AS VARCHAR)]) AS id FROM conversations WHERE turn % 2 = 1", prelude=False)
def _(t):
    return chat(t).select("conv_id", "turn", F.posexplode(P.citations(F.col("text"))).alias("p", "c")).select("conv_id", "turn", (F.col("p") + 1).alias("place"), "c.kind", "c.id")


def spliced(t, *parts: str):
    """Chat turns with one of ``parts`` (SQL expressions) behind the text, by the turn's number."""
    tail = "CASE turn % " + str(len(parts)) + "".join(f" WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"
    return t.raw("conversations").select("conv_id", "turn", F.concat("text", F.expr(tail)).alias("text"))


@query("c2_wide_citations", "SELECT conv_id, turn, CAST(unnest([1, 2]) AS INT) AS place, unnest(['term', 'q']) AS kind, unnest(['t' || turn, 'q:' || conv_id]) AS id FROM conversations", prelude=False)
def _(t):
    c = spliced(t, "concat(' [[term?: t', turn, ' ]] [[term:x]] [[q:', conv_id, ']] [[term?:t', turn, ']]')")
    return c.select("conv_id", "turn", F.posexplode(P.citations(F.col("text"), P.CITE_WIDE)).alias("p", "c")).select("conv_id", "turn", (F.col("p") + 1).alias("place"), "c.kind", "c.id")


DIRECTIVES = (
    "concat(' {{show_question: q:', conv_id, ' }} then {{beat}}')",
    """concat('{{widget:pair_plotter:{"prompt": "}}", "target": {"x": ', turn, '}}}} {{check_in}}')""",
    """concat('{{show_passage:{"id": " t:', conv_id, '", "unit": ', turn, ', "view": "full"}}}{{switch_subject:math}} {{switch_subject:none}}')""",
    """concat('{{widget:viz:[1]}} {{widget:viz:{"a" 1}}}{{widget:viz_ref:v:', turn, '}}}{{finish_lesson}}')""",
)


@query(
    "c3_directives",
    """SELECT conv_id, turn, 1 AS place, CASE turn % 4 WHEN 0 THEN 'question' WHEN 1 THEN 'widget' WHEN 2 THEN 'passage_ref' ELSE 'widget' END AS kind, CASE turn % 4 WHEN 1 THEN 'pair_plotter' WHEN 3 THEN 'viz_ref' END AS widget,
    CASE turn % 4 WHEN 0 THEN 'q:' || conv_id WHEN 1 THEN '{"prompt": "}}", "target": {"x": ' || turn || '}}' WHEN 2 THEN '{"id": "t:' || conv_id || '", "unit": ' || turn || ', "view": "context"}' ELSE '{"id": "v:' || turn || '"}' END AS argument FROM conversations
    UNION ALL SELECT conv_id, turn, 2, CASE turn % 4 WHEN 0 THEN 'beat' WHEN 1 THEN 'check_in' WHEN 2 THEN 'switch_subject' ELSE 'finish' END, NULL, CASE WHEN turn % 4 = 2 THEN 'math' ELSE '' END FROM conversations""",
    prelude=False,
)
def _(t):
    d = spliced(t, *DIRECTIVES).select("conv_id", "turn", F.posexplode(P.directives("text")).alias("p", "d"))
    return d.select("conv_id", "turn", (F.col("p") + 1).alias("place"), "d.kind", "d.widget", "d.argument")


#: Tails of a message that is still coming, and what may be shown of each.
TAILS = (("{{be", ""), (' {{widget:viz:{"a": {"b": "}}"}', " "), (" [[lo:u1", " "), (" $x + 1", " "), (" {{beat}} $x$ [[lo:a]]", None), (" costs \\$5", None), (" {{unknown", None))


@query("c4_cut_tail", "SELECT conv_id, turn, text || CASE turn % 7 " + " ".join(f"WHEN {i} THEN '{tail if left is None else left}'" for i, (tail, left) in enumerate(TAILS)) + " END AS text FROM conversations", prelude=False)
def _(t):
    tail = F.element_at(F.array(*[F.lit(a) for a, _ in TAILS]), (F.col("turn") % len(TAILS) + 1).cast("int"))
    return t.raw("conversations").select("conv_id", "turn", P.strip_incomplete_tail(F.concat("text", tail)).alias("text"))


@query(
    "c5_message_blocks",
    r"""SELECT conv_id, turn, 0 AS block, 'para' AS kind, NULL AS argument, 0 AS item, 0 AS place, 'text' AS inline, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != ''), ' ') AS value FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'list', NULL, 0, 0, 'text', 'see ' FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'list', NULL, 0, 1, 'lo', 'lo:' || conv_id FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'list', NULL, 1, 0, 'text', 'two' FROM conversations
    UNION ALL SELECT conv_id, turn, 2, 'highlight', 'a' || turn || ',b', NULL, NULL, NULL, NULL FROM conversations
    UNION ALL SELECT conv_id, turn, 3, 'para', NULL, 0, 0, 'text', 'end * no list' FROM conversations""",
    prelude=False,
)
def _(t):
    t.spark.udtf.register("parse_message", P.ParseMessage)
    spliced(t, r"concat('\n- see [[lo:', conv_id, ']]\n• two\n\n{{highlight:a', turn, ', b}}\n\nend\n* no list {{bea')").createOrReplaceTempView("tessera_messages")
    return t.spark.sql("SELECT m.conv_id, m.turn, b.block, b.kind, b.argument, b.item, b.place, b.inline, b.value FROM tessera_messages m, LATERAL parse_message(m.text, true) b")


@query("c6_highlights", "SELECT conv_id, turn, unnest(['n' || turn % 3, 'm' || conv_id]) AS h FROM conversations", prelude=False)
def _(t):
    c = spliced(t, "concat('{{highlight: n', turn % 3, ' , m', conv_id, ' ,}} x {{highlight:n', turn % 3, '}}')")
    return c.select("conv_id", "turn", F.explode(P.highlights(F.col("text"))).alias("h"))


@query("c7_cited_los", "SELECT q.id, q.lo_id FROM questions q WHERE q.id IN (SELECT question_id FROM attempts)")
def _(t):
    cited = t.attempts.select(F.col("question_id").alias("id")).distinct()
    return t.questions.join(cited, "id", "left_semi").select("id", "lo_id")


@query(
    "c8_rating",
    """SELECT event_id, CASE WHEN ok THEN CAST(floor(s + 1) AS INT) END AS score, CASE WHEN ok THEN v END AS verdict, CASE WHEN ok THEN CAST(least(event_id % 7, 4) AS INT) END AS strengths
    FROM (SELECT *, s + 0.5 BETWEEN 0 AND 100 AND v != 'great' AS ok FROM (SELECT event_id, event_id % 131 AS s, CASE event_id % 4 WHEN 0 THEN 'mastered' WHEN 1 THEN 'developing' WHEN 2 THEN 'needs_work' ELSE 'great' END AS v FROM events))""",
    prelude=False,
)
def _(t):
    e = t.raw("events").selectExpr("event_id", """concat('ok {"score": ', event_id % 131, '.5, "verdict": "', elt(CAST(event_id % 4 + 1 AS INT), 'mastered', 'developing', 'needs_work', 'great'), '", "strengths": [', array_join(array_repeat('"a"', CAST(event_id % 7 AS INT)), ','), ']} bye') AS s""")
    r = e.select("event_id", P.rating(F.col("s")).alias("r"))
    return r.select("event_id", "r.score", "r.verdict", F.when(F.col("r").isNotNull(), F.size("r.strengths")).alias("strengths"))


@query("c9_json_strings", "SELECT event_id, '$.t' AS path, event_type AS text FROM events UNION ALL SELECT event_id, '$.l[1]', 'x' FROM events", prelude=False)
def _(t):
    t.spark.udtf.register("json_strings", P.JsonStrings)
    e = t.raw("events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u"))).alias("j"))
    e.select("event_id", F.expr("concat(left(j, length(j) - 1), ',\"l\":[1,\"x\"]}')").alias("j")).createOrReplaceTempView("tessera_json")
    return t.spark.sql("SELECT e.event_id, s.path, s.text FROM tessera_json e, LATERAL json_strings(e.j) s")


@query("c10_rewrite_refs", """SELECT p_partkey, '{"a": [{"ref": "gr:' || p_brand || '"}], "ref": "gr:x"}' AS j FROM part""", prelude=False)
def _(t):
    j = F.concat(F.lit('{"a": [{"ref": "'), "p_brand", F.lit('"}], "ref": "x"}'))
    return t.raw("part").select("p_partkey", P.rewrite_refs(j, F.lit("ref"), F.lit("gr:")).alias("j"))


@query("c11_solution", "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INT) AS step, n_name AS text_md FROM nation", prelude=False)
def _(t):
    s = t.raw("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("s")).withColumn("c", F.expr("CAST(array() AS array<string>)"))
    return s.select("n_regionkey", F.explode(P.encode_solution(F.col("s"), F.col("c"))).alias("x")).select("n_regionkey", "x.step", "x.text_md")


@query("c12_answer", """SELECT id, '{"type":"' || question_type || '"' || CASE WHEN status = 'live' THEN ',"value":"' || correct_answer || '"' ELSE '' END || '}' AS answer FROM questions""")
def _(t):
    return t.questions.select("id", P.encode_answer(F.col("question_type"), value=F.when(F.col("status") == "live", F.col("correct_answer"))).alias("answer"))


@query("c13_visual_events", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 OR p_partkey % 5 < 2 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS n FROM part", prelude=False)
def _(t):
    """Lists of 0 to 4 labelled events and one without a label, under three names that are known and one that isn't."""
    spec = F.expr("""concat('{"', elt(CAST(p_partkey % 4 + 1 AS INT), 'events', 'items', 'points', 'others'), '": [', repeat(concat('{"', elt(CAST(p_partkey % 3 + 1 AS INT), 'label', 'title', 'name'), '": "x", "year": "3"},'), CAST(p_partkey % 5 AS INT)), '{"label": " "}]}')""")
    e = P.normalize_events(spec)
    return t.raw("part").select("p_partkey", F.when(e.isNotNull(), F.size(e)).alias("n"))


@query("c16_grounding", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 's' || user_id ELSE '' END AS chat_session FROM events""", prelude=False)
def _(t):
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"chat_session":"s'), "user_id", F.lit('"}'))).otherwise("{}")
    return t.raw("events").select("event_id", P.grounding(j)["chat_session"].alias("chat_session"))


@query("c17_render", "SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || p_type AS line FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", P.render_lines([F.col("p_name"), F.col("p_brand"), F.col("p_type")]).alias("line"))


@query("c18_sse", """SELECT event_id, 'data: {"t":"' || event_type || '"}' || chr(10) || chr(10) AS frame FROM events""", prelude=False)
def _(t):
    return t.raw("events").select("event_id", P.sse(F.struct(F.col("event_type").alias("t"))).alias("frame"))


# --- numbers -------------------------------------------------------------------------------------


@query("n1_grade", "SELECT a.id, coalesce(CASE WHEN q.question_type = 'numeric' THEN abs(CAST(q.correct_answer AS DOUBLE) - CAST(a.given_answer AS DOUBLE)) < 1e-6 ELSE q.correct_answer = a.given_answer END, FALSE) AS correct FROM attempts a JOIN questions q ON q.id = a.question_id")
def _(t):
    q = t.questions.select(F.col("id").alias("question_id"), "question_type", "correct_answer")
    return t.attempts.join(q, "question_id").select("id", N.grade(F.col("question_type"), F.col("correct_answer"), F.col("given_answer")).alias("correct"))


@query("n1_number_prefix", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN -(event_id + 0.5::DOUBLE) WHEN 1 THEN event_id * 100::DOUBLE WHEN 3 THEN event_id::DOUBLE END AS x FROM events", prelude=False)
def _(t):
    return t.raw("events").select("event_id", N.number_prefix(F.expr("elt(CAST(event_id % 4 + 1 AS INT), concat(' -', event_id, '.5 m'), concat(event_id, 'e2x'), concat('x', event_id), concat(event_id, '.'))")).alias("x"))


@query("n3_tier", "SELECT student_id, lo_id, CASE WHEN score < 0.4 THEN 'basic' WHEN score < 0.7 THEN 'standard' ELSE 'advanced' END AS tier FROM mastery WHERE system_to IS NULL")
def _(t):
    return temporal.current(t.mastery).select("student_id", "lo_id", rollup.tier_for(F.col("score")).alias("tier"))


@query("n7_slot_compare", "SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'match' WHEN split_part(p_name, ' ', 1) = 'red' AND p_name LIKE 'red %' AND p_name = 'red' THEN 'variant' ELSE 'conflict' END AS verdict FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", N.slot_compare(F.col("p_name"), F.lit("widget red")).alias("verdict"))


@query(
    "n5_grade_slots",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'KEY_INVALID' WHEN c IS NULL AND v THEN 'VARIANT' WHEN c IS NULL THEN 'AGREE' WHEN s >= 0.5 THEN 'PARTIAL' ELSE 'DISAGREE' END AS verdict, CASE WHEN p_partkey % 7 != 0 THEN s END AS score, CASE WHEN p_partkey % 7 != 0 THEN c END AS first_conflict
    FROM (SELECT p_partkey, p_partkey % 4 = 2 AS v, round((3 * (p_partkey % 2 = 0)::INT + 2 * (p_partkey % 3 = 0)::INT + 3 * (p_partkey % 5 != 0)::INT) / 8.0::DOUBLE, 3) AS s, CASE WHEN p_partkey % 2 != 0 THEN 'role' WHEN p_partkey % 3 != 0 THEN 'state' WHEN p_partkey % 5 = 0 THEN 'sign' END AS c FROM part)""",
    prelude=False,
)
def _(t):
    submission = F.expr("struct(CASE p_partkey % 4 WHEN 0 THEN 'the subject' WHEN 2 THEN 'subject' ELSE 'object' END AS role, IF(p_partkey % 3 = 0, 'raised', 'held') AS state, IF(p_partkey % 5 != 0, 'damma', 'fatha') AS sign, CAST(NULL AS STRING) AS position, CAST(NULL AS STRING) AS kind)")
    key = F.expr("struct(IF(p_partkey % 7 != 0, 'the subject', NULL) AS role, 'raised' AS state, 'damma' AS sign, CAST(NULL AS STRING) AS position, CAST(NULL AS STRING) AS kind)")
    g = t.raw("part").select("p_partkey", N.grade_slots(submission, key).alias("g"))
    valid = F.col("g.verdict") != "KEY_INVALID"
    return g.select("p_partkey", "g.verdict", F.when(valid, F.col("g.score")).alias("score"), F.when(valid, F.col("g.first_conflict")).alias("first_conflict"))


@query("n11_mcq_match", "SELECT id, lower(substr(correct_answer, 1, 1)) = lower(substr(tier, 1, 1)) AS ok FROM questions")
def _(t):
    return t.questions.select("id", N.mcq_match(F.col("correct_answer"), F.col("tier")).alias("ok"))


@query("n13_mcq_key", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'b' WHEN 1 THEN 'c' WHEN 2 THEN 'a' WHEN 3 THEN 'b' WHEN 4 THEN 'c' END AS key FROM part", prelude=False)
def _(t):
    """Keys alone, in brackets at the beginning, the text of a choice within the answer (folded), none, brackets too far behind, one choice only."""
    answer = F.expr("elt(CAST(p_partkey % 8 + 1 AS INT), 'b', '(c) it', 'x (a)', concat('the «', p_type, '», of course'), concat('it is: ', p_name), 'zzz', 'no, it is (a)', 'b')")
    choices = F.expr("slice(array(struct('a' AS key, p_brand AS text), struct('b' AS key, p_type AS text), struct('c' AS key, p_name AS text)), IF(p_partkey % 8 = 7, 2, 1), IF(p_partkey % 8 = 7, 1, 3))")
    return t.raw("part").select("p_partkey", N.mcq_key(answer, choices).alias("key"))


@query("n15_parabola", "SELECT vec_id, round(-b / (2 * a), 6) AS vx, round(b * b - 4 * a * c, 6) AS d, CAST(CASE WHEN b * b - 4 * a * c > 0 THEN 2 WHEN b * b - 4 * a * c = 0 THEN 1 ELSE 0 END AS INT) AS roots FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 2 AS a, CAST(embedding[2] AS DOUBLE) * 10 AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)", prelude=False)
def _(t):
    e = t.raw("embeddings").selectExpr("vec_id", "CAST(embedding[0] AS DOUBLE) + 2 AS a", "CAST(embedding[1] AS DOUBLE) * 10 AS b", "CAST(embedding[2] AS DOUBLE) AS c")
    p = N.parabola(F.col("a"), F.col("b"), F.col("c"))
    return e.select("vec_id", F.round(p["vx"], 6).alias("vx"), F.round(p["discriminant"], 6).alias("d"), F.size(p["roots"]).alias("roots"))


@query("n16_triangle", "SELECT p_partkey, round(sqrt(CAST(p_size AS DOUBLE) * p_size + 16), 6) AS h FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", F.round(N.complete_right_triangle(F.col("p_size").cast("double"), F.lit(4.0), F.lit(None).cast("double"))[2], 6).alias("h"))


@query("n18_bars", "SELECT p_partkey, round(greatest(p_retailprice, 0) / greatest(max(p_retailprice) OVER (PARTITION BY p_brand), 1), 9) AS height FROM part", prelude=False)
def _(t):
    from pyspark.sql import Window

    return t.raw("part").select("p_partkey", F.round(F.greatest("p_retailprice", F.lit(0)) / F.greatest(F.max("p_retailprice").over(Window.partitionBy("p_brand")), F.lit(1)), 9).alias("height"))


@query("n19_quadrant", "SELECT vec_id, CASE WHEN x = 0 OR y = 0 THEN 'axis' WHEN x > 0 AND y > 0 THEN 'I' WHEN x < 0 AND y > 0 THEN 'II' WHEN x < 0 AND y < 0 THEN 'III' ELSE 'IV' END AS q FROM (SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings)", prelude=False)
def _(t):
    return t.raw("embeddings").select("vec_id", N.quadrant(F.col("embedding")[0], F.col("embedding")[1]).alias("q"))


@query(
    "n20_replays",
    r"""SELECT p_partkey, CAST(CASE WHEN d SIMILAR TO '.*1.*2.*3.*' THEN 3 WHEN d SIMILAR TO '.*1.*2.*' THEN 2 WHEN d LIKE '%1%' THEN 1 ELSE 0 END AS INT) AS placed,
    CAST(CASE WHEN d SIMILAR TO '.*1.*2.*3.*' THEN length(regexp_extract(d, '^[^1]*1[^2]*2[^3]*3')) - 3 WHEN d SIMILAR TO '.*1.*2.*' THEN length(d) - 2 WHEN d LIKE '%1%' THEN length(d) - 1 ELSE length(d) END AS INT) AS missteps,
    CAST(contains(d, '1')::INT + contains(d, '2')::INT AS INT) AS found, CAST(length(regexp_replace(d, '[12]', '', 'g')) AS INT) AS misses, CAST(least(w, 2) AS INT) AS strikes, contains(d, '5') AND w < 2 AS solved, NOT (contains(d, '5') AND w < 2) AND w >= 2 AS revealed,
    CAST((d[1] = d[-1])::INT AS INT) AS matched, CAST((d[1] != d[-1])::INT AS INT) AS wrong
    FROM (SELECT *, CASE WHEN contains(d, '5') THEN instr(d, '5') - 1 ELSE length(d) END AS w FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS d FROM part))""",
    prelude=False,
)
def _(t):
    """The digits of a number as taps: an order to place, spans to find, a key to hit within two tries; its first and last digit as a pair."""
    d = t.raw("part").select("p_partkey", F.split(F.col("p_partkey").cast("string"), "").alias("taps"))
    wanted, targets = F.array(*map(F.lit, "123")), F.array(F.lit("1"), F.lit("2"))
    o, s, k = N.replay_ordered(F.col("taps"), wanted), N.replay_spans(F.col("taps"), targets), N.replay_strikes(F.col("taps"), F.lit("5"))
    tap = lambda side, at: F.struct(F.lit(side).alias("side"), F.concat(F.lit(side[0]), F.element_at("taps", at)).alias("item"))
    pairs = F.create_map(*[F.lit(f"{side}{i}") for i in range(10) for side in "td"])
    m = N.replay_pairs(F.array(tap("def", 1), tap("term", 1), tap("def", -1)), pairs)
    return d.select("p_partkey", o["cursor"].alias("placed"), o["missteps"].alias("missteps"), s["found"].alias("found"), s["misses"].alias("misses"), k["strikes"].alias("strikes"), k["solved"].alias("solved"), k["revealed"].alias("revealed"), m["matched"].alias("matched"), m["wrong"].alias("wrong"))


@query("n24_product_check", "SELECT user_id, CAST(count(DISTINCT event_type) FILTER (event_type NOT IN ('view', 'click')) AS INT) AS wrong, CAST(2 - count(DISTINCT event_type) FILTER (event_type IN ('view', 'click')) AS INT) AS missed FROM events GROUP BY 1", prelude=False)
def _(t):
    p = t.raw("events").groupBy("user_id").agg(F.collect_set("event_type").alias("p"))
    c = N.product_check(F.col("p"), F.array(F.lit("view"), F.lit("click")))
    return p.select("user_id", c["wrong"].alias("wrong"), c["missed"].alias("missed"))


@query("p4_colour", "SELECT p_partkey, printf('#%02x%02x00', CAST(floor(200.5 - 200 * s) AS INT), CAST(floor(200 * s + 0.5) AS INT)) AS colour FROM (SELECT p_partkey, least(1.0, greatest(0.0, (p_partkey % 121 - 10) / 100.0::DOUBLE)) AS s FROM part)", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", N.lerp_colour((F.col("p_partkey") % 121 - 10) / 100.0, [(0.0, (200, 0, 0)), (1.0, (0, 200, 0))]).alias("colour"))


# --- gates ---------------------------------------------------------------------------------------


@query("v1_edge_endpoints", "SELECT 'V1' AS rule, CAST(id AS VARCHAR) AS id, dst_id AS detail FROM edges WHERE dst_id NOT IN (SELECT id FROM nodes)")
def _(t):
    return gates.edge_endpoints(t.edges, t.nodes)


@query("v2_question_refs", "SELECT 'V2' AS rule, id, lo_id AS detail FROM questions WHERE lo_id NOT IN (SELECT lo_id FROM lo_keys WHERE k % 9 != 0) UNION ALL SELECT 'V2', id, lo_id FROM visuals WHERE lo_id NOT IN (SELECT lo_id FROM lo_keys WHERE k % 9 != 0)")
def _(t):
    return gates.question_refs(t.questions, t.visuals, t.lo_keys.filter("k % 9 != 0").selectExpr("lo_id AS id"))


@query("v3_cycles", ", e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), reach AS (SELECT a AS r, b AS x FROM e UNION SELECT r.r, e.b FROM reach r JOIN e ON e.a = r.x) SELECT DISTINCT 'V3' AS rule, CAST(r AS VARCHAR) AS id, 'cycle' AS detail FROM reach WHERE r = x")
def _(t):
    return gates.acyclic(t.raw("nation").selectExpr("n_nationkey AS src_id", "(n_nationkey * 3 + 1) % 25 AS dst_id"))


@query("v5_choices", "SELECT 'V5' AS rule, id, CAST(NULL AS VARCHAR) AS detail FROM questions WHERE question_type = 'mcq' AND correct_answer NOT IN ('0', '1', '2', '3')")
def _(t):
    choices = F.array(*[F.struct(F.lit(str(i)).alias("key"), F.lit("t").alias("text")) for i in range(4)])
    return gates.choices_and_key(t.questions.withColumn("choices", choices))


@query("v7_kinds", "SELECT 'V7' AS rule, id, kind AS detail FROM visuals WHERE kind NOT IN ('economy', 'standard')")
def _(t):
    return gates.known_kind(t.visuals, ["economy", "standard"])


@query("v8_seals", "SELECT 'V8' AS rule, CAST(doc_id AS VARCHAR) AS id, 'seal' AS detail FROM documents WHERE doc_id % 10 = 0", prelude=False)
def _(t):
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.array(F.struct(F.lit(1).alias("n"), F.col("text"))).alias("units"), F.when(F.col("doc_id") % 10 != 0, F.sha2("text", 256)).otherwise("0").alias("text_sha256"), *[F.lit(None).cast("string").alias(c) for c in ("approved_sha256", "approved_by", "approved_at")])
    return gates.seal_holds(d)


@query("v10_units", "SELECT 'V10' AS rule, CAST(conv_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS detail FROM conversations GROUP BY conv_id HAVING max(turn) + 1 != count(*) OR min(turn) != 0 OR conv_id % 17 = 3", prelude=False)
def _(t):
    c = t.raw("conversations").withColumn("n", F.when((F.col("conv_id") % 17 == 3) & (F.col("turn") == 0), 9).otherwise(F.col("turn") + 1).cast("int"))
    units = c.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct("n", "text")).alias("units"))
    return gates.contiguous_units(units)


@query("v12_stored_form", r"SELECT 'V12' AS rule, CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS detail FROM documents WHERE trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) != text", prelude=False)
def _(t):
    return gates.stored_form(t.raw("documents").select(F.col("doc_id").alias("id"), "text"), "text")


@query("v18_spans", "SELECT 'V18' AS rule, CAST(item_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS detail FROM benchmark WHERE item_id % 3 = 0 OR length(text) < 9", prelude=False)
def _(t):
    b = t.raw("benchmark")
    spans = b.select(F.col("item_id").alias("id"), F.col("item_id").alias("text_id"), F.lit(2).alias("start"), F.lit(9).alias("end"), F.when(F.col("item_id") % 3 == 0, "nope").otherwise(F.substring("text", 3, 7)).alias("expected"))
    return gates.span_slices(spans, b.select(F.col("item_id").alias("id"), "text"))


@query("v19_held_back", "SELECT id, CASE WHEN source_page % 10 = 0 THEN 'sealed class' WHEN source_page % 7 = 0 THEN 'sacred passage' ELSE 'unapproved passage' END AS reason FROM questions WHERE source_page % 10 = 0 OR source_page % 7 = 0 OR source_page % 7 = 1")
def _(t):
    q = t.questions.withColumn("sensitivity", F.when(F.col("source_page") % 10 == 0, "sealed")).withColumn("passage_id", F.col("source_page") % 7)
    p = t.spark.createDataFrame([(0, True, "x"), (1, False, None), (2, False, "y")], "id int, sacred boolean, approved_by string")
    return gates.held_back(q, p)


@query("v21_sources", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 4 = 1 THEN 's' || n_nationkey END, last_value(CASE WHEN n_nationkey % 4 = 1 THEN 's' || n_nationkey END IGNORE NULLS) OVER w, first_value(CASE WHEN n_nationkey % 4 = 1 THEN 's' || n_nationkey END IGNORE NULLS) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS resolved FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", prelude=False)
def _(t):
    b = t.raw("nation").select("n_nationkey", "n_regionkey", F.lit("f").alias("source_file"), F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("s"), "n_nationkey")).alias("sha256"))
    return gates.resolve_sources(b, t.spark.createDataFrame([], "path string, sha256 string"), "n_regionkey", "n_nationkey").select("n_nationkey", "resolved")


@query("v22_preflight", "SELECT 'V22' AS rule, lo_id AS id, 'collision' AS detail FROM lo_keys WHERE c_nationkey = 4 UNION ALL SELECT 'V22', 'lo:none', 'unresolved'")
def _(t):
    batch = t.lo_keys.filter("c_nationkey IN (3, 4)").selectExpr("lo_id AS id")
    externals = t.spark.createDataFrame([("lo:none",), ("m:1",)], "id string")
    return gates.preflight(t.nodes.filter("id = 'c:1'"), batch, t.nodes, t.lo_keys.filter("c_nationkey = 3").selectExpr("lo_id AS id"), externals)


@query("v23_variant_refusal", "SELECT id, CASE WHEN status != 'live' THEN 'not live' WHEN source_page % 10 = 0 THEN 'sealed' WHEN source_page % 10 = 1 THEN 'bound to a passage' END AS refusal FROM questions")
def _(t):
    q = t.questions.withColumn("sensitivity", F.when(F.col("source_page") % 10 == 0, "sealed").otherwise("open")).withColumn("passage_id", F.when(F.col("source_page") % 10 == 1, F.lit("p")))
    return gates.variant_refusal(q)


@query("v24_privacy", "SELECT 'V24' AS rule, CAST(id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS detail FROM students WHERE id % 2 = 1")
def _(t):
    return gates.privacy(t.students.withColumn("display_name", F.when(F.col("id") % 2 == 0, F.concat("display_name", F.lit(" (demo)"))).otherwise(F.col("display_name"))))


@query("v26_ledger", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'flagged' ELSE 'verified' END AS verdict, lang AS fidelity, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS approved FROM documents GROUP BY 1, 2", prelude=False)
def _(t):
    d = t.raw("documents").select(F.when(F.col("doc_id") % 3 == 0, "flagged").otherwise("verified").alias("verdict"), F.col("lang").alias("fidelity"), F.when(F.col("doc_id") % 2 == 0, "x").alias("approved_by"))
    return gates.verification_ledger(d)


@query("v27_crosscheck", "SELECT n_regionkey AS passage_id, CASE WHEN n_regionkey % 2 = 0 THEN 'verified' ELSE 'flagged' END AS verdict FROM nation GROUP BY n_regionkey", prelude=False)
def _(t):
    basis = t.raw("nation").selectExpr("n_regionkey AS passage_id", "n_nationkey AS n", "n_name AS text")
    parts = [basis.withColumn("name", F.lit(s)).withColumn("text", F.when((F.col("passage_id") % 2 == 1) & (F.col("n") % 5 == F.col("passage_id")) if s != "a" else F.lit(False), "other").otherwise(F.col("text"))) for s in "abc"]
    return gates.crosscheck(basis, parts[0].unionByName(parts[1]).unionByName(parts[2])).select("passage_id", "verdict")


@query("v29_drop_claims", "SELECT n_regionkey AS id, string_agg(n_name, ',' ORDER BY n_name) AS claims FROM nation WHERE n_nationkey % 3 != 0 AND n_regionkey != 2 GROUP BY 1", prelude=False)
def _(t):
    q = t.raw("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("claims"))
    bad = t.raw("nation").filter("n_nationkey % 3 = 0 OR n_regionkey = 2").selectExpr("n_regionkey AS id", "n_name AS claim")
    return gates.drop_claims(q, bad).select("id", F.array_join("claims", ",").alias("claims"))


@query("v30_fact_conflicts", "SELECT p_brand, p_type, count(DISTINCT p_size) AS values FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1", prelude=False)
def _(t):
    return gates.fact_conflicts(t.raw("part"), ["p_brand", "p_type"], "p_size")


@query("v31_checks", "SELECT 'V31' AS rule, id, tier AS detail FROM questions WHERE tier NOT IN ('basic', 'standard') UNION ALL SELECT 'V31', CAST(id AS VARCHAR), CAST(score AS VARCHAR) FROM checks WHERE score > 80")
def _(t):
    return gates.in_domain(t.questions, "tier", ["basic", "standard"]).unionByName(gates.in_range(t.checks, "score", 0, 80))


@query("v32_drift", "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 5 < 3", prelude=False)
def _(t):
    d = t.raw("documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.sha2("text", 256).alias("sha256"), "doc_id")
    return gates.drift(d.filter("doc_id % 5 != 0"), d.filter("doc_id % 5 != 1").withColumn("sha256", F.when(F.col("doc_id") % 5 == 2, "x").otherwise(F.col("sha256"))))


@query("v34_request_limits", "SELECT 'V34' AS rule, CAST(doc_id AS VARCHAR) AS id, 'text' AS detail FROM documents WHERE length(text) > 1200", prelude=False)
def _(t):
    return gates.request_limits(t.raw("documents").select(F.col("doc_id").alias("id"), F.lit("Some Name").alias("name"), F.array(F.lit(1)).alias("ids"), "text"))


# --- plans and views -----------------------------------------------------------------------------


@query("n4_study_plan")
def _(t):
    """Plans of all students over all LOs of the courses that have a subject (``q3_student_plan``: over all LOs)."""
    subjects = t.node_subject.filter("subject IS NOT NULL").select("lo_id").distinct()
    return views.plan_of(t, t.students, t.lo_keys.join(subjects, "lo_id", "left_semi"))


views.register(query, SLUG, pre)
_ = graph, study_plan


# --- streaming -----------------------------------------------------------------------------------


def run_stream(t, out, name: str, mode: str = "append"):
    """Run a stream over what there is, into a table in the shared folder; read that."""
    path = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{path}/out")


def stream_of(t, name: str):
    return t.spark.readStream.schema(t.raw(name).schema).parquet(f"{t.sf_dir}/{name}.parquet*")


def arriving(t, rows: DataFrame, parts: int, last: DataFrame):
    """A stream of ``rows`` in an order that has nothing to do with their times, in several files, and then of ``last``."""
    path = f"{shared_folder(t.spark)}/arriving-{uuid.uuid4().hex}"
    for k in range(parts):
        rows.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("st1_stream_mastery", "SELECT student_id, lo_id, n, round(score, 9) AS score, system_from FROM mastery")
def _(t):
    """Attempts arrive out of order; one of nobody, long after the others, lets the watermark pass them all."""
    rows = t.attempts.select("id", "student_id", "lo_id", "is_correct", "attempted_at")
    end = rows.limit(0).unionByName(t.spark.range(1).selectExpr("-1L AS id", "-1L AS student_id", "'' AS lo_id", "FALSE AS is_correct", "TIMESTAMP_NTZ '2024-06-01 00:00:00' AS attempted_at"))
    with ordered.rocks_state(t.spark):
        out = run_stream(t, ordered.ordered_mastery(arriving(t, rows, 3, end), "40 days"), "st1")
    return out.filter("NOT late").select("student_id", "lo_id", "n", F.round("score", 9).alias("score"), "system_from")


@query("st2_scd2", "SELECT student_id, lo_id, system_from, system_to FROM mastery")
def _(t):
    return t.mastery.select("student_id", "lo_id", "system_from", "system_to")


#: A vowelled passage, and how it is quoted: retyped without marks, with them and with other letters and signs, and cut in two between turns.
SEALED = "إِنَّ أَوَّلَ خُطْوَةٍ فِي الطَّرِيقِ هِيَ النِّيَّةُ"
QUOTES = ("ان اول خطوه في الطريق", "(أوّل خطوةٍ، في الطّريقِ)", "خُطْوَةٍ فِي الطَّرِيقِ هِيَ")
FIRST_HALF = "اول خطوه"


@query(
    "st3_stream_guard",
    f"""SELECT conv_id, CASE WHEN conv_id % 5 < 4 AND conv_id % 2 = 0 AND count(*) FILTER (turn = 1) > 0
      THEN left(first, greatest(0, length(first) - {guard.HOLDBACK})) || CASE WHEN length(first) > {guard.HOLDBACK} THEN chr(10) || chr(10) ELSE '' END || '{guard.REDIRECT}' ELSE string_agg(text, '' ORDER BY turn) END AS text
    FROM conversations JOIN (SELECT conv_id, text || CASE WHEN conv_id % 5 = 3 AND conv_id % 2 = 0 THEN ' {FIRST_HALF}' ELSE '' END AS first FROM conversations WHERE turn = 0) USING (conv_id) GROUP BY conv_id, first""",
    prelude=False,
)
def _(t):
    """Of the conversations with even numbers four fifths quote the passage in their second turn, each in its own way: they show the first turn up to the holdback, then the redirect, then nothing."""
    s = stream_of(t, "conversations")
    last = t.raw("conversations").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    even, way = F.col("conv_id") % 2 == 0, F.col("conv_id") % 5
    quote = F.when(even & (F.col("turn") == 1), F.when(way == 3, F.concat(F.lit(" في الطريق "), "text")).when(way < 3, F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, QUOTES)), (F.least(way, F.lit(2)) + 1).cast("int")))))
    cut = F.when(even & (F.col("turn") == 0) & (way == 3), F.concat("text", F.lit(f" {FIRST_HALF}")))
    s = s.join(F.broadcast(last), F.col("conv_id") == F.col("c")).select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("position"), F.coalesce(quote, cut, "text").alias("delta"), (F.col("turn") == F.col("last")).alias("is_end"))
    out = run_stream(t, guard.guard_stream(s, [SEALED]), "st3")
    joined = out.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("p"))
    return joined.select(F.col("session").cast("long").alias("conv_id"), F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))


CAPS = {"explain": 2, "review": 5, "learn": 14}


@query("st4_turn_cap", "SELECT surface, conv_id AS session, student_id, turn AS position FROM (SELECT *, row_number() OVER (PARTITION BY surface, conv_id, student_id ORDER BY turn) AS n FROM turns) WHERE n <= CASE surface WHEN 'explain' THEN 2 WHEN 'review' THEN 5 WHEN 'learn' THEN 14 ELSE 1000000 END")
def _(t):
    turns = t.turns.selectExpr("surface", "conv_id AS session", "student_id", "turn AS position")
    return stateful.turn_cap_batch(turns, CAPS)


@query("st4_stream_turn_cap", "SELECT surface, conv_id AS session, student_id, turn AS position FROM (SELECT *, row_number() OVER (PARTITION BY surface, conv_id, student_id ORDER BY turn) AS n FROM turns) WHERE n <= CASE surface WHEN 'explain' THEN 2 WHEN 'review' THEN 5 WHEN 'learn' THEN 14 ELSE 1000000 END")
def _(t):
    s = stream_of(t, "conversations").selectExpr("CASE WHEN conv_id % 4 = 0 THEN 'spine' WHEN conv_id % 4 = 1 THEN 'learn' WHEN conv_id % 4 = 2 THEN 'review' ELSE 'explain' END AS surface", "conv_id AS session", "conv_id % 7 AS student_id", "turn AS position")
    return run_stream(t, stateful.turn_cap(s, CAPS), "st4")


@query("st5_first_snapshot", "SELECT DISTINCT user_id, event_type FROM events", prelude=False)
def _(t):
    s = stream_of(t, "events").select("user_id", "event_type", F.to_timestamp("ts").alias("at"))
    return run_stream(t, stateful.first_per_key(s, ["user_id", "event_type"], "at", "60 days"), "st5").select("user_id", "event_type")


#: Sixtyfold time, so that sessions come again within hours; two caches.
REQUESTS = "concat('c', event_id % 2) AS cache", "event_id AS id", "concat_ws('-', user_id, (event_id % 6) div 2) AS session", "timestamp_millis(unix_micros(CAST(ts AS TIMESTAMP)) div 60000) AS at", "concat(event_type, event_id) AS context"
SNAPSHOTS = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY at_ms, id) AS n FROM (
    SELECT 'c' || (event_id % 2) AS cache, event_id AS id, user_id || '-' || ((event_id % 6) // 2) AS session, epoch_us(ts) // 60000 AS at_ms, event_type || event_id AS context FROM events)),
  walk AS (SELECT DISTINCT cache, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS session, CAST(0 AS BIGINT) AS at_ms, '' AS context, FALSE AS built, CAST([] AS STRUCT(b BIGINT, s VARCHAR, c VARCHAR)[]) AS held FROM r
    UNION ALL SELECT cache, n, id, session, at_ms, coalesce(hit.c, context) AS context, hit IS NULL AS built, CASE WHEN hit IS NULL THEN list_slice(list_append(list_filter(held, lambda x: x.s != session), {{'b': at_ms, 's': session, 'c': context}}), -{session_cache.MAX_SESSIONS}, -1) ELSE held END
    FROM (SELECT r.*, held, list_filter(held, lambda x: x.s = r.session AND r.at_ms - x.b < {session_cache.TTL_MS})[1] AS hit FROM walk JOIN r ON r.cache = walk.cache AND r.n = walk.n + 1))
SELECT cache, id, session, at_ms, context, built FROM walk WHERE n > 0"""


@query("st5_session_cache", SNAPSHOTS, prelude=False)
def _(t):
    with ordered.rocks_state(t.spark):
        return run_stream(t, session_cache.snapshot_stream(stream_of(t, "events").selectExpr(*REQUESTS)), "st5")


@query("st5_session_log", SNAPSHOTS, prelude=False)
def _(t):
    return session_cache.snapshot_batch(t.raw("events").selectExpr(*REQUESTS))


@query("st6_paced", "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) * 850 AS BIGINT) AS at_ms FROM conversations", prelude=False)
def _(t):
    return stateful.paced_schedule(t.raw("conversations"), ["conv_id"], "turn").select("conv_id", "turn", F.col("at_ms").cast("long").alias("at_ms"))


@query(
    "st6_reveal",
    """WITH d AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') || ' {{beat}} {{highlight:lo:1}} Done? yes it is' AS text FROM conversations),
    t AS (SELECT conv_id, turn, length(text) AS len, 1000 * (turn + 1) AS ended, unnest(string_split(text, ' ')) AS token, unnest(range(len(string_split(text, ' ')))) AS i FROM d),
    p AS (SELECT *, sum(length(token) + 1) OVER o - 1 AS "end", token[1:2] = '{{' AS d, token[1:2] = '{{' OR regexp_matches(token, '[.!?؟…]$') AS stop FROM t WHERE token != '' WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
    g AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM p),
    w AS (SELECT *, coalesce(sum(1 - CAST(d AS INT)) OVER (PARTITION BY conv_id, turn, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 3 AS k FROM g),
    k AS (SELECT conv_id, turn, len, ended, max("end") AS "end", max(i) AS i, CASE WHEN bool_or(d) THEN CASE WHEN arg_max(token, i) = '{{beat}}' THEN 1700 ELSE 1500 END WHEN bool_or(stop) THEN 1150 ELSE 850 END AS dwell FROM w GROUP BY conv_id, turn, len, ended, part, k),
    r AS (SELECT *, 60 + coalesce(sum(dwell) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw FROM k),
    f AS (SELECT *, CAST(CASE WHEN raw >= ended THEN least(dwell, greatest(50, 2000.0 / greatest(1, ceil((len - "end") / 18.0)))) ELSE dwell END AS DOUBLE) AS dwell_ms FROM r)
    SELECT conv_id, turn, CAST(row_number() OVER o - 1 AS INT) AS tick, CAST("end" AS INT) AS "end", round(60 + coalesce(sum(dwell_ms) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS at_ms, round(dwell_ms, 6) AS dwell_ms FROM f WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)""",
    prelude=False,
)
def _(t):
    """Every message with directives behind it; it is complete after a second for each turn, and catches up from there."""
    rows = t.raw("conversations").select("conv_id", "turn", F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(" {{beat}} {{highlight:lo:1}} Done? yes it is")).alias("text"), (1000 * (F.col("turn") + 1)).alias("ended"))
    out = stateful.reveal_schedule(rows, ["conv_id", "turn"], ended_ms="ended")
    return out.withColumns({"at_ms": F.round("at_ms", 6), "dwell_ms": F.round("dwell_ms", 6)})


@query("st7_parse_lines", "SELECT CAST(user_id AS VARCHAR) AS session, event_id AS position, event_type AS delta, event_id % 10 = 0 AS is_end FROM events WHERE event_id % 3 != 1", prelude=False)
def _(t):
    kind = F.when(F.col("event_id") % 10 == 0, "result").otherwise("stream_event")
    body = F.to_json(F.struct(kind.alias("type"), F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("position"), F.struct(F.struct(F.lit("text_delta").alias("type"), F.col("event_type").alias("text")).alias("delta")).alias("event")))
    return stateful.parse_lines(t.raw("events").select(F.when(F.col("event_id") % 3 == 1, F.expr("substr('{\"type\": \"stre', 1, 9)")).otherwise(body).alias("value")))


@query("st7_stream_lines", "SELECT CAST(user_id AS VARCHAR) AS session, event_id AS position, event_type AS delta, event_id % 10 = 0 AS is_end FROM events WHERE event_id % 3 != 1", prelude=False)
def _(t):
    """Logs of JSON lines, read as pieces of bytes that end anywhere; every third line is cut off by a break."""
    kind = F.when(F.col("event_id") % 10 == 0, "result").otherwise("stream_event")
    body = F.to_json(F.struct(kind.alias("type"), F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("position"), F.struct(F.struct(F.lit("text_delta").alias("type"), F.col("event_type").alias("text")).alias("delta")).alias("event")))
    line = F.when(F.col("event_id") % 3 == 1, F.concat(F.substring(body, 1, 20), F.lit("\n"))).otherwise(body)
    path = f"{shared_folder(t.spark)}/logs-{uuid.uuid4().hex}"
    t.raw("events").repartition(8, "user_id").select(line.alias("value")).write.text(path)
    t.spark.dataSource.register(jsonl.JsonlLogs)
    chunks = t.spark.readStream.format("jsonl_logs").options(path=path, suffix=".txt", chunkBytes=997, taskBytes=1 << 20).load()
    return run_stream(t, stateful.parse_lines(jsonl.whole_lines(chunks)), "st7")


@query("st9_retried_cost", "SELECT event_id // 2 AS call_id, round(sum(value), 6) AS cost, count(*) AS attempts, arg_max(value > 50, event_id) AS valid FROM events GROUP BY 1", prelude=False)
def _(t):
    calls = t.raw("events").selectExpr("event_id div 2 AS call_id", "event_id AS attempt", "value AS cost", "value > 50 AS valid")
    return stateful.retried_cost(calls).withColumn("cost", F.round("cost", 6))


AUDIT = f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'violation' ELSE 'info' END AS level, 'V25' AS rule, CAST(doc_id AS VARCHAR) AS id, length || ' words of ' || item_id || ': ' || left(run, 60) AS detail FROM (SELECT * FROM ({ORACLES['x14_longest_shared_run']})) WHERE doc_id % 10 != item_id % 10
    UNION ALL SELECT 'info', 'V26', CAST(doc_id AS VARCHAR), coalesce(CASE WHEN doc_id % 3 = 1 THEN 'edition' END, 'no verification record') FROM documents WHERE doc_id % 3 != 0
    UNION ALL SELECT 'count', 'V26', 'agree', CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'count', 'V26', 'flagged', CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id % 3 != 0
    UNION ALL SELECT 'violation', 'G11', src_id || ' > ' || dst_id, 'relates_to' FROM cur WHERE edge_type IN ('prerequisite', 'relates_to') AND dst_id NOT IN (SELECT id FROM nodes)"""


@query("q16_full_audit", AUDIT)
def _(t):
    strings = t.raw("documents").selectExpr("CAST(doc_id AS STRING) AS id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'authored' ELSE 'sealed' END AS class", "doc_id % 10 AS own")
    sealed = t.raw("benchmark").selectExpr("item_id AS passage_id", "text", "item_id % 10 AS own")
    passages = t.raw("documents").selectExpr("CAST(doc_id AS STRING) AS id", "CASE WHEN doc_id % 3 = 0 THEN 'agree' WHEN doc_id % 3 = 1 THEN 'differ' END AS verdict", "CASE WHEN doc_id % 3 = 1 THEN 'edition' END AS flag_reason")
    return gates.full_audit(strings, sealed, passages, t.current.filter("edge_type IN ('prerequisite', 'relates_to')"), t.nodes, "own")
