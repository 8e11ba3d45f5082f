"""Further text functions, grammar slots, gates, lifecycle and composite queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import parsing as G
from tessera.functions import text as T
from tessera.operators import gates, graph, rollup, temporal
from tessera.plans import views
from tessera.queries.functions import docs, run_stream, stream_of
from tessera.queries.registry import ORACLES, query
from tessera.sources import bundles, sinks
from tessera.streaming import stateful

MARKS = "ً-ٰٟ"
FOLD = f"translate(regexp_replace(text, '[{MARKS}ـ]', '', 'g'), 'أإآٱىة', 'اااايه')"
SQUEEZE = r"trim(regexp_replace({}, '[\s ]+', ' ', 'g'))"


def fixture(t, rows, schema):
    return t.spark.createDataFrame(rows, schema)


# --- text ----------------------------------------------------------------------------------------


@query("x2_compare_verify", "SELECT doc_id, sha256(" + SQUEEZE.format("regexp_replace(nfc_normalize(text), '[ۖ-ۭـ]', '', 'g')") + ") AS folded FROM documents", prelude=False)
def _(t):
    return docs(t).select("doc_id", F.sha2(T.compare_verify(F.col("text")), 256).alias("folded"))


@query("x5_fold_compare", "SELECT item_id, " + SQUEEZE.format(rf"""regexp_replace(translate(regexp_replace(nfc_normalize(replace(text, 'e', 'é')), '[{MARKS}ۖ-ۭـ]', '', 'g'), 'أإآٱىة', 'اااايه'), '[.,؛،؟!:"''«»()\[\]{{}}…—–-]', ' ', 'g')""") + " AS folded FROM benchmark", prelude=False)
def _(t):
    # a decomposed letter that has to be composed
    return t.raw("benchmark").select("item_id", T.fold_compare(F.replace("text", F.lit("e"), F.lit("é"))).alias("folded"))


@query("x6_normalize_search", "SELECT item_id, " + SQUEEZE.format(f"lower({FOLD})") + " AS folded FROM benchmark", prelude=False)
def _(t):
    return t.raw("benchmark").select("item_id", T.normalize_search(F.col("text")).alias("folded"))


@query("x7_fold_places", f"SELECT doc_id, sha256(lower({FOLD})) AS folded, CAST(length(lower({FOLD})) AS INT) AS places FROM documents", prelude=False)
def _(t):
    f = docs(t).select("doc_id", T.fold_for_match("text").alias("f"))
    return f.select("doc_id", F.sha2("f.folded", 256).alias("folded"), F.size("f.places").alias("places"))


@query("x11_locate_mark", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CAST(4 * (p_partkey % 5) + 5 AS INT) END AS start, CASE WHEN p_partkey % 3 > 0 THEN CAST(4 * (p_partkey % 5) + 6 AS INT) END AS \"end\", CASE WHEN p_partkey % 3 > 0 THEN CAST(4 * (p_partkey % 5) + 4 AS INT) END AS letter FROM part", prelude=False)
def _(t):
    """The mark on the last letter of a word behind 0 to 4 others; for every third row it isn't the expected one."""
    text = F.concat(F.expr("repeat('كتب ', CAST(p_partkey % 5 AS INT))"), F.lit("الولدُ قام"))
    m = t.raw("part").select("p_partkey", T.locate_mark(text, F.lit("الولد"), F.lit(-1), F.when(F.col("p_partkey") % 3 > 0, "damma").otherwise("kasra")).alias("m"))
    return m.select("p_partkey", "m.start", "m.end", "m.letter")


@query("x12_find_span", r"SELECT item_id, 1 AS unit, regexp_replace(array_to_string(string_split(text, ' ')[2:4], ' '), '\s+', ' ', 'g') AS words FROM benchmark", prelude=False)
def _(t):
    quote = F.array_join(F.slice(F.split("text", " "), 2, 3), " ")
    found = t.raw("benchmark").select("item_id", T.find_span(quote, F.array("text", F.lit("other"))).alias("s"))
    return found.select("item_id", "s.unit", "s.words")


@query(
    "x13_match_run",
    r"""SELECT item_id, CAST(i - 1 AS INT) AS start, CAST(i + 1 AS INT) AS "end" FROM (SELECT item_id, list_min(list_filter(range(1, len(w) - 1), lambda i: w[i:i + 2] = w[3:5])) AS i
    FROM (SELECT item_id, list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x != ''), lambda x: regexp_replace(lower(x), '[\p{P}\p{S}]', '', 'g')) AS w FROM benchmark))""",
    prelude=False,
)
def _(t):
    quote = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 3, 3), " - ")
    m = t.raw("benchmark").select("item_id", T.match_run(F.col("text"), quote).alias("r"))
    return m.select("item_id", "r.start", "r.end")


@query("x24_bare_word", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'ك' || p_name ELSE p_name END AS bare FROM part", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", T.bare_word(F.concat(F.expr("elt(CAST(p_partkey % 6 + 1 AS INT), '', 'و', 'ال', 'وال', 'وبال', 'ك')"), "p_name")).alias("bare"))


@query("c14_term_pairs", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 OR p_partkey % 5 < 2 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS n FROM part", prelude=False)
def _(t):
    """Lists of 0 to 4 whole pairs and one with an empty side, under two names that are known and one that isn't."""
    spec = F.expr("""concat('{"', elt(CAST(p_partkey % 3 + 1 AS INT), 'pairs', 'items', 'others'), '": [', repeat(IF(p_partkey % 2 = 0, '{"term": "a", "definition": "b"},', '{"left": "a", "right": "b"},'), CAST(p_partkey % 5 AS INT)), '{"term": " ", "definition": "x"}]}')""")
    p = G.term_pairs(spec)
    return t.raw("part").select("p_partkey", F.when(p.isNotNull(), F.size(p)).alias("n"))


@query("c15_numbers", "SELECT p_partkey, CAST(p_size AS DOUBLE) * sqrt(3.0) AS root, CASE WHEN m <= 1 THEN p WHEN m <= 2 THEN 2 * p WHEN m <= 5 THEN 5 * p ELSE 10 * p END AS step FROM (SELECT *, p_retailprice / 5 / p AS m FROM (SELECT *, pow(10.0, floor(log10(p_retailprice / 5))) AS p FROM part))", prelude=False)
def _(t):
    return t.raw("part").select("p_partkey", N.root_number(F.concat(F.col("p_size").cast("string"), F.lit("√3"))).alias("root"), N.nice_step(F.col("p_retailprice")).alias("step"))


# --- grammar slots -------------------------------------------------------------------------------


def nth(k: int, n: int, *values: str) -> str:
    """SQL that both engines read: one of ``values`` by the digit ``k`` of the row's number to base ``n``."""
    return f"CASE (p_partkey // {k}) % {n} " + " ".join(f"WHEN {i} THEN '{v}'" if v is not None else f"WHEN {i} THEN NULL" for i, v in enumerate(values)) + " END"


def spark_nth(k: int, n: int, *values: str):
    return F.expr(nth(k, n, *values).replace("//", "div"))


STATES, SIGNS, KINDS = ("منصوب", "مرفوع", "مجرور", "مجزوم"), ("الفتحة", "الضمة", "الكسرة", "الياء"), ("ظاهرة", "مقدرة", "نائبة عن الفتحة", None)


@query("n6_parse_phrase", f"SELECT p_partkey, {nth(1, 4, *STATES)} AS state, CASE WHEN p_partkey % 5 = 0 THEN 'في محل نصب' END AS position, {nth(4, 4, *SIGNS)} AS sign, {nth(16, 4, *KINDS)} AS sign_kind FROM part", prelude=False)
def _(t):
    words = [spark_nth(1, 4, *STATES), F.lit("وعلامته"), F.concat(spark_nth(4, 4, *SIGNS), F.lit("،")), spark_nth(16, 4, "الظاهرة", "المقدّرة", "نيابة عن الفتحة", None), F.when(F.col("p_partkey") % 5 == 0, "في محلّ نصب")]
    keys = t.raw("part").select("p_partkey").repartition(t.spark.sparkContext.defaultParallelism)  # a phrase costs far more than its key, and a file of keys is few tasks
    return keys.select("p_partkey", G.parse_phrase(F.concat_ws(" ", *words)).alias("p")).select("p_partkey", "p.*")


NOUNS = ("مفرد", "جمع مؤنث سالم", "مثنى", "جمع مذكر سالم")
ROLES = ("منادى علم مفرد", "منادى مضاف", "منادى نكرة مقصودة", "فاعل")


@query(
    "n8_rule_table",
    f"""SELECT p_partkey AS id, coalesce(state = CASE WHEN built THEN 'مبني' ELSE 'منصوب' END AND CASE WHEN sign = 'الضم' THEN 'الضمة' ELSE sign END = CASE WHEN expected = 'الضم' THEN 'الضمة' ELSE expected END, FALSE) AS ok, expected
    FROM (SELECT *, CASE WHEN built THEN CASE noun WHEN 'مثنى' THEN 'الألف' WHEN 'جمع مذكر سالم' THEN 'الواو' ELSE 'الضم' END ELSE CASE noun WHEN 'مفرد' THEN 'الفتحة' WHEN 'جمع مؤنث سالم' THEN 'الكسرة' ELSE 'الياء' END END AS expected
    FROM (SELECT *, state = 'مبني' OR role != 'منادى مضاف' AS built FROM (SELECT p_partkey, {nth(1, 4, *ROLES)} AS role, {nth(4, 2, "مبني", "منصوب")} AS state, {nth(8, 4, *NOUNS)} AS noun, {nth(32, 4, "الضمة", "الفتحة", "الياء", "الكسرة")} AS sign FROM part)) WHERE role != 'فاعل')""",
    prelude=False,
)
def _(t):
    answers = t.raw("part").select(F.col("p_partkey").alias("id"), spark_nth(1, 4, *ROLES).alias("role"), spark_nth(4, 2, "مبني", "منصوب").alias("state"), spark_nth(8, 4, *NOUNS).alias("noun_type"), spark_nth(32, 4, "الضمة", "الفتحة", "الياء", "الكسرة").alias("sign"))
    return G.check_rules(answers, G.rule_table(t.spark))


KEY = {"word": (1, 3, "w", "w", None), "role": (3, 3, "r", " ", "r"), "state": (9, 3, "منصوب", "مبني", None), "position": (27, 2, "p", None), "sign": (54, 2, "الفتحة", None), "sign_kind": (108, 3, None, "—", "k"), "rule_ref": (324, 2, "gc:a", "x")}


@query(
    "n9_key_errors",
    f"""SELECT p_partkey, concat_ws(',', CASE WHEN word IS NULL THEN 'no word' END, CASE WHEN role = ' ' THEN 'no role' END, CASE WHEN state IS NULL THEN 'no state' END, CASE WHEN state = 'مبني' AND position IS NULL THEN 'built without position' END, CASE WHEN state = 'مبني' AND sign_kind = 'k' THEN 'built with a kind of sign' END,
    CASE WHEN state = 'منصوب' AND position IS NOT NULL THEN 'declined with position' END, CASE WHEN state = 'منصوب' AND sign IS NULL THEN 'declined without sign' END, CASE WHEN rule_ref = 'x' THEN 'no rule' END) AS errors FROM (SELECT p_partkey, {", ".join(f"{nth(*v)} AS {k}" for k, v in KEY.items())} FROM part)""",
    prelude=False,
)
def _(t):
    key = F.struct(*[spark_nth(*v).cast("string").alias(k) for k, v in KEY.items()])
    return t.raw("part").select("p_partkey", F.array_join(G.key_errors(key), ",").alias("errors"))


@query("n10_diagnosis", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'role: subject, not object' WHEN (p_partkey // 2) % 2 = 1 THEN 'state: raised, not held' WHEN (p_partkey // 4) % 3 > 0 THEN 'sign: damma, not ' || {nth(4, 3, 'damma', 'fatha', 'kasra')} END AS line FROM part", prelude=False)
def _(t):
    none = F.lit(None).cast("string")
    slots = lambda role, state, sign: F.struct(role.alias("role"), state.alias("state"), sign.alias("sign"), none.alias("position"), none.alias("kind"))
    d = t.raw("part").withColumns({"s": slots(spark_nth(1, 2, "subject", "object"), spark_nth(2, 2, "raised", "held"), spark_nth(4, 3, "damma", "fatha", "kasra")), "k": slots(F.lit("subject"), F.lit("raised"), F.lit("damma"))})
    return d.withColumn("g", N.grade_slots(F.col("s"), F.col("k"))).select("p_partkey", G.diagnosis(F.col("g"), F.col("s"), F.col("k")).alias("line"))


@query("n12_readings_agree", "SELECT p_partkey, p_partkey % 2 = 0 AND (p_partkey // 2) % 2 = 0 AND (p_partkey // 4) % 3 = 0 AS agree FROM part", prelude=False)
def _(t):
    """Roles that differ in marks only or at all, states, and signs that agree, differ or aren't known."""
    of = lambda role, state, sign: F.struct(role.alias("role"), state.alias("state"), sign.alias("sign"))
    a = of(spark_nth(1, 2, "فَاعل", "مفعول"), F.lit("مرفوع"), spark_nth(4, 3, "الضمة الظاهرة", "الكسرة نيابة عن الضمة", "?"))
    b = of(F.lit("فاعل"), spark_nth(2, 2, "مرفوع", "منصوب"), spark_nth(4, 3, "الضمة", "الضمة", "?"))
    return t.raw("part").select("p_partkey", G.readings_agree(a, b).alias("agree"))


@query(
    "n14_map_answer",
    f"""SELECT p_partkey, CASE WHEN ok THEN state END AS state, CASE WHEN ok THEN sign END AS sign, CASE WHEN ok THEN CASE WHEN state = 'مبني' THEN '—' ELSE 'ظاهرة' END END AS sign_kind, CASE WHEN ok AND state = 'مبني' THEN 'في محل نصب' END AS position, CASE WHEN ok THEN 'gc:' || rule END AS rule_ref
    FROM (SELECT *, sign != '?' AND rule != 'r9' AND (state != 'مبني' OR role = 'منادى') AS ok FROM (SELECT p_partkey, {nth(1, 2, 'منادى', 'مفعول به')} AS role, {nth(2, 2, 'منصوب', 'مبني')} AS state, {nth(4, 3, 'الفتحة', 'الضم', '?')} AS sign, {nth(12, 3, 'r1', 'r2', 'r9')} AS rule FROM part))""",
    prelude=False,
)
def _(t):
    known = F.create_map(F.lit("r1"), F.lit("gc:r1"), F.lit("r2"), F.lit("gc:r2"))
    role, state, sign = spark_nth(1, 2, "منادى", "مفعول به"), F.concat(spark_nth(2, 2, "منصوب", "مبني"), F.lit("ة")), spark_nth(4, 3, "الفتحة", "الضم", "?")
    m = G.map_answer(F.lit("كتاب"), role, state, sign, F.lit(None).cast("string"), F.concat(spark_nth(12, 3, "r1", "r2", "r9"), F.lit("، r8")), known)
    return t.raw("part").select("p_partkey", m.alias("m")).select("p_partkey", "m.state", "m.sign", "m.sign_kind", "m.position", "m.rule_ref")


# --- gates ---------------------------------------------------------------------------------------


def gate(rule: str, id_: str, table: str, where: str, detail: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT '{rule}' AS rule, CAST({id_} AS VARCHAR) AS id, {detail} AS detail FROM {table} WHERE {where}"


@query("v4_one_source", gate("V4", "n_nationkey", "nation", "(n_nationkey % 3 = 0) = (n_nationkey % 2 = 0)"), prelude=False)
def _(t):
    return gates.one_source(t.raw("nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey % 3 = 0 THEN 'd' END AS source_document", "CASE WHEN n_nationkey % 2 = 0 THEN 'f' END AS source_file"))


@query("v6_answer_shape", gate("V6", "id", "questions", "question_type = 'numeric' AND (status = 'draft' OR source_page % 10 = 1)"))
def _(t):
    q = t.questions.withColumn("answer", F.to_json(F.struct(F.when(F.col("source_page") % 10 == 1, "mcq").otherwise(F.col("question_type")).alias("type"), F.when(F.col("status") != "draft", F.col("correct_answer")).alias("value"))))
    return gates.answer_shape(q, {"numeric": "value"})


@query("v9_lanes", gate("V9", "doc_id", "documents", "CASE WHEN lang = 'en' THEN doc_id % 3 = 0 OR doc_id % 5 = 0 ELSE doc_id % 3 != 0 END"), prelude=False)
def _(t):
    return gates.lane_coherence(t.raw("documents").selectExpr("doc_id AS id", "CASE WHEN lang = 'en' THEN 'verified' ELSE 'authored' END AS fidelity", "CASE WHEN doc_id % 3 = 0 THEN 'authored' ELSE 'scan' END AS capture_lane", "CASE WHEN doc_id % 5 != 0 THEN 'ok' END AS verdict"))


@query("v11_evidence", gate("V11", "n_nationkey", "nation", "(n_nationkey % 2 = 0 AND n_nationkey % 3 = 0) OR (n_nationkey % 2 = 1 AND n_nationkey % 5 = 1)"), prelude=False)
def _(t):
    p = t.raw("nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey % 2 = 0 THEN 'verified' ELSE 'flagged' END AS verdict", "array(named_struct('name', 'a', 'agrees', n_nationkey % 3 != 0), named_struct('name', 'b', 'agrees', true)) AS sources", "CASE WHEN n_nationkey % 5 != 1 THEN 'r' END AS flag_reason")
    return gates.verdict_evidence(p)


@query("v13_halves", gate("V13", "p_partkey", "part", "p_partkey % 9 = 0"), prelude=False)
def _(t):
    return gates.hemistichs(t.raw("part").selectExpr("p_partkey AS id", "p_name AS text", "split(p_name, ' ', 2)[0] AS first_half", "CASE WHEN p_partkey % 9 = 0 THEN 'nope' ELSE split(p_name, ' ', 2)[1] END AS second_half"))


@query("v14_authored", gate("V14", "n_nationkey", "nation", "n_nationkey % 2 = 0 AND n_nationkey % 3 != 0"), prelude=False)
def _(t):
    return gates.authored_only(t.raw("nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey % 2 = 0 THEN 'antonym' ELSE 'plural' END AS relation", "CASE WHEN n_nationkey % 3 = 0 THEN 'authored' ELSE 'printed' END AS origin"))


@query("v15_clauses", "SELECT 'V15' AS rule, 'gr:' || n_regionkey AS id, 'lesson' AS detail FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'V15', 'gr:' || n_regionkey, 'count' FROM nation WHERE n_regionkey = 2 GROUP BY n_regionkey UNION ALL SELECT 'V15', 'x:4', 'prefix'", prelude=False)
def _(t):
    r = t.raw("nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("lesson"))).alias("clauses"), F.collect_list(F.when(F.col("n_nationkey") != 7, F.col("n_nationkey"))).alias("taught_in"), F.count(F.lit(1)).alias("n"))
    return gates.clause_lessons(r.select(F.concat(F.when(F.col("n_regionkey") == 4, "x:").otherwise("gr:"), "n_regionkey").alias("id"), "clauses", "taught_in", F.when(F.col("n_regionkey") == 2, F.col("n") + 1).otherwise(F.col("n")).alias("printed_cases")))


@query("v16_slot_table", gate("V16", "n_nationkey", "nation", "n_regionkey = 4", "'r4/s/t'"), prelude=False)
def _(t):
    keys = t.raw("nation").selectExpr("n_nationkey AS id", "concat('r', n_regionkey) AS role", "'s' AS state", "'t' AS sign")
    return gates.slot_coherence(keys, fixture(t, [(f"r{i}", "s", "t") for i in range(4)], "role string, state string, sign string"))


@query("v17_markers", r"SELECT 'V17' AS rule, CAST(doc_id AS VARCHAR) AS id, concat_ws(',', CASE WHEN a THEN 'at' END, CASE WHEN h THEN 'http' END) AS detail FROM (SELECT doc_id, contains(text, '@') AS a, contains(regexp_replace(text, '[\p{P}\p{S}]', '', 'g'), 'http') AS h FROM documents) WHERE (a OR h) AND doc_id % 2 = 1", prelude=False)
def _(t):
    return gates.escalate_markers(t.raw("documents").selectExpr("doc_id AS id", "text", "doc_id % 2 = 0 AS sensitive"), "text", ["http"], {"at": "@"})


@query("v20_approvals", "SELECT doc_id AS id, doc_id % 3 = 0 AS approved, doc_id % 3 = 1 AS stale, doc_id % 4 = 0 AS flagged FROM documents", prelude=False)
def _(t):
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_sha256"), "doc_id")
    return gates.approval_flags(d.withColumns({"approved_sha256": F.when(F.col("doc_id") % 3 == 0, F.col("text_sha256")).when(F.col("doc_id") % 3 == 1, "old"), "verdict": F.when(F.col("doc_id") % 4 == 0, "flagged").otherwise("verified")}))


@query("v25_containment", f"SELECT 'V25' AS rule, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'violation' ELSE 'info' END AS detail FROM documents WHERE length(text) >= 12 AND doc_id IN ({ORACLES['x15_contaminated']})", prelude=False)
def _(t):
    return gates.containment_sweep(t.raw("documents").selectExpr("doc_id AS id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'authored' ELSE 'printed' END AS class"), t.raw("benchmark"))


@query("v28_inherited", f"SELECT doc_id AS id FROM documents WHERE contains(text, '@') OR doc_id IN ({ORACLES['x15_contaminated']})", prelude=False)
def _(t):
    return gates.inherited_sensitivity(t.raw("documents").selectExpr("doc_id AS id", "text AS stem"), t.raw("benchmark"), [], {"at": "@"})


# --- lifecycle and sinks -------------------------------------------------------------------------


@query("b3_score_lift", "SELECT student_id, lo_id, round(max(score) FILTER (system_to IS NULL) - arg_min(score, n), 9) AS lift FROM mastery WHERE student_id = 1 GROUP BY ALL")
def _(t):
    m = temporal.mastery_history(t.attempts.filter("student_id = 1"), ["student_id", "lo_id"])
    return temporal.baseline_current(m, ["student_id", "lo_id"]).select("student_id", "lo_id", F.round(F.col("current") - F.col("baseline"), 9).alias("lift"))


IN_SCOPE = "lo_id IN (SELECT lo_id FROM lo_keys WHERE c_nationkey = 3)"


@query("b6_dry_run", f"SELECT name, b AS before, b - gone AS after, -gone AS delta FROM (SELECT 'questions' AS name, count(*) AS b, count(*) FILTER ({IN_SCOPE}) AS gone FROM questions UNION ALL SELECT 'visuals', count(*), count(*) FILTER ({IN_SCOPE}) FROM visuals)")
def _(t):
    scope = t.lo_keys.filter("c_nationkey = 3").select("lo_id")
    before = {"questions": t.questions, "visuals": t.visuals}
    return sinks.dry_run(before, {n: df.join(scope, "lo_id", "left_anti") for n, df in before.items()})


@query("b7_full_reload", "SELECT id, kind, label FROM nodes")
def _(t):
    path = f"{sinks.shared_folder(t.spark)}/reload-{uuid.uuid4().hex}"
    sinks.write_snapshot({"nodes": t.nodes.select("id", "kind", "label")}, path)
    return sinks.read_snapshot(t.spark, path)["nodes"]


@query("snk2_new_documents", "SELECT doc_id FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE lang != 'en') WHERE r = 1 AND h NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')", prelude=False)
def _(t):
    d = t.raw("documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return temporal.insert_new(d.filter("lang = 'en'"), d.filter("lang != 'en'"), "sha", "doc_id").select("doc_id")


@query("snk3_deferred_edges", "SELECT id, src_id, dst_id FROM edges WHERE src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes)")
def _(t):
    return sinks.load_edges(t.edges, t.nodes)[0].select("id", "src_id", "dst_id")


def arrive(t, df, name: str, parts: int, order: str, sink) -> str:
    """``df`` comes to ``sink(batch, batch_id, path)`` in ``parts`` micro-batches, by ranges of a column: each part arrives, and the query starts again where it stopped."""
    path = f"{sinks.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    df = graph.cut(df)  # read for the cuts and for each part
    at = F.col(order) if df.schema[order].dataType.typeName() in ("long", "integer") else F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)])).first()[0] or []  # the stand-in for arrival
    part = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(parts):
        df.filter(part == i).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(df.schema).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(lambda batch, n: sink(batch, n, f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/out"


@query("snk6_record_attempts", views.GRADED + "SELECT student_id, lo_id, n, round(score, 9) AS score, attempted_at AS system_from, lead(attempted_at) OVER (PARTITION BY student_id, lo_id ORDER BY n) AS system_to FROM gf")
def _(t):
    return sinks.read_mastery(t.spark, record_all(t)).withColumn("score", F.round("score", 9))


@query("snk6_explanations", views.GRADED + "SELECT id AS attempt_id, question_id, given_answer AS wrong_answer, '**Step 1.** look at ' || question_id || chr(10) || chr(10) || '**Step 2.** compare' AS output_md FROM ga WHERE NOT correct")
def _(t):
    return sinks.read_batches(t.spark, record_all(t), "explanations", sinks.EXPLANATION_LOG).select("attempt_id", "question_id", "wrong_answer", "output_md")


@query("snk6_open_mastery", views.GRADED + "SELECT student_id, lo_id, max(n) AS n, round(arg_max(score, n), 9) AS score FROM gf GROUP BY 1, 2")
def _(t):
    return sinks.read_open_mastery(t.spark, record_all(t)).select("student_id", "lo_id", "n", F.round("score", 9).alias("score"))


def record_all(t) -> str:
    """All attempts through the transactional sink, in three micro-batches."""
    step = lambda i, text: F.struct(F.lit(i).alias("step"), text.alias("text_md"))
    questions = t.questions.withColumn("canonical_solution", F.array(step(1, F.concat(F.lit("look at "), "id")), step(2, F.lit("compare"))))
    questions = graph.cut(questions.filter("status = 'live'"))  # every micro-batch reads them
    return arrive(t, t.attempts.select("id", "student_id", "question_id", "given_answer", "attempted_at"), "snk6", 3, "attempted_at", lambda batch, n, path: sinks.record_attempts(batch, n, questions, path))


@query("snk7_append_ledger", "SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS BIGINT) AS turn_index, CASE WHEN turn % 5 = 0 THEN '[REDACTED]' ELSE text || ' [[lo:' || conv_id || ']]' END AS assistant_message, CASE WHEN turn % 5 = 0 THEN '[]' ELSE '[{\"kind\":\"lo\",\"id\":\"lo:' || conv_id || '\"}]' END AS citations, CASE WHEN turn % 5 = 0 THEN 0.0 ELSE coalesce(cost_usd, 0.0) END AS cost_usd FROM turns WHERE turn % 5 = 0 OR turn % 7 != 0")
def _(t):
    turns = t.turns.select(F.col("conv_id").cast("string").alias("session"), "student_id", "surface", F.col("turn").cast("long").alias("turn_index"), F.lit("hi").alias("user_message"), F.concat("text", F.lit(" [[lo:"), "conv_id", F.lit("]]")).alias("text"), (F.col("turn") % 5 == 0).alias("redacted"), (F.col("turn") % 7 == 0).alias("is_error"), "cost_usd", F.lit(5).cast("long").alias("latency_ms"))
    return sinks.read_batches(t.spark, arrive(t, turns, "snk7", 2, "turn_index", sinks.append_ledger), "ledger", sinks.LEDGER).select("session", "turn_index", "assistant_message", "citations", "cost_usd")


@query("snk7_ledger", "SELECT conv_id, count(*) AS turns, round(sum(coalesce(cost_usd, 0)), 6) AS spent FROM turns GROUP BY 1")
def _(t):
    return t.turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("spent"))


@query("src8_reference_units", "SELECT n_nationkey AS id, array_to_string([r_name, 'unit 2 of ' || r_name], '|') AS units FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 != 0", prelude=False)
def _(t):
    """Reference files written from the regions (two units each), looked up by citations, every third of which goes beyond the end."""
    path = f"{sinks.shared_folder(t.spark)}/references-{uuid.uuid4().hex}"
    unit = lambda n, text: F.struct(F.concat("r_regionkey", F.lit(f":{n}")).alias("key"), text.alias("text"))
    units = t.raw("region").select(F.explode(F.array(unit(1, F.col("r_name")), unit(2, F.concat(F.lit("unit 2 of "), "r_name")))).alias("u"))
    units.agg(F.to_json(F.collect_list("u")).alias("value")).write.text(path)
    cites = t.raw("nation").selectExpr("n_nationkey AS id", "n_regionkey AS book", "1 AS first", "IF(n_nationkey % 3 = 0, 3, 2) AS last")
    return bundles.reference_units(t.spark, path, cites).select("id", F.array_join("units", "|").alias("units"))


@query("v33_coverage_tally", "SELECT 'm:' || n.n_nationkey AS key, count(DISTINCT k.lo_id) AS claims_count, (SELECT count(*) FROM questions q JOIN lo_keys x ON x.lo_id = q.lo_id WHERE x.c_nationkey = n.n_nationkey) AS questions_count, coalesce((SELECT string_agg(lo_id, ',' ORDER BY k) FROM (SELECT lo_id, k FROM lo_keys y WHERE y.c_nationkey = n.n_nationkey ORDER BY k LIMIT 40)), '') AS claim_texts FROM nation n LEFT JOIN lo_keys k ON k.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
def _(t):
    of = F.concat(F.lit("m:"), "c_nationkey").alias("key")
    claims = t.lo_keys.select(of, F.col("k").alias("ord"), F.col("lo_id").alias("text"))
    questions = t.questions.join(t.lo_keys.select("lo_id", of), "lo_id")
    tally = rollup.coverage_tally(t.raw("nation").select(F.concat(F.lit("m:"), "n_nationkey").alias("key")), claims, questions)
    return tally.withColumn("claim_texts", F.array_join("claim_texts", ","))


@query("st8_once", "SELECT DISTINCT user_id, event_type, props FROM events", prelude=False)
def _(t):
    s = stream_of(t, "events").select("user_id", "event_type", "props", F.to_timestamp("ts").alias("at"))
    return run_stream(t, stateful.first_per_key(s, ["user_id", "event_type", "props"], "at", "60 days"), "st8").select("user_id", "event_type", "props")


# --- composite -----------------------------------------------------------------------------------


@query("q1_home_stats", "SELECT 'courses' AS name, count(*) AS n FROM nodes WHERE kind = 'course' UNION ALL SELECT 'learning objectives', count(*) FROM nodes WHERE kind = 'learning_objective' UNION ALL SELECT 'edges', count(*) FROM cur UNION ALL SELECT 'live questions', count(*) FROM questions WHERE status = 'live' UNION ALL SELECT 'visuals', count(*) FROM visuals")
def _(t):
    return views.home_stats(t)


@query("s1_union_recursion", ", reach AS (SELECT id AS root, id FROM nodes WHERE kind = 'course' UNION SELECT r.root, CASE WHEN e.edge_type = 'teaches' THEN e.dst_id ELSE e.src_id END FROM reach r JOIN edges e ON (e.edge_type = 'part_of' AND e.dst_id = r.id) OR (e.edge_type = 'teaches' AND e.src_id = r.id)) SELECT root, id FROM reach")
def _(t):
    """Set semantics: closed edges count too, so an LO can be reached by two modules of one course, and is there once."""
    down = t.edges.filter("edge_type IN ('part_of', 'teaches')").select(F.when(F.col("edge_type") == "teaches", F.col("src_id")).otherwise(F.col("dst_id")).alias("src_id"), F.when(F.col("edge_type") == "teaches", F.col("dst_id")).otherwise(F.col("src_id")).alias("dst_id"))
    return graph.reachable(down, t.nodes.filter("kind = 'course'").selectExpr("id AS root"))


@query("b2_as_of", "SELECT id, src_id, dst_id, edge_type FROM edges WHERE system_from <= TIMESTAMP '2024-01-15' AND (system_to IS NULL OR system_to > TIMESTAMP '2024-01-15')")
def _(t):
    return temporal.as_of(t.edges, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("id", "src_id", "dst_id", "edge_type")


@query("q10_lesson_context", "SELECT 'lo' AS part, n.id || ' | ' || n.label || ' | ' || (SELECT count(*) FROM questions q WHERE q.lo_id = n.id AND q.status = 'live') AS line FROM nodes n WHERE n.id LIKE 'lo:u3-1-%' UNION ALL SELECT 'bridge', this || ' | ' || other FROM (SELECT src_id AS this, dst_id AS other FROM cur WHERE edge_type = 'relates_to' AND src_id LIKE 'lo:u3-1-%' UNION SELECT dst_id, src_id FROM cur WHERE edge_type = 'relates_to' AND dst_id LIKE 'lo:u3-1-%' AND src_id NOT LIKE 'lo:u3-1-%') WHERE other IN (SELECT lo_id FROM node_subject WHERE subject IS NOT NULL)")
def _(t):
    here = t.nodes.filter(F.col("id").startswith("lo:u3-1-")).select("id")
    far = graph.far_ends(t.current.filter("edge_type = 'relates_to'"), here, t.node_subject)
    los = views.lesson_data(t, "u3-1").select(F.lit("lo").alias("part"), F.concat_ws(" | ", "lo_id", "label", F.col("questions").cast("string")).alias("line"))
    return los.unionByName(far.select(F.lit("bridge").alias("part"), F.concat_ws(" | ", "this_id", "other_id").alias("line")))


@query("q14_understanding_check", "SELECT conv_id, turn, CAST(length(text) % 130 AS INT) AS score, 'mastered' AS verdict FROM conversations WHERE length(text) % 130 <= 100", prelude=False)
def _(t):
    from tessera.functions import protocol as P

    reply = F.concat(F.lit('said {"score": '), F.length("text") % 130, F.lit(', "verdict": "mastered"} end'))
    r = t.raw("conversations").select("conv_id", "turn", P.rating(reply).alias("r")).filter("r IS NOT NULL")
    return r.select("conv_id", "turn", "r.score", "r.verdict")


@query("q17_assemble", "SELECT k.lo_id, k.next_lo, coalesce(q.n, 0) AS verified, coalesce(v.n, 0) AS visuals FROM (SELECT lo_id, lead(lo_id) OVER (PARTITION BY c_nationkey ORDER BY k) AS next_lo FROM lo_keys) k LEFT JOIN (SELECT lo_id, count(*) AS n FROM questions WHERE question_type = 'mcq' AND correct_answer IN ('0', '1', '2', '3') GROUP BY 1) q ON q.lo_id = k.lo_id LEFT JOIN (SELECT lo_id, count(*) AS n FROM visuals GROUP BY 1) v ON v.lo_id = k.lo_id")
def _(t):
    """Lessons put together: the chain of LOs, questions whose key resolves, visuals."""
    chain = graph.consecutive_edges(t.lo_keys.selectExpr("c_nationkey AS g", "k AS o", "lo_id AS id"), t.nodes, ["g"], ["o"], "id").selectExpr("src_id AS lo_id", "dst_id AS next_lo")
    choices = F.array(*[F.struct(F.lit(str(i)).alias("key"), F.lit(f"t{i}").alias("text")) for i in range(4)])
    keyed = t.questions.filter("question_type = 'mcq'").filter(N.mcq_key(F.concat("correct_answer", F.lit(". x")), choices).isNotNull())
    n = lambda df, name: rollup.counts_by(df, ["lo_id"], name)
    return t.lo_keys.select("lo_id").join(chain, "lo_id", "left").join(n(keyed, "verified"), "lo_id", "left").join(n(t.visuals, "visuals"), "lo_id", "left").fillna(0, ["verified", "visuals"])
