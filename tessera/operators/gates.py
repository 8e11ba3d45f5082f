"""Data-quality gates: each returns the violating rows as (rule, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph


def broken(df: DataFrame, rule: str, bad: Column, id_col: str = "id", detail: Column | None = None) -> DataFrame:
    """Rows for which ``bad`` holds (null counts as fine)."""
    return df.filter(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(id_col).cast("string").alias("id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def unknown_refs(df: DataFrame, rule: str, ref: str, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose reference is set but not among ``known`` (id)."""
    gone = df.filter(F.col(ref).isNotNull()).join(known.select(F.col("id").alias(ref)), ref, "left_anti")
    return gone.select(F.lit(rule).alias("rule"), F.col(id_col).cast("string").alias("id"), F.col(ref).cast("string").alias("detail"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def edge_endpoints(edges: DataFrame, known: DataFrame) -> DataFrame:
    return all_of(unknown_refs(edges, "V1", "src_id", known), unknown_refs(edges, "V1", "dst_id", known))


def question_refs(questions: DataFrame, visuals: DataFrame, known: DataFrame) -> DataFrame:
    return all_of(unknown_refs(questions, "V2", "lo_id", known), unknown_refs(visuals, "V2", "lo_id", known))


def acyclic(prerequisites: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Members of cycles. ``listed`` is (id, ord, pos), the order in which nodes are listed: where each edge leads forward in it there is no cycle, and edges needn't be followed."""
    if listed is not None:
        place = lambda c: listed.select(F.col("id").alias(c), F.struct("ord", "pos").alias(f"_{c}"))
        placed = prerequisites.join(place("src_id"), "src_id", "left").join(place("dst_id"), "dst_id", "left")
        if placed.filter(~F.coalesce(F.col("_src_id") < F.col("_dst_id"), F.lit(False))).isEmpty():
            return prerequisites.sparkSession.createDataFrame([], "rule string, id string, detail string")
    return graph.cycle_members(prerequisites).select(F.lit("V3").alias("rule"), F.col("id").cast("string").alias("id"), F.lit("cycle").alias("detail"))


def one_source(bundles: DataFrame) -> DataFrame:
    return broken(bundles, "V4", F.col("source_document").isNull() == F.col("source_file").isNull())


def choices_and_key(questions: DataFrame) -> DataFrame:
    keyed = F.exists("choices", lambda c: c["key"] == F.col("correct_answer"))
    return broken(questions.filter("question_type = 'mcq'"), "V5", (F.size(F.coalesce("choices", F.expr("CAST(array() AS array<struct<key:string,text:string>>)"))) < 2) | ~F.coalesce(keyed, F.lit(False)))


def answer_shape(questions: DataFrame, needs: dict[str, str]) -> DataFrame:
    """Typed answers: the tag equals the question's type, and the field that the type needs is there."""
    missing = reduce(lambda a, kv: a | ((F.col("question_type") == kv[0]) & F.get_json_object("answer", f"$.{kv[1]}").isNull()), needs.items(), F.lit(False))
    return broken(questions, "V6", (F.get_json_object("answer", "$.type") != F.col("question_type")) | missing)


def known_kind(visuals: DataFrame, kinds: list[str]) -> DataFrame:
    return broken(visuals, "V7", ~F.col("kind").isin(kinds), detail=F.col("kind"))


def seal_holds(passages: DataFrame) -> DataFrame:
    """``units`` is array<struct<n, text>>; the seal is the hash of the ordered texts."""
    texts = F.transform(F.array_sort("units"), lambda u: u["text"])
    approval = F.col("approved_sha256").isNotNull() != (F.col("approved_by").isNotNull() & F.col("approved_at").isNotNull())
    return all_of(broken(passages, "V8", T.seal(texts) != F.col("text_sha256"), detail=F.lit("seal")), broken(passages, "V8", approval, detail=F.lit("approval")))


def lane_coherence(passages: DataFrame) -> DataFrame:
    """A verified text needs a capture lane other than authored, and a verdict."""
    return broken(passages, "V9", F.when(F.col("fidelity") == "verified", (F.col("capture_lane") == "authored") | F.col("verdict").isNull()).otherwise((F.col("fidelity") == "authored") & (F.col("capture_lane") != "authored")))


def contiguous_units(passages: DataFrame) -> DataFrame:
    numbers = F.transform(F.array_sort("units"), lambda u: u["n"])
    return broken(passages, "V10", (F.size("units") > 0) & (numbers != F.sequence(F.lit(1), F.size("units"))))


def verdict_evidence(passages: DataFrame, least: int = 2) -> DataFrame:
    agreeing = F.size(F.array_distinct(F.transform(F.filter("sources", lambda s: s["agrees"]), lambda s: s["name"])))
    return broken(passages, "V11", ((F.col("verdict") == "verified") & (agreeing < least)) | ((F.col("verdict") == "flagged") & F.col("flag_reason").isNull()))


def stored_form(df: DataFrame, column: str) -> DataFrame:
    return broken(df, "V12", T.store_refusal(F.col(column)).isNotNull() | (T.store_form(F.col(column)) != F.col(column)), detail=T.store_refusal(F.col(column)))


def hemistichs(df: DataFrame) -> DataFrame:
    return broken(df, "V13", F.col("first_half").isNotNull() & (F.concat_ws(" ", "first_half", "second_half") != F.col("text")))


def authored_only(items: DataFrame) -> DataFrame:
    return broken(items, "V14", (F.col("relation") == "antonym") & (F.col("origin") != "authored"))


def clause_lessons(rules: DataFrame) -> DataFrame:
    strays = F.filter("clauses", lambda c: ~F.array_contains(F.col("taught_in"), c["lesson"]))
    return all_of(broken(rules, "V15", F.size(strays) > 0, detail=F.lit("lesson")), broken(rules, "V15", F.col("printed_cases").isNotNull() & (F.size("clauses") != F.col("printed_cases")), detail=F.lit("count")), broken(rules, "V15", ~F.col("id").startswith("gr:"), detail=F.lit("prefix")))


def slot_coherence(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Keys (id, role, state, sign) against the rule table (role, state, sign): a pair that the table lacks."""
    return keys.filter("role IS NOT NULL").join(table, ["role", "state", "sign"], "left_anti").select(F.lit("V16").alias("rule"), F.col("id").cast("string").alias("id"), F.concat_ws("/", "role", "state", "sign").alias("detail"))


def escalate_markers(df: DataFrame, column: str, phrases: list[str], ranges: dict[str, str]) -> DataFrame:
    hits = T.marker_hits(F.col(column), phrases, ranges)
    return broken(df, "V17", (F.size(hits) > 0) & ~F.coalesce(F.col("sensitive"), F.lit(False)), detail=F.array_join(hits, ","))


def span_slices(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (id, text_id, start, end, expected) out of range or with another slice; unknown texts too."""
    j = spans.join(texts.select(F.col("id").alias("text_id"), "text"), "text_id", "left")
    bad = F.col("text").isNull() | (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end")) | (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("expected"))
    return broken(j, "V18", bad)


def held_back(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, reason): questions of a sealed class, or bound to a sacred or an unapproved passage; the first reason counts."""
    p = passages.select(F.col("id").alias("passage_id"), F.col("sacred").alias("_s"), F.col("approved_by").alias("_a"), F.lit(True).alias("_p"))
    j = questions.join(p, "passage_id", "left")
    reason = F.when(F.col("sensitivity") == "sealed", "sealed class").when(F.coalesce("_s", F.lit(False)), "sacred passage").when(F.col("_p") & F.col("_a").isNull(), "unapproved passage")
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select("id", "reason")


def approval_flags(passages: DataFrame) -> DataFrame:
    """Derived flags: approved (for this very text), stale (for an earlier one), flagged."""
    has = F.col("approved_sha256").isNotNull()
    return passages.select("id", (has & (F.col("approved_sha256") == F.col("text_sha256"))).alias("approved"), (has & (F.col("approved_sha256") != F.col("text_sha256"))).alias("stale"), (F.col("verdict") == "flagged").alias("flagged"))


def resolve_sources(bundles: DataFrame, known: DataFrame, group: str, order: str) -> DataFrame:
    """Source of each bundle: declared, else known by its file, else that of the bundle before it, else the first one after."""
    j = bundles.join(known.select(F.col("path").alias("source_file"), F.col("sha256").alias("_k")), "source_file", "left")
    own = F.coalesce("sha256", "_k")
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    j = j.withColumn("_o", own)
    return j.withColumn("resolved", F.coalesce(F.last("_o", ignorenulls=True).over(before), F.first("_o", ignorenulls=True).over(after))).drop("_o", "_k")


def preflight(course: DataFrame, batch: DataFrame, current: DataFrame, subtree: DataFrame, externals: DataFrame) -> DataFrame:
    """Scoped load: ids of the batch that exist outside of the scope, and external references that nothing resolves."""
    clash = batch.select("id").join(current.select("id"), "id", "left_semi").join(subtree.select("id"), "id", "left_anti")
    lost = externals.select("id").join(current.select("id"), "id", "left_anti").join(batch.select("id"), "id", "left_anti")
    absent = course.select("id").join(current.select("id"), "id", "left_anti")
    name = lambda df, d: df.select(F.lit("V22").alias("rule"), "id", F.lit(d).alias("detail"))
    return all_of(name(absent, "no such course"), name(clash, "collision"), name(lost, "unresolved"))


def variant_refusal(questions: DataFrame) -> DataFrame:
    """(id, refusal): the first of four gates that forbids variants of a question."""
    gate = F.coalesce(F.when(F.col("status") != "live", "not live"), F.when(F.col("sensitivity") == "sealed", "sealed"), F.when(F.col("passage_id").isNotNull(), "bound to a passage"), F.when(~F.col("question_type").isin("mcq", "numeric"), "type"))
    return questions.select("id", gate.alias("refusal"))


def privacy(students: DataFrame) -> DataFrame:
    return broken(students, "V24", ~F.col("display_name").like("%(demo)%"))


def containment_sweep(strings: DataFrame, corpus: DataFrame, least_chars: int = 12, n: int = 4) -> DataFrame:
    """Strings (id, text, class) of some length that share a run of n words with the corpus (text): info for allowed classes, else a violation."""
    long = strings.filter(F.length("text") >= least_chars)
    hit = T.contaminated(long, corpus, "id", "text", "text", n)
    return long.join(hit, "id", "left_semi").select(F.lit("V25").alias("rule"), F.col("id").cast("string").alias("id"), F.when(F.col("class") == "authored", "violation").otherwise("info").alias("detail"))


def full_audit(strings: DataFrame, sealed: DataFrame, passages: DataFrame, edges: DataFrame, nodes: DataFrame, own: str | None = None, least_chars: int = 12, n: int = 4, allowed: tuple[str, ...] = ("sealed",)) -> DataFrame:
    """(level, rule, id, detail) of a deterministic audit; a release goes out if no level is ``violation``.

    Containment (V25): strings (id, text, class) that quote n words or more of a sealed text (passage_id, text), with the longest such run;
    ``own`` names a column of both that exempts a passage from itself. Verification (V26): sealed passages (id, verdict, flag_reason) that don't
    agree with their sources, and the tallies. Graph (G11): edges with an end that isn't there.
    """
    hit = T.contaminated(strings.filter(F.length("text") >= least_chars), sealed, "id", "text", "text", n)
    quoting = strings.filter(F.length("text") >= least_chars).join(hit, "id", "left_semi")
    runs = T.shared_runs(quoting, sealed, "id", "passage_id", "text", n)
    told = runs.join(strings.select("id", "class", *([F.col(own).alias("_a")] if own else [])), "id").join(sealed.select("passage_id", *([F.col(own).alias("_b")] if own else [])), "passage_id")
    if own:
        told = told.filter(~F.col("_a").eqNullSafe(F.col("_b")))
    row = lambda df, level, rule, id_, detail: df.select(level.alias("level"), F.lit(rule).alias("rule"), id_.cast("string").alias("id"), detail.cast("string").alias("detail"))
    quote = F.concat(F.col("length"), F.lit(" words of "), F.col("passage_id"), F.lit(": "), F.substring("run", 1, 60))
    fine = F.col("verdict") == "agree"
    flagged = passages.filter(~F.coalesce(fine, F.lit(False)))
    tallies = passages.agg(F.count_if(fine).alias("agree"), (F.count(F.lit(1)) - F.count_if(fine)).alias("flagged"))
    return all_of(
        row(told, F.when(F.col("class").isin(*allowed), "info").otherwise("violation"), "V25", F.col("id"), quote),
        row(flagged, F.lit("info"), "V26", F.col("id"), F.coalesce("flag_reason", F.lit("no verification record"))),
        *[row(tallies, F.lit("count"), "V26", F.lit(c), F.col(c)) for c in ("agree", "flagged")],
        row(graph.dangling(edges, nodes), F.lit("violation"), "G11", F.concat_ws(" > ", "src_id", "dst_id"), F.col("edge_type")),
    )


def verification_ledger(passages: DataFrame) -> DataFrame:
    return passages.groupBy("verdict", "fidelity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("approved_by").isNotNull()).alias("approved"))


def crosscheck(basis: DataFrame, sources: DataFrame) -> DataFrame:
    """Ordered verses of authorities (passage_id, name, n, text) against the basis (passage_id, n, text): per source, agreement and differing places; verdict by two agreeing sources."""
    a = basis.select("passage_id", "n", T.compare_verify(F.col("text")).alias("_a"))
    names = sources.select("passage_id", "name").distinct()
    b = sources.select("passage_id", "name", "n", T.compare_verify(F.col("text")).alias("_b"))
    j = a.join(names, "passage_id").join(b, ["passage_id", "name", "n"], "full")
    per = j.groupBy("passage_id", "name").agg(F.array_sort(F.collect_list(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("n")))).alias("differences"))
    return per.groupBy("passage_id").agg(F.when(F.count_if(F.size("differences") == 0) >= 2, "verified").otherwise("flagged").alias("verdict"), F.array_sort(F.collect_list(F.struct("name", (F.size("differences") == 0).alias("agrees"), "differences"))).alias("sources"))


def inherited_sensitivity(questions: DataFrame, corpus: DataFrame, phrases: list[str], ranges: dict[str, str]) -> DataFrame:
    """Ids of questions that quote the corpus or carry markers."""
    quoted = T.contaminated(questions, corpus, "id", "stem", "text")
    marked = questions.filter(F.size(T.marker_hits(F.col("stem"), phrases, ranges)) > 0).select("id")
    return quoted.union(marked).distinct()


def drop_claims(questions: DataFrame, bad: DataFrame) -> DataFrame:
    """Questions (id, claims) without their bad claims; a question goes only if it has claims and all of them are bad."""
    lists = bad.groupBy("id").agg(F.collect_set("claim").alias("_bad"))
    j = questions.join(lists, "id", "left").withColumn("_bad", F.coalesce("_bad", F.expr("CAST(array() AS array<string>)")))
    all_bad = (F.size("claims") > 0) & (F.size(F.array_except("claims", "_bad")) == 0)
    return j.filter(~all_bad).withColumn("claims", F.filter("claims", lambda c: ~F.array_contains(F.col("_bad"), c))).drop("_bad")


def fact_conflicts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def in_domain(df: DataFrame, column: str, allowed: list[str], id_col: str = "id") -> DataFrame:
    return broken(df, "V31", ~F.col(column).isin(allowed), id_col, F.col(column))


def in_range(df: DataFrame, column: str, low: float, high: float, id_col: str = "id") -> DataFrame:
    return broken(df, "V31", (F.col(column) < low) | (F.col(column) > high), id_col, F.col(column))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Listings (name, sha256): added, removed or changed names."""
    j = before.select("name", F.col("sha256").alias("_b")).join(after.select("name", F.col("sha256").alias("_a")), "name", "full")
    return j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("name", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed").alias("change"))


def request_limits(df: DataFrame) -> DataFrame:
    return all_of(broken(df, "V34", ~F.length(F.trim("name")).between(2, 40), detail=F.lit("name")), broken(df, "V34", F.size("ids") > 120, detail=F.lit("ids")), broken(df, "V34", F.length("text") > 1200, detail=F.lit("text")))
