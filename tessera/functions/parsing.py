"""Closed lexicon of case grammar: phrases to slots, rule table, key checks, agreement of two readings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: The lexicon, folded as ``fold_compare`` folds.
STATES = ["منصوب", "مرفوع", "مجرور", "مجزوم", "مبني"]
POSITIONS = ["رفع", "نصب", "جر", "جزم"]
SIGN_WORDS = {"ضمه": "الضمة", "ضم": "الضم", "فتحه": "الفتحة", "فتح": "الفتحة", "كسره": "الكسرة", "كسر": "الكسرة", "الف": "الألف", "واو": "الواو", "ياء": "الياء", "سكون": "السكون"}
SIGN_PHRASES = {"حذف حرف العله": "حذف حرف العلة", "حذف النون": "حذف النون", "تنوين الفتح": "تنوين الفتح", "تنوين الضم": "تنوين الضم", "تنوين الكسر": "تنوين الكسر"}
KIND_PHRASES = {"نائبه عن الفتحه": "نائبة عن الفتحة", "نيابه عن الفتحه": "نائبة عن الفتحة", "نائبه عن الضمه": "نائبة عن الضمة", "نيابه عن الضمه": "نائبة عن الضمة", "نائبه عن الكسره": "نائبة عن الكسرة", "نيابه عن الكسره": "نائبة عن الكسرة"}
KIND_WORDS = {"ظاهره": "ظاهرة", "مقدره": "مقدرة"}
SIGNS = ["تنوين الفتح", "تنوين الضم", "تنوين الكسر", "حذف حرف العلة", "حذف النون", "الضمة", "الفتحة", "الكسرة", "الألف", "الواو", "الياء", "السكون", "الضم"]
SIGN_KINDS = ["نائبة عن الفتحة", "نائبة عن الضمة", "نائبة عن الكسرة", "مقدرة", "ظاهرة"]
VOCATIVE = "مناد"
BUILT = "مبني"
DECLINED_TYPES = ["مضاف", "شبيه بالمضاف", "نكره غير مقصوده"]
BUILT_TYPES = ["علم مفرد", "نكره مقصوده", "مفرد علم"]
DECLINED_SIGNS = {"مفرد": "الفتحة", "جمع تكسير": "الفتحة", "جمع مؤنث سالم": "الكسرة", "مثنى": "الياء", "جمع مذكر سالم": "الياء", "الأسماء الخمسة": "الألف"}
BUILT_SIGNS = {"مفرد": "الضم", "جمع تكسير": "الضم", "جمع مؤنث سالم": "الضم", "مثنى": "الألف", "جمع مذكر سالم": "الواو"}
SAME_SIGN = ("الضمة", "الضم")


def _lookup(words: Column, values: dict[str, str]) -> Column:
    """Value of the first word that the lexicon has."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.try_element_at(table, F.get(F.filter(words, lambda w: w.isin(*values)), F.lit(0)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_phrase(phrase: Column) -> Column:
    """Struct (state, position, sign, sign_kind) of a phrase; what is not recognised stays null. Longer phrases are taken before single words."""
    listed = lambda c, values: F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in values.items()])
    without = lambda c, values: F.regexp_replace(c, "|".join(values), " ")
    place = rf"محل\s+({'|'.join(POSITIONS)})"

    def slots(kind: Column, sign: Column, rest: Column, words: Column) -> Column:
        position = F.nullif(F.regexp_extract(rest, place, 1), F.lit(""))
        state = F.get(F.filter(words, lambda w: w.isin(*STATES)), F.lit(0))
        return F.struct(state.alias("state"), F.concat(F.lit("في محل "), position).alias("position"), F.coalesce(sign, _lookup(words, SIGN_WORDS)).alias("sign"), F.coalesce(kind, _lookup(words, KIND_WORDS)).alias("sign_kind"))

    words = lambda rest: F.transform(F.filter(F.split(F.regexp_replace(rest, place, " "), r"\s+"), lambda w: w != ""), T.bare_word)
    signed = lambda kind, rest: _once(without(rest, SIGN_PHRASES), lambda left: _once(words(left), lambda w: slots(kind, listed(rest, SIGN_PHRASES), left, w)))
    return _once(T.fold_compare(phrase), lambda whole: _once(without(whole, KIND_PHRASES), lambda rest: signed(listed(whole, KIND_PHRASES), rest)))


def sign_class(sign: Column) -> Column:
    return F.when(sign == SAME_SIGN[1], F.lit(SAME_SIGN[0])).otherwise(sign)


def rule_table(spark: SparkSession) -> DataFrame:
    """(built, noun_type, expected): the sign of a vocative by its kind of noun."""
    return spark.createDataFrame([(built, noun, sign) for built, signs in ((False, DECLINED_SIGNS), (True, BUILT_SIGNS)) for noun, sign in signs.items()], "built boolean, noun_type string, expected string")


def sign_owners(table: DataFrame) -> DataFrame:
    """(built, sign, noun_types): which nouns a sign belongs to."""
    return table.groupBy("built", sign_class(F.col("expected")).alias("sign")).agg(F.array_sort(F.collect_list("noun_type")).alias("noun_types"))


def check_rules(answers: DataFrame, table: DataFrame) -> DataFrame:
    """(id, ok, expected) of answers (id, role, state, sign, noun_type) that the table covers; it says nothing of others."""
    role = T.fold_compare(F.col("role"))
    any_of = lambda names: reduce(lambda a, b: a | b, [F.contains(role, F.lit(n)) for n in names])
    built = (F.col("state") == BUILT) | (any_of(BUILT_TYPES) & ~any_of(DECLINED_TYPES))
    asked = answers.filter(F.contains(role, F.lit(VOCATIVE))).withColumn("built", F.coalesce(built, F.lit(False)))
    right_state = F.col("state") == F.when(F.col("built"), F.lit(BUILT)).otherwise(F.lit(STATES[0]))
    ok = F.coalesce(right_state & (sign_class(F.col("sign")) == sign_class(F.col("expected"))), F.lit(False))
    return asked.join(F.broadcast(table), ["built", "noun_type"]).select("id", ok.alias("ok"), "expected")  # a table of fixed values


def implied_state(role: Column) -> Column:
    r = T.fold_compare(role)
    has = lambda names: reduce(lambda a, b: a | b, [F.contains(r, F.lit(n)) for n in names])
    return F.when(F.contains(r, F.lit("مضاف اليه")), "مجرور").when(~has([VOCATIVE, "اي"]), None).when(has([*BUILT_TYPES, BUILT]), BUILT).when(has([*DECLINED_TYPES, "معرب"]), STATES[0])


def key_errors(key: Column) -> Column:
    """What keeps a key (word, role, state, position, sign, sign_kind, rule_ref) from marking anyone: a list of reasons, empty if it holds."""
    gone = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    built = F.coalesce(key["state"] == BUILT, F.lit(False))
    declined = key["state"].isNotNull() & ~built
    return F.array_compact(F.array(
        F.when(gone(key["word"]), "no word"), F.when(gone(key["role"]), "no role"), F.when(key["state"].isNull(), "no state"),
        F.when(built & gone(key["position"]), "built without position"), F.when(built & ~gone(key["sign_kind"]) & (key["sign_kind"] != "—"), "built with a kind of sign"),
        F.when(declined & ~gone(key["position"]), "declined with position"), F.when(declined & gone(key["sign"]), "declined without sign"),
        F.when(~F.coalesce(key["rule_ref"].startswith("gc:"), F.lit(False)), "no rule"),
    ))


def diagnosis(graded: Column, submission: Column, key: Column) -> Column:
    """One line about the first slot in conflict (in teaching order), or null."""
    slots = [f for f in ("role", "state", "sign", "position", "kind")]
    return F.coalesce(*[F.when(graded["first_conflict"] == s, F.format_string(f"{s}: %s, not %s", key[s], submission[s])) for s in slots])


def readings_agree(a: Column, b: Column) -> Column:
    """Two readings (role, state, sign): equal roles under the loose fold, equal states, and the same known sign."""
    first, second = T.earliest_longest(a["sign"], SIGNS), T.earliest_longest(b["sign"], SIGNS)
    return F.coalesce((T.compare_loose(a["role"]) == T.compare_loose(b["role"])) & (a["state"] == b["state"]) & (first == second), F.lit(False))


def map_answer(word: Column, role: Column, state: Column, sign: Column, kind: Column, rule: Column, known: Column) -> Column:
    """Struct (word, role, state, sign, sign_kind, position, rule_ref) in the closed vocabulary, or null where a slot can't be mapped: nothing is guessed."""
    word, role = T.store_form(word), T.store_form(role)
    state_ = T.first_enum(state, {s: s for s in STATES})
    sign_ = T.earliest_longest(sign, SIGNS)
    kind_ = T.first_enum(F.coalesce(kind, F.lit("ظاهرة")), {k: k for k in SIGN_KINDS}, "ظاهرة")
    ref = F.try_element_at(known, F.get(F.split(F.trim(rule), r"[،,\s]+"), F.lit(0)))
    spelled = F.nullif(F.regexp_extract(F.concat_ws(" ", kind, rule), f"في محل ({'|'.join(POSITIONS)})", 0), F.lit(""))
    position = F.coalesce(spelled, F.when(F.contains(role, F.lit("منادى")), F.lit("في محل نصب")))
    built = state_ == BUILT
    ok = (word != "") & (role != "") & state_.isNotNull() & sign_.isNotNull() & ref.isNotNull() & (~built | position.isNotNull())
    return F.when(ok, F.struct(word.alias("word"), role.alias("role"), state_.alias("state"), sign_.alias("sign"), F.when(built, "—").otherwise(kind_).alias("sign_kind"), F.when(built, position).alias("position"), ref.alias("rule_ref")))


def term_pairs(spec: Column) -> Column:
    """Pairs of a matching exercise with both sides filled; null if under two are."""
    shape = "array<struct<term:string,definition:string,left:string,right:string>>"
    j = F.from_json(spec, f"pairs {shape}, items {shape}")
    rows = F.transform(F.coalesce(j["pairs"], j["items"]), lambda p: F.struct(F.coalesce(p["term"], p["left"]).alias("term"), F.coalesce(p["definition"], p["right"]).alias("definition")))
    full = F.filter(rows, lambda p: (F.trim(p["term"]) != "") & (F.trim(p["definition"]) != ""))
    return F.when(F.size(full) >= 2, full)
