"""The functions under names that SQL can call: Python ones as they are, column expressions as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import numbers as N
from tessera.functions import protocol as P
from tessera.functions import text as T
from tessera.operators import temporal

PYTHON = {
    "nfc_text": T.nfc_text, "locate_span": T.locate_span, "longest_shared_run": T.longest_shared_run, "words_with_places": T.words_with_places, "stage_vowelled": T.stage_vowelled,
    "fold_for_match": T.fold_for_match, "locate_mark": T.locate_mark, "chat_directives": P.directives, "cut_tail": P.strip_incomplete_tail, "rewrite_refs": P.rewrite_refs,
}
TABLES = {"parse_message": P.ParseMessage, "json_strings": P.JsonStrings}


def _squeezed(body: str) -> str:
    return f"trim(regexp_replace({body}, r'[\\s ]+', ' '))"


def _loose(text: str, gap: str) -> str:
    return f"translate(regexp_replace(regexp_replace({text}, '[{T.MARKS_LOOSE}{T.TATWEEL}{T.ORNATE}]', ''), r'{T.PUNCTUATION}', '{gap}'), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def _wide(dropped: str) -> str:
    return f"translate(regexp_replace(s, '[{T.MARKS_WIDE}{dropped}]', ''), '{T.FOLD6_FROM}', '{T.FOLD6_TO}')"


_WORDS = "array_distinct(filter(split(coalesce({}, ''), r'\\s+'), w -> w != ''))"
_STEP = f"least({temporal.HIGH}D, greatest({temporal.LOW}D, {{old}} + {temporal.RATE}D * ({{outcome}} - {{old}})))"
#: Name: (parameters, type, body). Texts for the folds come composed (``nfc_text``).
SQL = {
    "fold_loose": ("s STRING", "STRING", _squeezed(_loose("s", ""))),
    "fold_words": ("s STRING", "ARRAY<STRING>", f"filter(split({_loose('lower(s)', ' ')}, r'{T.GAP}'), w -> w != '')"),
    "fold_compare": ("s STRING", "STRING", _squeezed(f"""regexp_replace({_wide(T.ANNOTATION + T.TATWEEL + T.INVISIBLE)}, r"{T.ANSWER_PUNCTUATION.replace('"', chr(92) + 'x22')}", ' ')""")),
    "normalize_search": ("s STRING", "STRING", _squeezed(f"lower({_wide(T.TATWEEL)})")),
    "compare_verify": ("s STRING", "STRING", _squeezed(f"regexp_replace(s, '[{T.ANNOTATION}{T.TATWEEL}]', '')")),
    "strip_marks": ("s STRING", "STRING", f"regexp_replace(s, '[{T.MARKS_WIDE}]', '')"),
    "to_arabic_digits": ("s STRING", "STRING", f"translate(s, '{T.WESTERN_DIGITS}', '{T.ARABIC_DIGITS}')"),
    "to_western_digits": ("s STRING", "STRING", f"translate(s, '{T.ARABIC_DIGITS}', '{T.WESTERN_DIGITS}')"),
    "short_name": ("s STRING", "STRING", "get(split(trim(s), r'\\s+'), 0)"),
    "bare_word": ("s STRING", "STRING", "regexp_replace(regexp_replace(regexp_replace(s, '^و', ''), '^[بلك](?=ال)', ''), '^ال', '')"),
    "number_prefix": ("s STRING", "DOUBLE", f"try_cast(regexp_extract(s, r'{N.NUMBER_PREFIX}', 1) AS DOUBLE)"),
    "mcq_match": ("k STRING, s STRING", "BOOLEAN", "coalesce(trim(k) != '' AND trim(s) != '' AND lower(substring(trim(k), 1, 1)) = lower(substring(trim(s), 1, 1)), FALSE)"),
    "slot_compare": ("a STRING, b STRING", "STRING", f"CASE WHEN size(array_except({_WORDS.format('a')}, {_WORDS.format('b')})) = 0 AND size(array_except({_WORDS.format('b')}, {_WORDS.format('a')})) = 0 THEN 'match' WHEN size(array_except({_WORDS.format('a')}, {_WORDS.format('b')})) = 0 OR size(array_except({_WORDS.format('b')}, {_WORDS.format('a')})) = 0 THEN 'variant' ELSE 'conflict' END"),
    "seal_text": ("units ARRAY<STRING>", "STRING", r"sha2(array_join(units, '\n'), 256)"),
    "marker_phrases": ("s STRING, phrases ARRAY<STRING>", "ARRAY<STRING>", f"filter(phrases, p -> contains({_squeezed(_loose('s', ''))}, p))"),
    "first_phrase": ("s STRING, phrases ARRAY<STRUCT<phrase: STRING, value: STRING>>", "STRING", "get(filter(phrases, p -> contains(s, p.phrase)), 0).value"),
    "pick_id": ("raw STRING, known ARRAY<BIGINT>", "BIGINT", "CASE WHEN trim(raw) RLIKE '^[0-9]{1,12}$' AND array_contains(known, try_cast(trim(raw) AS BIGINT)) THEN try_cast(trim(raw) AS BIGINT) WHEN array_contains(known, 1L) THEN 1L ELSE coalesce(array_min(known), 1L) END"),
    "tier_for": ("x DOUBLE", "STRING", "CASE WHEN x < 0.4 THEN 'basic' WHEN x < 0.7 THEN 'standard' ELSE 'advanced' END"),
    "mastery_step": ("old DOUBLE, outcome DOUBLE", "DOUBLE", _STEP.format(old="old", outcome="outcome")),
    "mastery_fold": ("outcomes ARRAY<DOUBLE>", "DOUBLE", f"aggregate(outcomes, {temporal.PRIOR}D, (old, outcome) -> {_STEP.format(old='old', outcome='outcome')})"),
}


def register(spark: SparkSession) -> None:
    """Register all of them for the session."""
    for name, f in PYTHON.items():
        spark.udf.register(name, f)
    for name, f in TABLES.items():
        spark.udtf.register(name, f)
    for name, (parameters, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
