"""Normal forms, spans, shingles and hashes of text with combining marks.

Five folds look alike and are not: each says what it drops, what it folds and whether punctuation
separates words. Unicode composition (NFC) needs Python; all else is column expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tessera.operators import graph

#: Ranges of code points that the forms name.
MARKS_LOOSE = "ً-ٰٖۖ-ۭ"  # vowel marks and annotation signs
MARKS_WIDE = "ً-ٰٟ"  # vowel marks, the wider range
ANNOTATION = "ۖ-ۭ"
TATWEEL = "ـ"
ORNATE = "﴾﴿"
INVISIBLE = "​-‏؜﻿"
PRESENTATION = "ﭐ-﷿ﹰ-ﻼ"
PRESENTATION_KEPT = "﴾﴿ﷺ"
FOREIGN_LETTERS = "یکہھ"
FOREIGN_DIGITS = "۰-۹"
WESTERN_DIGITS, ARABIC_DIGITS = "0123456789", "٠١٢٣٤٥٦٧٨٩"
PUNCTUATION = r"[\p{P}\p{S}]"
ANSWER_PUNCTUATION = r"""[.,؛،؟!:"'«»()\[\]{}…—–-]"""
#: Blanks between words: separators of any kind, controls that break lines, the byte order mark.
CONTROL_GAPS = "\t\n\x0b\x0c\r\ufeff"
GAP = r"[\t\n\x0B\f\r\p{Z}\uFEFF]+"
FOLD_FROM, FOLD_TO = "أإآٱىةؤئ", "اااايهوي"
FOLD6_FROM, FOLD6_TO = FOLD_FROM[:6], FOLD_TO[:6]
#: Characters of a piece of an Arrow batch.
SLICE_CHARS = 1 << 20


@F.pandas_udf(StringType())
def nfc_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """Composed form; texts of ASCII alone don't leave the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(nfc_text(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def store_refusal(c: Column) -> Column:
    """Why a text can't be stored, or null: the first of joiners, presentation forms, foreign letters, foreign digits."""
    odd = F.regexp_replace(c, f"[{PRESENTATION_KEPT}]", "")
    return (
        F.when(c.rlike("[‌‍]"), "joiner").when(odd.rlike(f"[{PRESENTATION}]"), "presentation form")
        .when(c.rlike(f"[{FOREIGN_LETTERS}]"), "foreign letter").when(c.rlike(f"[{FOREIGN_DIGITS}]"), "foreign digit")
    )


def store_form(c: Column) -> Column:
    """Composed, invisibles dropped, tatweel dropped unless it carries a mark, white space squeezed; null if refused."""
    kept = F.regexp_replace(nfc(c), f"[{INVISIBLE}]", "")
    plain = squeeze(F.regexp_replace(kept, f"{TATWEEL}(?![{MARKS_WIDE}{ANNOTATION}])", ""))
    return F.when(store_refusal(c).isNull(), plain)


def compare_verify(c: Column) -> Column:
    """Composed, without annotation signs and tatweel."""
    return squeeze(F.regexp_replace(nfc(c), f"[{ANNOTATION}{TATWEEL}]", ""))


def fold_loose(c: Column) -> Column:
    """On composed text: without marks, letters folded, punctuation deleted (words on both sides of it join)."""
    bare = F.regexp_replace(c, f"[{MARKS_LOOSE}{TATWEEL}{ORNATE}]", "")
    return squeeze(F.translate(F.regexp_replace(bare, PUNCTUATION, ""), FOLD_FROM, FOLD_TO))


def compare_loose(c: Column) -> Column:
    return fold_loose(nfc(c))


def fold_words(c: Column) -> Column:
    """Words for containment checks: the loose fold in lower case, but punctuation separates words."""
    bare = F.regexp_replace(F.lower(c), f"[{MARKS_LOOSE}{TATWEEL}{ORNATE}]", "")
    return F.filter(F.split(F.translate(F.regexp_replace(bare, PUNCTUATION, " "), FOLD_FROM, FOLD_TO), GAP), lambda w: w != "")


def fold_compare(c: Column) -> Column:
    """For answers, on composed text: wider mark range, invisibles dropped, only alef, yeh and teh folded, the listed punctuation to a space."""
    bare = F.regexp_replace(nfc(c), f"[{MARKS_WIDE}{ANNOTATION}{TATWEEL}{INVISIBLE}]", "")
    return squeeze(F.regexp_replace(F.translate(bare, FOLD6_FROM, FOLD6_TO), ANSWER_PUNCTUATION, " "))


def normalize_search(c: Column) -> Column:
    """For search boxes: wider mark range, annotation kept, lower case."""
    return squeeze(F.lower(F.translate(F.regexp_replace(c, f"[{MARKS_WIDE}{TATWEEL}]", ""), FOLD6_FROM, FOLD6_TO)))


def is_vowelled(c: Column, least: float = 0.2) -> Column:
    marks = F.length(F.regexp_replace(c, f"[^{MARKS_WIDE}]", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.coalesce(marks / F.nullif(letters, F.lit(0)) >= least, F.lit(False))


def to_arabic_digits(c: Column) -> Column:
    return F.translate(c, WESTERN_DIGITS, ARABIC_DIGITS)


def to_western_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, WESTERN_DIGITS)


def seal(units: Column) -> Column:
    """Content address of an ordered list of units in their stored form."""
    return F.sha2(F.array_join(units, "\n"), 256)


def source_address(sha: Column, known: Column, title: Column, path: Column) -> Column:
    """The file's own hash, else the one known for its path, else a mark with 32 hex digits of the title and path."""
    return F.coalesce(sha, known, F.concat(F.lit("unavailable:"), F.substring(F.sha2(F.concat_ws("|", title, path), 256), 1, 32)))


_FOLDS = {**{i: None for a, b in ((0x64B, 0x65F), (0x670, 0x670), (0x640, 0x640)) for i in range(a, b + 1)}, **str.maketrans(FOLD6_FROM, FOLD6_TO), ord("Σ"): "σ"}
_GONE = np.array([i for i, to in _FOLDS.items() if to is None], "<u4")


def _folded_with_places(text: str) -> tuple[str, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(~np.isin(points, _GONE)).astype("int32")
    # by itself each sign lowers to one, but for the capital i with a dot; a capital sigma at a word's end would depend on what is before it
    return text.translate(_FOLDS).lower(), np.repeat(at, np.where(points[at] == 0x130, 2, 1))


def _locate(text: str | None, find: str | None, nth: int, whole: bool) -> tuple[int, int] | None:
    if not text or not find:
        return None
    folded, at = _folded_with_places(text)
    needle = _folded_with_places(find)[0].strip()
    if not needle:
        return None
    start, seen = 0, 0
    while (i := folded.find(needle, start)) >= 0:
        end = i + len(needle)
        alone = not whole or ((i == 0 or not folded[i - 1].isalnum()) and (end == len(folded) or not folded[end].isalnum()))
        if alone:
            seen += 1
            if seen == nth:
                last = int(at[end - 1]) + 1
                while last < len(text) and (0x64B <= ord(text[last]) <= 0x65F or ord(text[last]) == 0x670):
                    last += 1
                return int(at[i]), last
        start = i + 1
    return None


@F.pandas_udf(StructType().add("start", IntegerType()).add("end", IntegerType()))
def locate_span(text: pd.Series, find: pd.Series, nth: pd.Series, whole: pd.Series) -> pd.DataFrame:
    """Half-open place, in the original, of the nth folded occurrence, marks behind it included; nulls if there is none."""
    got = [_locate(*row) or (None, None) for row in zip(text, find, nth, whole, strict=True)]
    return pd.DataFrame(got, columns=["start", "end"]).astype("Int32")


@F.pandas_udf(StructType().add("length", IntegerType()).add("run", StringType()))
def longest_shared_run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Longest run of words that both texts have, and the first such run of ``a``: an exact DP for pairs that a join has picked."""

    def one(x: str | None, y: str | None) -> tuple[int, str]:
        p, q = (x or "").split(), (y or "").split()
        best, end, row = 0, 0, [0] * (len(q) + 1)
        for i, w in enumerate(p, 1):
            new = [0] * (len(q) + 1)
            for j, v in enumerate(q, 1):
                if w == v:
                    new[j] = row[j - 1] + 1
                    if new[j] > best:
                        best, end = new[j], i
            row = new
        return best, " ".join(p[end - best : end])

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["length", "run"]).astype({"length": "int32"})


def _runs(words: Column, n: int, of: Callable[[list[Column]], Column]) -> Column:
    """``of`` of every ``n`` neighbouring words; null where there are fewer.

    A filter by size, or one that Spark derives from ``explode``, would go below the column of words and fold every text a second time:
    the nulls go through ``explode_outer`` and are filtered behind it.
    """
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: of([F.get(words, i + k) for k in range(n)])))


def word_shingles(df: DataFrame, words: Column, keep: list[str], n: int = 4) -> DataFrame:
    """One row for each distinct n-word shingle of each row (as its words)."""
    w = df.select(*keep, words.alias("_w"))
    joined = _runs(F.col("_w"), n, lambda run: F.concat_ws(" ", *run))
    return w.select(*keep, F.explode_outer(F.array_distinct(joined)).alias("shingle")).filter("shingle IS NOT NULL")


def shared_runs(docs: DataFrame, corpus: DataFrame, doc_id: str, item_id: str, text: str = "text", n: int = 4) -> DataFrame:
    """(doc_id, item_id, length, run): the longest run of n words or more that a document shares with an item, the first such run of the document.

    Shingles with their places meet by equi join. Matches that follow each other in both texts lie on one diagonal (place minus place) next
    to each other: islands along a diagonal are the runs, so no pair of texts is ever aligned.
    """
    joined = _runs(F.col("_w"), n, lambda run: F.concat_ws(" ", *run))
    placed = lambda df, key, at: df.select(key, fold_words(F.col(text)).alias("_w")).select(key, F.posexplode_outer(joined).alias(at, "_s")).filter("_s IS NOT NULL")
    met = placed(docs, doc_id, "_i").join(placed(corpus, item_id, "_j"), "_s").select(doc_id, item_id, "_i", (F.col("_i") - F.col("_j")).alias("_d"))
    along = Window.partitionBy(doc_id, item_id, "_d").orderBy("_i")
    islands = met.withColumn("_g", F.col("_i") - F.row_number().over(along)).groupBy(doc_id, item_id, "_d", "_g").agg(F.min("_i").alias("_from"), F.count(F.lit(1)).alias("_n"))
    best = islands.groupBy(doc_id, item_id).agg(F.max(F.struct("_n", (-F.col("_from")).alias("_from"))).alias("_b")).select(doc_id, item_id, (F.col("_b._n") + n - 1).cast("int").alias("length"), (1 - F.col("_b._from")).cast("int").alias("_from"))
    words = docs.select(doc_id, fold_words(F.col(text)).alias("_w"))
    return best.join(words, doc_id).select(doc_id, item_id, "length", F.array_join(F.slice("_w", F.col("_from"), F.col("length")), " ").alias("run"))


def contaminated(docs: DataFrame, corpus: DataFrame, doc_id: str, text: str, corpus_text: str, n: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Ids of documents that share an n-word shingle with the corpus.

    Shingles meet as hashes of word lists first, so no text of a shingle is built for documents that share none; what
    is left is compared word by word. The corpus side is broadcast only while it is short.
    """
    held = graph.cut(word_shingles(corpus, fold_words(F.col(corpus_text)), [], n).distinct())
    short = held.count() <= broadcast_rows
    near = lambda df: F.broadcast(df) if short else df
    words = docs.select(doc_id, fold_words(F.col(text)).alias("_w"))
    hashes = words.select(doc_id, F.explode_outer(F.array_distinct(_runs(F.col("_w"), n, lambda run: F.xxhash64(*run)))).alias("_h")).filter("_h IS NOT NULL")
    suspects = hashes.join(near(held.select(F.xxhash64(F.split("shingle", " ")).alias("_h")).distinct()), "_h", "left_semi").select(doc_id).distinct()
    mine = word_shingles(docs.join(suspects, doc_id, "left_semi"), fold_words(F.col(text)), [doc_id], n)
    return mine.join(near(held), "shingle", "left_semi").select(doc_id).distinct()


def marker_hits(c: Column, phrases: list[str], ranges: dict[str, str]) -> Column:
    """Names of the code point ranges and phrases (under the loose fold) that a text holds."""
    by_range = [F.when(c.rlike(f"[{r}]"), F.lit(name)) for name, r in ranges.items()]
    folded = fold_loose(c)
    by_phrase = [F.when(F.contains(folded, F.lit(p)), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*by_range, *by_phrase))


#: What is said for the formulas of lessons, in order, and signs that are not spoken.
MATH_WORDS = (
    (r"\\times", " times "), (r"\\Rightarrow", " therefore "), (r"\\neq?", " is not equal to "), (r"n\\?\(\s*([A-Za-z])\s*\\?\)", " n of $1 "), (r"\\[{}]", " "),
    (r"[{}]", " "), (r"\\[a-zA-Z]+", " "), (r"\^\s*2", " squared "), (r"=", " equals "),
)
SILENT = "•▲▼✓✗✦⚡"


def math_words(c: Column) -> Column:
    """A formula as it is spoken."""
    for pattern, words in MATH_WORDS:
        c = F.regexp_replace(c, pattern, words)
    return squeeze(c)


def sanitize_speech(c: Column, keep_arabic: bool = True) -> Column:
    """Text to be spoken: directives and citations out, formulas between dollars in words, bold marks and silent signs out; for a voice without Arabic its letters too."""
    c = F.regexp_replace(F.regexp_replace(c, r"\{\{[^}]*\}\}+", " "), r"\[\[[^\]]*\]\]", " ")
    formula = r"\$([^$]+)\$"
    said = F.transform(F.regexp_extract_all(c, F.lit(formula), F.lit(1)), lambda m: F.concat(F.lit(" "), math_words(m), F.lit(" ")))
    gaps = F.split(c, formula, -1)
    c = F.when(F.size(said) > 0, F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(said, i), F.lit(""))))), "")).otherwise(c)
    c = F.regexp_replace(c, r"\*\*", "")
    if not keep_arabic:
        c = F.regexp_replace(c, r"[؀-ۿݐ-ݿ]+", " ")
    return squeeze(F.regexp_replace(c, f"[{SILENT}]", " "))


def short_name(c: Column) -> Column:
    return F.get(F.split(F.trim(c), r"\s+"), F.lit(0))


def arabic_greeting_name(c: Column) -> Column:
    """The first name if it is in Arabic letters alone, else null."""
    first = short_name(c)
    return F.when(first.rlike("^[ء-ي]+$"), first)


def pick_id(raw: Column, known: Column) -> Column:
    """A known id named by ``raw`` (1 to 12 digits), else 1 if known, else the least known one, else 1."""
    named = F.when(F.trim(raw).rlike("^[0-9]{1,12}$"), F.trim(raw).try_cast("long"))
    fallback = F.when(F.array_contains(known, F.lit(1)), F.lit(1)).otherwise(F.coalesce(F.array_min(known), F.lit(1))).cast("long")
    return F.when(F.coalesce(F.array_contains(known, named), F.lit(False)), named).otherwise(fallback)


def first_enum(c: Column, phrases: dict[str, str], default: str | None = None) -> Column:
    """Value of the first phrase (in the given order) that the text holds."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in phrases.items()], F.lit(default))


def earliest_longest(c: Column, options: list[str]) -> Column:
    """The option that occurs first in the text; of those that begin at one place the longest."""
    hits = F.array_compact(F.array(*[F.when(F.contains(c, F.lit(o)), F.struct(F.instr(c, F.lit(o)).alias("at"), F.lit(-len(o)).alias("l"), F.lit(o).alias("o"))) for o in options]))
    return F.array_min(hits)["o"]


def bare_word(c: Column) -> Column:
    """A word without a leading conjunction, a preposition letter before the article, and the article."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^و", ""), "^[بلك](?=ال)", ""), "^ال", "")


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def slices(texts: pd.Series, chars: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """A batch in pieces of about ``chars`` characters (and one text): what a function makes of a batch may be many times larger than the batch."""
    piece = np.cumsum([0 if s is None else len(s) for s in texts]) // chars
    for _, some in texts.groupby(piece, sort=False):
        yield some


def tokenize_words(text: str) -> list[tuple[str, int, int]]:
    """Words with their half-open places."""
    out, at = [], 0
    for word in text.split():
        at = text.index(word, at)
        out.append((word, at, at + len(word)))
        at += len(word)
    return out


@F.pandas_udf(ArrayType(StructType().add("word", StringType()).add("start", IntegerType()).add("end", IntegerType())))
def words_with_places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in (some for batch in batches for some in slices(batch)):
        yield texts.map(lambda s: None if s is None else [dict(zip(("word", "start", "end"), w, strict=True)) for w in tokenize_words(s)])


@F.pandas_udf(ArrayType(StringType()))
def stage_vowelled(texts: pd.Series) -> pd.Series:
    """The text without marks, then with one more mark each, up to the whole."""

    def stages(s: str | None) -> list[str] | None:
        if s is None:
            return None
        places = [i for i, ch in enumerate(s) if 0x64B <= ord(ch) <= 0x65F or ord(ch) == 0x670]
        return ["".join(ch for i, ch in enumerate(s) if i not in set(places[k:])) for k in range(len(places) + 1)]

    return texts.map(stages)


@F.pandas_udf(StructType().add("folded", StringType()).add("places", ArrayType(IntegerType())))
def fold_for_match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The folded text, and for each of its characters the place in the original."""
    for texts in batches:
        for some in slices(texts):
            yield pd.DataFrame([(None, None) if s is None else _folded_with_places(s) for s in some], columns=["folded", "places"])


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"[{MARKS_WIDE}]", "")


#: Names of the vowel marks.
MARK_NAMES = {"fatha": "َ", "damma": "ُ", "kasra": "ِ", "sukun": "ْ", "shadda": "ّ", "fathatan": "ً", "dammatan": "ٌ", "kasratan": "ٍ"}


def _is_mark(ch: str) -> bool:
    return 0x64B <= ord(ch) <= 0x65F or ord(ch) == 0x670


@F.pandas_udf(StructType().add("start", IntegerType()).add("end", IntegerType()).add("letter", IntegerType()))
def locate_mark(text: pd.Series, find: pd.Series, on: pd.Series, expect: pd.Series) -> pd.DataFrame:
    """Marks on one letter (by its place in the word, -1 for the last) of a found word; nulls if it has none, or not the expected one."""

    def one(s, word, at, name):
        span = _locate(s, word, 1, False)
        letters = [i for i in range(*span) if not _is_mark(s[i])] if span else []
        if not letters:
            return None, None, None
        letter = letters[-1] if at < 0 else letters[min(at, len(letters) - 1)]
        end = next((i for i in range(letter + 1, len(s)) if not _is_mark(s[i])), len(s))
        missing = name in MARK_NAMES and MARK_NAMES[name] not in s[letter + 1 : end]
        return (None, None, None) if end == letter + 1 or missing else (letter + 1, end, letter)

    return pd.DataFrame([one(*row) for row in zip(text, find, on, expect, strict=True)], columns=["start", "end", "letter"]).astype("Int32")


def find_span(quote: Column, units: Column) -> Column:
    """On composed texts (``nfc``), struct (unit, words): the first unit, from 1, with a run of words that equal the quote's under the loose fold, as it is written there; null if there is none."""
    wanted = F.filter(F.split(fold_loose(quote), " "), lambda w: w != "")

    def run(unit: Column, n: Column) -> Column:
        words = F.filter(F.split(unit, r"\s+"), lambda w: w != "")
        folded = F.transform(words, fold_loose)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - F.size(wanted) + 1, F.lit(1))), lambda p: F.slice(folded, p, F.size(wanted)) == wanted)
        return F.when(F.size(starts) > 0, F.struct((n + 1).alias("unit"), F.array_join(F.slice(words, F.get(starts, F.lit(0)), F.size(wanted)), " ").alias("words")))

    return F.when(F.size(wanted) > 0, F.get(F.array_compact(F.transform(units, run)), F.lit(0)))


def match_run(text: Column, quote: Column) -> Column:
    """Struct (start, end): places (from 0) of the first run of words of a text that equal the quote's words; words of punctuation alone are seen through."""
    bare = lambda w: F.array_join(fold_words(w), "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    solid = F.filter(F.transform(words, lambda w, i: F.struct(bare(w).alias("w"), i.alias("i"))), lambda x: x["w"] != "")
    wanted = F.filter(F.transform(F.split(quote, r"\s+"), bare), lambda w: w != "")
    names = F.transform(solid, lambda x: x["w"])
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(names) - F.size(wanted) + 1, F.lit(1))), lambda p: F.slice(names, p, F.size(wanted)) == wanted)
    first = F.get(starts, F.lit(0))
    begin = F.when(first == 1, F.lit(0)).otherwise(F.get(solid, first - 2)["i"] + 1)
    return F.when((F.size(wanted) > 0) & first.isNotNull(), F.struct(begin.alias("start"), F.get(solid, first + F.size(wanted) - 2)["i"].alias("end")))
