"""Grading, scoring and replay functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

NUMBER_PREFIX = r"^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


def number_prefix(c: Column) -> Column:
    """The number that a text begins with (as lenient parsers read it), else null."""
    return F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double")


def grade(kind: Column, correct: Column, given: Column) -> Column:
    """Numeric answers agree within 1e-6 if both begin with a number; all others by trimmed lower case."""
    a, b = number_prefix(correct), number_prefix(given)
    text = F.lower(F.trim(correct)) == F.lower(F.trim(given))
    return F.coalesce(F.when((kind == "numeric") & a.isNotNull() & b.isNotNull(), (F.abs(a - b) < 1e-6) | (a == b)).otherwise(text), F.lit(False))


def mcq_match(key: Column, given: Column) -> Column:
    """First letters agree, whatever their case; neither is empty."""
    a, b = F.trim(key), F.trim(given)
    return F.coalesce((a != "") & (b != "") & (F.lower(F.substring(a, 1, 1)) == F.lower(F.substring(b, 1, 1))), F.lit(False))


def mcq_key(answer: Column, choices: Column) -> Column:
    """Key of the choice that an answer names, or null; of several the first.

    An answer that begins with a key, is one, or has one in brackets within its first six characters;
    else one that holds a choice's text, both under the loose fold. Under two keys nothing is resolved.
    """
    raw = F.coalesce(answer, F.lit(""))
    # texts are composed before the lambdas, which hold no Python
    texts = F.split(T.nfc(F.array_join(F.transform(choices, lambda c: F.coalesce(c["text"], F.lit(""))), "\x01")), "\x01")
    said = F.arrays_zip(F.transform(choices, lambda c: c["key"]).alias("key"), F.transform(texts, T.fold_loose).alias("text"), F.array_repeat(T.compare_loose(raw), F.size(choices)).alias("raw"))
    pick = lambda rows, test: F.get(F.filter(rows, test), F.lit(0))["key"]
    marked = pick(choices, lambda c: raw.startswith(c["key"]) | F.contains(F.substring(raw, 1, 6), F.concat(F.lit("("), c["key"], F.lit(")"))) | (F.regexp_replace(raw, r"^\s+|\s+$", "") == c["key"]))
    spelled = pick(said, lambda c: F.contains(c["raw"], c["text"]))
    return F.when(F.size(F.array_distinct(F.transform(choices, lambda c: c["key"]))) >= 2, F.coalesce(marked, spelled))


def slot_compare(a: Column, b: Column) -> Column:
    """match: equal sets of words; variant: one holds the other (or is empty); else conflict."""
    x, y = (F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")) for c in (a, b))
    less, more = F.size(F.array_except(x, y)), F.size(F.array_except(y, x))
    return F.when((less == 0) & (more == 0), "match").when((less == 0) | (more == 0), "variant").otherwise("conflict")


#: Weights of the five slots, in teaching order.
SLOT_WEIGHTS = {"role": 3.0, "state": 2.0, "sign": 3.0, "position": 0.5, "kind": 0.5}


def grade_slots(submission: Column, key: Column) -> Column:
    """Struct of per-slot results, weighted score (3 decimals), verdict and the first conflicting slot. A key without a role is invalid."""
    marks = {s: F.when(F.coalesce(key[s], F.lit("")) == "", F.lit("skip")).otherwise(slot_compare(submission[s], key[s])) for s in SLOT_WEIGHTS}
    weight = sum((F.when(marks[s] != "skip", F.lit(w)).otherwise(0.0) for s, w in SLOT_WEIGHTS.items()), F.lit(0.0))
    got = sum((F.when(marks[s] == "match", F.lit(w)).when(marks[s] == "variant", F.lit(w)).otherwise(0.0) for s, w in SLOT_WEIGHTS.items()), F.lit(0.0))
    score = F.round(got / F.nullif(weight, F.lit(0.0)), 3)
    first = F.coalesce(*[F.when(marks[s] == "conflict", F.lit(s)) for s in SLOT_WEIGHTS])
    some_variant = F.array_contains(F.array(*marks.values()), F.lit("variant"))
    verdict = (
        F.when(F.coalesce(key["role"], F.lit("")) == "", "KEY_INVALID").when(first.isNull() & some_variant, "VARIANT").when(first.isNull(), "AGREE")
        .when(score >= 0.5, "PARTIAL").otherwise("DISAGREE")
    )
    return F.struct(verdict.alias("verdict"), F.when(first.isNull(), True).otherwise(False).alias("correct"), score.alias("score"), first.alias("first_conflict"), F.struct(*[m.alias(s) for s, m in marks.items()]).alias("slots"))


def replay_ordered(taps: Column, wanted: Column) -> Column:
    """Ordered placement: the cursor moves on a right tap, else a misstep is counted."""
    start = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("missteps"))
    return F.aggregate(taps, start, lambda s, x: F.struct((s["cursor"] + F.when(F.coalesce(F.get(wanted, s["cursor"]) == x, F.lit(False)), 1).otherwise(0)).alias("cursor"), (s["missteps"] + F.when((s["cursor"] < F.size(wanted)) & ~F.coalesce(F.get(wanted, s["cursor"]) == x, F.lit(False)), 1).otherwise(0)).alias("missteps")))


def replay_spans(taps: Column, targets: Column) -> Column:
    """Span extraction: found targets and misses; a second tap on a found one is free."""
    hits = F.array_distinct(F.filter(taps, lambda x: F.array_contains(targets, x)))
    return F.struct(F.size(hits).alias("found"), F.size(F.filter(taps, lambda x: ~F.array_contains(targets, x))).alias("misses"), (F.size(hits) == F.size(F.array_distinct(targets))).alias("complete"))


def replay_strikes(tries: Column, key: Column, most: int = 2) -> Column:
    """Tries until the first right one; revealed after ``most`` wrong ones."""
    start = F.struct(F.lit(0).alias("strikes"), F.lit(False).alias("solved"))
    end = F.aggregate(tries, start, lambda s, x: F.when(s["solved"] | (s["strikes"] >= most), s).otherwise(F.struct((s["strikes"] + F.when(x == key, 0).otherwise(1)).alias("strikes"), (x == key).alias("solved"))))
    return F.struct(end["strikes"].alias("strikes"), end["solved"].alias("solved"), (~end["solved"] & (end["strikes"] >= most)).alias("revealed"))


def replay_pairs(taps: Column, pairs: Column) -> Column:
    """Term matching: taps are structs (side, item); a right pair is matched, a wrong one resets the selection and counts."""
    start = F.struct(F.lit(None).cast("string").alias("held"), F.lit(0).alias("matched"), F.lit(0).alias("wrong"))

    def step(s, x):
        is_term = x["side"] == "term"
        right = F.coalesce(F.element_at(pairs, s["held"]) == x["item"], F.lit(False))
        return F.when(is_term, F.struct(x["item"].alias("held"), s["matched"].alias("matched"), s["wrong"].alias("wrong"))).when(s["held"].isNull(), s).otherwise(
            F.struct(F.lit(None).cast("string").alias("held"), (s["matched"] + right.cast("int")).alias("matched"), (s["wrong"] + (~right).cast("int")).alias("wrong"))
        )

    return F.aggregate(taps, start, step)


def product_check(picked: Column, wanted: Column) -> Column:
    return F.struct(F.size(F.array_except(picked, wanted)).alias("wrong"), F.size(F.array_except(wanted, picked)).alias("missed"))


def quadrant(x: Column, y: Column) -> Column:
    return F.when((x == 0) | (y == 0), "axis").when((x > 0) & (y > 0), "I").when((x < 0) & (y > 0), "II").when((x < 0) & (y < 0), "III").otherwise("IV")


def swapped_pair(x: Column, y: Column, want_x: Column, want_y: Column) -> Column:
    return (x == want_y) & (y == want_x) & (want_x != want_y)


def parabola(a: Column, b: Column, c: Column) -> Column:
    """Vertex, discriminant and real roots of a x^2 + b x + c (or of a line if a is 0)."""
    d = b * b - 4 * a * c
    vx = F.when(a != 0, -b / (2 * a))
    roots = F.when((a == 0) & (b != 0), F.array(-c / b)).when((a != 0) & (d == 0), F.array(vx)).when((a != 0) & (d > 0), F.array_sort(F.array((-b - F.sqrt(F.abs(d))) / (2 * a), (-b + F.sqrt(F.abs(d))) / (2 * a))))
    return F.struct(vx.alias("vx"), (a * vx * vx + b * vx + c).alias("vy"), d.alias("discriminant"), F.coalesce(roots, F.expr("CAST(array() AS array<double>)")).alias("roots"))


def sample_curve(a: Column, b: Column, c: Column, lo: Column, hi: Column, n: int = 65) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((lo + (hi - lo) * i / (n - 1)).alias("x"), (a * F.pow(lo + (hi - lo) * i / (n - 1), F.lit(2)) + b * (lo + (hi - lo) * i / (n - 1)) + c).alias("y")))


def complete_right_triangle(a: Column, b: Column, h: Column) -> Column:
    """The missing side of a right triangle; 3, 4, 5 where less than two sides are given."""
    third = F.sqrt(F.greatest(h * h - F.coalesce(a, b) * F.coalesce(a, b), F.lit(0.0)))
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.array(a, b, F.coalesce(h, F.sqrt(a * a + b * b)))).when(a.isNotNull() & h.isNotNull(), F.array(a, third, h))
        .when(b.isNotNull() & h.isNotNull(), F.array(third, b, h)).otherwise(F.array(F.lit(3.0), F.lit(4.0), F.lit(5.0)))
    )


def lerp_colour(score: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Hex colour of a score between ordered stops."""
    s = F.least(F.greatest(score, F.lit(stops[0][0])), F.lit(stops[-1][0]))
    out = None
    for (a, low), (b, high) in zip(stops, stops[1:], strict=False):
        part = (s - a) / (b - a)
        hexes = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.floor(F.lit(x) + (y - x) * part + 0.5))), 2, "0") for x, y in zip(low, high, strict=True)])
        out = F.when(s <= b, hexes) if out is None else out.when(s <= b, hexes)
    return out


def nice_step(span: Column, ticks: int = 5) -> Column:
    """1, 2 or 5 times a power of ten, at least span / ticks."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return F.when(m <= 1, power).when(m <= 2, 2 * power).when(m <= 5, 5 * power).otherwise(10 * power)


def root_number(c: Column) -> Column:
    """Value of texts such as a number, a root sign with a number, or a factor before it; null if it is none of them."""
    factor = F.coalesce(F.nullif(F.regexp_extract(c, "^\\s*([0-9.]*)\\s*√", 1), F.lit("")).try_cast("double"), F.lit(1.0))
    under = F.regexp_extract(c, "√\\s*([0-9.]+)", 1).try_cast("double")
    return F.when(c.rlike("√"), factor * F.sqrt(under)).otherwise(F.trim(c).try_cast("double"))
