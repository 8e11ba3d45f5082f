"""The stream guard against rescans of all text, and its fold against the column expression."""

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.streaming import guard

SEALED = "إِنَّ أَوَّلَ خُطْوَةٍ فِي الطَّرِيقِ هِيَ النِّيَّةُ"


def rescanned(g, deltas):
    """Shown text, by scanning everything so far after each delta."""
    text, shown, out = "", 0, ""
    for i, delta in enumerate(deltas):
        text += delta
        words = [w for w in guard.words_of(text) if w]
        if any(" ".join(words[k : k + g.run]) in g.runs for k in range(len(words))):
            return out + ("\n\n" if shown else "") + g.redirect
        upto = len(text) if i == len(deltas) - 1 else max(shown, len(text) - g.holdback)
        out, shown = out + text[shown:upto], upto
    return out


def stepped(g, deltas):
    held, out = guard.Held(), ""
    for i, delta in enumerate(deltas):
        held, text, _ = g.step(held, delta, i == len(deltas) - 1)
        out += text or ""
        assert len(held.pending) <= g.holdback and held.words.count(" ") < g.run
    return out


@given(st.lists(st.text("ab c.َ", max_size=9), max_size=12), st.integers(1, 4), st.integers(0, 12))
def test_any_deltas_as_rescans(deltas, run, holdback):
    g = guard.Guard(["a b c a", "ab ba. abc a", "b b b b b"], run, holdback)
    assert stepped(g, deltas) == rescanned(g, deltas)


def test_retyped_quotes_are_caught():
    g = guard.Guard([SEALED])
    quotes = ["ان اول خطوه في", "إنّ أوّلَ، خطوةٍ (في)", "اول خطوه في الطريق", "خطوة في الطريق\nهي", "ٱن ءاول خطوه في الطريق هى"]
    for quote in quotes:
        for size in (1, 3, len(quote)):
            shown = stepped(g, ["قال: "] + [quote[i : i + size] for i in range(0, len(quote), size)] + [" انتهى" * 30])
            assert shown.endswith(guard.REDIRECT) and "خطو" not in shown, (quote, size)
    free = "الطريق هي خطوة في اول النية " * 20
    assert stepped(g, [free[i : i + 7] for i in range(0, len(free), 7)]) == free


def test_work_and_state_do_not_grow_with_the_session():
    g, held = guard.Guard([SEALED]), guard.Held()
    for i in range(2000):
        held, _, _ = g.step(held, f"word{i} and ", False)
    assert len(held.pending) <= g.holdback and held.words.count(" ") < g.run


def test_fold_is_that_of_the_column(spark):
    rnd = random.Random(5)
    points = [c for c in map(chr, range(1, 0x3000)) if not 0xD800 <= ord(c) < 0xE000 and c not in "Σς"]
    texts = ["a" + "b".join(points[i : i + 40]) for i in range(0, len(points), 40)] + ["".join(rnd.choices("ab أإىةَّـ،.   ﴾", k=20)) for _ in range(500)]
    # signs that the JVM's Unicode tables don't know yet are left out
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_replace("t", r"\p{Cn}", "").alias("t"))
    for r in df.select("t", T.fold_words(F.col("t")).alias("w")).collect():
        assert [w for w in guard.words_of(r.t) if w] == r.w
