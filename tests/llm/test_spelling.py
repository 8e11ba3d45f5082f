"""Spelling variants against a comparison of all words with all strings one edit away."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import spelling

from . import brute


def plain(n, ratio=2):
    letters = {c for w in n for c in w}
    forms = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in letters}
        near = [x for x in edits - {w} if x in n]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        forms[w] = (best if best and n[best] >= ratio * n[w] else None, len(near))
    out = set()
    for w, (form, near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.add((w, form, root, n[w], near, n[form] if form else None))
    return out


def counted(docs):
    import re

    c = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in c.items() if len(w) >= 5 and k >= 3}


def test_hard_documents(spark, tmp_path):
    words = ["letter", "leter", "lettre", "lettter", "better", "bitter", "aaaaa", "aaaaaa", "aaaaab", "éléphant", "elephant", "éléphants"]
    rnd = random.Random(2)
    docs = [(i % 50 if i % 9 else None, " ".join(rnd.choices(words, [2**k for k in range(len(words))], k=40))) for i in range(120)] + [(r[0], r[1]) for r in brute.documents()]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS p").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in spelling.op13_spelling(spark, str(tmp_path)).collect()}
    assert got == plain(counted(docs)) and any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abé", min_size=1, max_size=6), st.integers(1, 20), min_size=1, max_size=60))
def test_any_words(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(df).collect()} == plain(words)


def test_long_chain_and_empty(spark):
    """Each word is half as frequent as the next one: a chain whose end every word finds."""
    words = {"a" * k + "b" * (14 - k): 2**k for k in range(15)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 14}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


@pytest.mark.parametrize("size", [2000])
def test_light_branches_are_few(spark, size):
    """A word leaves the heavy path at no more than log2(words) + 1 places."""
    rnd = random.Random(4)
    words = {"".join(rnd.choices("abcd", k=rnd.randint(3, 10))) for _ in range(size)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    most = spelling.light_branches(df).groupBy("word").count().agg({"count": "max"}).first()[0]
    assert most <= len(words).bit_length() + 1
