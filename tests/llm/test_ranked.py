"""Block-Max WAND against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ranked
from tessera.llm.common import Words, text_blocks

from . import brute

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    texts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in texts:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in {*TERM.findall((text or "").translate(LOWER))} if t in c)
            if score > 0:
                rows.append((-score, math.inf if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "'x' AS term")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS q")
    return sorted([tuple(r) for r in ranked.search(ranked.build_index(d), i, k=k).collect()], key=repr)


def test_hard_documents(spark):
    docs = [(r[0], r[1]) for r in brute.documents()]
    items = [(0, "copy number words plain"), (1, None), (2, "  ,;"), (3, "w1 w2 W3 w4 w101"), (3, "w1 w2 W3 w4 w101"), (4, "nothing of it occurs zzzzz"), (None, "PALABRA ñandú é漢🙂"), (5, "x" * 3000)]
    assert search(spark, docs, items) == plain(docs, items)
    assert search(spark, [], items) == [] and search(spark, docs, []) == []


def many_documents():
    rng = np.random.default_rng(3)
    words = [f"w{int(i)}" for i in rng.zipf(1.3, 20000) % 400]
    at, docs = 0, []
    for _ in range(600):
        n = int(rng.integers(0, 40))
        docs.append((int(rng.integers(0, 500)), " ".join(words[at : at + n])))
        at = (at + n) % 19000
    docs += [(700, "hot passage of the same words")] * 3 + [(1000 + i, "hot passage of the same words") for i in range(200)]
    return docs, [(i, " ".join(words[i * 7 : i * 7 + 12])) for i in range(10)] + [(99, "hot passage")]


@pytest.mark.parametrize("shard,queries", [(2000, 3), (1 << 20, 256)])
def test_many_shards_and_query_blocks(spark, monkeypatch, shard, queries):
    docs, items = many_documents()
    monkeypatch.setattr(ranked, "SHARD_BYTES", shard)  # part of the function that goes to the workers
    monkeypatch.setattr(ranked, "QUERY_BLOCK", queries)
    assert search(spark, docs, items) == plain(docs, items)


def one_shard(texts):
    ((_, data, offsets),) = list(text_blocks(pa.array(texts)))
    w = Words(data, offsets, ranked._OUTSIDE)
    rows = ranked._shard_rows(0, [(np.arange(len(texts)), np.zeros(len(texts), bool), w.counts, w.encoded())], len(texts), int(w.counts.sum()))
    return ranked.Shard(pa.Table.from_batches(list(rows)))


@pytest.mark.parametrize("block,stride", [(1, 1), (4, 2), (7, 64), (128, 4)])
def test_any_blocks(monkeypatch, block, stride):
    """Blocks and stretches of any size give what scoring everything gives, ties included."""
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "STRIDE", stride)
    docs, items = many_documents()
    texts = [t for _, t in docs if t]
    shard = one_shard(texts)
    everything = [dict(zip(*np.unique(t.split(), return_counts=True))) for t in texts]
    for _, text in items:
        terms = sorted({t for t in text.split() if t in shard.row})
        weights = np.array([1000 + 37 * len(t) for t in terms])
        scores = np.array([sum(w * ranked.impacts(c[t], shard.factor[i]) for t, w in zip(terms, weights) if t in c) for i, c in enumerate(everything)])
        best = sorted(np.flatnonzero(scores), key=lambda i: (-scores[i], i))[:10]
        found, got = shard.search(np.array([shard.row[t] for t in terms]), weights, 10)
        assert found.tolist() == best and got.tolist() == scores[best].tolist()


def test_blocks_below_the_threshold_stay_packed():
    shard = one_shard(["common rare" if i < 20 else "common" for i in range(5000)])
    found, scores = shard.search(np.array([shard.row["common"], shard.row["rare"]]), np.array([1, 5000]), 10)
    assert found.tolist() == list(range(10)) and (np.diff(scores) <= 0).all()
    assert shard.open.sum() < len(shard.open) / 4  # most blocks of the frequent term were never unpacked


def test_packing():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31 - 1, 2**40])
    data, size = ranked.pack(values)
    assert ranked.unpack(data).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 6]
