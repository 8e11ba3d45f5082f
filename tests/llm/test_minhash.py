from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.common import text_blocks

from . import brute
from .test_operators import SF, docs, empty, empty_dir, sf_dir  # noqa: F401


def shingle_sets(texts):
    out = []
    for t in texts:
        w = brute.WORD.findall(t or "")
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter({tuple(w): 1} if w else {}))
    return out


def brute_weights(counts):
    """tf * idf of every shingle of every text, idf from 1 (all texts) to 2 (a hundredth of them or less)."""
    df = Counter(x for c in counts for x in c)
    return [{x: n * (1 + min(1.0, np.log(len(counts) / df[x]) / np.log(100))) for x, n in c.items()} for c in counts]


def weighted_jaccard(a, b):
    shared = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute_classes(rows, threshold=0.8):
    """Least id of each component of equal texts and pairs of similar weighted shingles."""
    sets = brute_weights(shingle_sets([t for _, t in rows]))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = set()
    for members in by.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if weighted_jaccard(sets[i], sets[j]) >= threshold - 1e-12:
                        up[root(j)] = root(i)
    first = {}
    for i, (_, t) in enumerate(rows):
        if (j := first.setdefault(t or "", i)) != i:
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return Counter((d, least.get(root(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("where", ["hard", "sf0.001", "sf0.01"])
def test_classes_match_brute_force(spark, sf_dir, where):  # noqa: F811
    path = sf_dir if where == "hard" else SF.replace("sf0.001", where)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.class_id) for r in minhash.op10_near_dedup(spark, path).collect())
    want = brute_classes(rows)
    assert sum((want - got).values()) == 0, list((want - got).items())[:5]


def test_groups_of_near_copies(spark):
    """A large group whose members differ from their base by a few words, and passages that others share."""
    rng = np.random.default_rng(1)
    vocab = [f"v{i}" for i in range(3000)]
    base = list(rng.choice(vocab, 200))
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 3)):
            words[at] = str(rng.choice(vocab))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*rng.choice(vocab, 150), *base[:60]])) for i in range(100)]
    got = Counter((r.doc_id, r.class_id) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_classes(rows)


def template_rows():
    """Documents on one template, a little less similar than the threshold, and pairs of them that reach it by some words more."""
    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*template, *[f"p{i // 2}x{j}" for j in range(24)], *[f"o{i}x{j}" for j in range(10)]])) for i in range(800)]
    return [rows[i] for i in rng.permutation(len(rows))]


def test_pairs_within_a_large_template(spark, monkeypatch):
    rows = template_rows()
    weights = dict(zip([d for d, _ in rows], brute_weights(shingle_sets([t for _, t in rows]))))
    assert all(weighted_jaccard(weights[0], weights[i]) < 0.8 for i in range(2, 800)) and weighted_jaccard(weights[0], weights[1]) > 0.8
    monkeypatch.setattr(minhash, "REST_BLOCK", 100)  # blocks of a bucket meet in several tiles
    got = Counter((r.doc_id, r.class_id) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    # bands are a sample: at this similarity a pair in a thousand shares no bucket at all
    lost = [d for d, c in got if c != d // 2 * 2]
    assert all(c in (d, d // 2 * 2) for d, c in got) and len(lost) <= 4, len(lost)


def test_document_frequencies_are_exact(spark):
    """A shingle that just over a hundredth of the documents hold, spread over all partitions, and one just under it."""
    rows = [(i, " ".join([f"a{i} b{i} c{i} d{i} e{i}", *(["often seen words stand here"] if i % 90 == 0 else []), *(["seldom seen words stand there"] if i % 110 == 0 else [])])) for i in range(5000)]
    weights = minhash.weigh(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    held = Counter(x for c in shingle_sets([t for _, t in rows]) for x in c)
    want = sorted(1 + np.log(5000 / n) / np.log(100) for n in held.values() if n > 50)
    assert len(want) == 1 and np.allclose(sorted(weights.idf), want)


def test_different_texts_of_one_polynomial_hash(spark):
    """Words that are equal under every polynomial hash modulo 2**64 are different words."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, a), (4, b)]
    assert all(r.doc_id == r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sampling_meets_weighted_similarity():
    rng = np.random.default_rng(2)
    sampler, weights = minhash.Sampler(), minhash.Weights(np.zeros(0, np.uint64), np.zeros(0), 100)
    for share in (0.3, 0.8):
        equal, want = [], []
        for _ in range(30):
            words = [f"x{rng.integers(1 << 30)}" for _ in range(400)]
            cut = int(400 * (1 - share) / (1 + share))
            a, b = " ".join(words[: 400 - cut]), " ".join(words[cut:])
            import pyarrow as pa

            (_, data, offsets), = text_blocks(pa.array([a, b]))
            row, value, count = minhash.shingles(data, offsets)
            level = weights.levels(value, count)
            sig = sampler.sample(np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), value, level)
            equal.append((sig[0] == sig[1]).mean())
            x, y = set(value[row == 0]), set(value[row == 1])
            want.append(len(x & y) / len(x | y))
        assert abs(np.mean(equal) - np.mean(want)) < 0.03


def test_keep_one(spark, docs, empty):  # noqa: F811
    out = minhash.keep_one(docs).collect()
    rows = [(r[0], r[1]) for r in brute.documents()]
    classes = brute_classes(rows)
    assert Counter(r.doc_id for r in out if r.doc_id is not None) == Counter({c for _, c in classes if c is not None})
    assert minhash.keep_one(docs).columns == docs.columns and minhash.keep_one(empty).count() == 0


def test_empty(spark, empty_dir):  # noqa: F811
    assert minhash.op10_near_dedup(spark, empty_dir).count() == 0


CRAFTED = ("yleposr", "`Dnga2f&")  # equal under a hash that can be turned back


def test_crafted_words_are_told_apart(spark):
    a, b = CRAFTED
    rows = [(1, " ".join([a] * 9)), (2, " ".join([b] * 9)), (3, a), (4, b)]
    assert {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i for i in range(1, 5)}


def test_workers_get_small_batches(spark, monkeypatch):
    """Pairs of whole texts come to a Python worker some megabytes at a time, however many a task has."""
    verify, most = minhash._verify, 12 << 20

    def watched(weights, threshold):
        run = verify(weights, threshold)

        def held(batches):
            for batch in batches:
                if batch.nbytes > most:
                    raise MemoryError(f"{batch.nbytes} bytes at once")
                yield batch

        return lambda batches: run(held(batches))

    monkeypatch.setattr(minhash, "_verify", watched)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):  # pairs of 20 KB
        words = [f"w{x}" for x in rng.integers(0, 30000, 1600)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {d: d - d % 2 for d, _ in rows}
