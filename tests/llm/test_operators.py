import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import bpe, mixing, quality, resharding, secrets, substrings, token_files, vectors
from tessera.llm.common import materialize, scratch_path

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), brute.DOCUMENTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.DOCUMENTS)


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    """The hard documents as a table on disk, with extra columns whose names clash with inner ones."""
    path = tmp_path_factory.mktemp("sf")
    d = docs.selectExpr("*", "1 AS size", "2 AS shard", "'x' AS blob", "3 AS part", "4 AS ids", "5 AS block", "6 AS h", "7 AS node", "8 AS weight")
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(0, 13)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty_dir(empty, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    empty.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("where", ["hard", "sf"])
def test_secrets_match_brute_force(spark, sf_dir, where):
    path = sf_dir if where == "hard" else SF
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = [tuple(r)[:6] for r in secrets.op1_secret_scan(spark, path).collect()]
    assert Counter(got) == Counter((d, *brute.secrets(t)) for d, t in rows)
    if where == "hard":
        assert sum(r[1] for r in got) > 3 and sum(r[2] for r in got) == 2 and sum(r[3] for r in got) == 2


def test_secret_ledger_scans_only_unseen_pairs(spark, docs):
    ledger = scratch_path(spark, "test-ledger")
    first = secrets.scan_blobs(docs.filter("doc_id < 8"), ledger).count()
    total = secrets.scan_blobs(docs, ledger).count()
    assert first < total == docs.select(secrets.blob_id(docs.text)).distinct().count()
    files = len(secrets.read_ledger(spark, ledger).inputFiles())
    assert secrets.scan_blobs(docs, ledger).count() == total  # nothing new
    assert len(secrets.read_ledger(spark, ledger).inputFiles()) <= files + 4
    assert secrets.read_ledger(spark, ledger).count() == total
    assert secrets.scan_blobs(docs, ledger, rule_version="2").count() == total  # another rule version: everything again
    assert secrets.read_ledger(spark, ledger).count() == 2 * total


def test_keys_may_have_any_name(spark, docs):
    named = docs.selectExpr("doc_id AS blob", "text", "doc_id AS findings")
    out = secrets.find_secrets(named, scratch_path(spark, "test-ledger"), ["blob", "findings"])
    assert out.filter("blob = 9 AND findings = 9 AND size(secret_findings) = 1").count() == 1 and out.count() == docs.count()


def test_redaction(spark, docs):
    out = {r.doc_id: r for r in secrets.redact_documents(docs, scratch_path(spark, "test-ledger")).collect()}
    assert out[9].text == "é🙂 [SECRET]" and out[9].n_chars == len(out[9].text)
    assert out[0].text == "plain text here" and out[1].text is None and len(out) == len({r[0] for r in brute.documents()})


def test_mixing(spark, sf_dir):
    for path in (sf_dir, SF):
        rows = mixing.op8_mixing(spark, path).collect()
        size = {s: sum(r["size"] for r in rows if r.source == s) for s in {r.source for r in rows}}
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        target, full, total = {}, set(), 1.5 * sum(size.values())
        while True:  # clamp, then share out again
            rest = total - sum(2 * size[s] for s in full)
            free = [s for s in order if s not in full]
            target = {s: 2.0 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
            over = {s for s in free if target[s] > 2 * size[s]}
            if not over:
                break
            full |= over
        for r in rows:
            assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        for s in order:
            assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 1
        assert Counter(rows) == Counter(mixing.op8_mixing(spark, path).collect())


def test_mixing_documents_keeps_columns(spark, docs, empty):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count() + 2
    assert mixing.mix_documents(empty).count() == 0
    # 101 equal rows beside another source: the mix takes about its target of them, not all of them twice
    rows = [(1, "a b c d e f g h i j", "en", "b", 1)] * 101 + [(2, "x " * 1000, "en", "a", 1)]
    same = spark.createDataFrame(rows, brute.DOCUMENTS)
    target = mixing.mix_takes(materialize(mixing.size_documents(same), "test"), whole_documents=True).filter("source = 'b'").first().target
    taken = mixing.mix_documents(same).filter("doc_id = 1").count() * 10
    assert abs(taken - target) <= 10 < 2020 - target


def test_bpe_equals_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    for path in (sf_dir, SF):
        rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
        want = []
        for d, t in rows:
            ids = library.encode(t, add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert Counter(map(tuple, bpe.op6_bpe(spark, path).collect())) == Counter(want)


def test_token_files(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    for path in (sf_dir, SF):
        rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        at, want = 0, []
        for d, t in rows:
            ids = [*library.encode(t, add_special_tokens=False).ids, 2]
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert Counter(map(tuple, token_files.op5_token_files(spark, path).collect())) == Counter(want)


def test_token_reads(spark, docs):
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs.filter("doc_id >= 0 AND doc_id != 6"), path, end=2)
    meta = token_files.read_metadata(spark, path)
    assert "ids" not in meta.columns
    ids = token_files.read_tokens(spark, path, [4]).first().ids
    part = token_files.read_slices(spark, path, spark.createDataFrame([(4, 3, 5)], "doc_id long, first int, count int")).first().ids
    assert part == ids[3:8] and meta.filter("doc_id = 4").first().n_tokens == len(ids)


def test_resharding(spark, sf_dir):
    for path in (sf_dir, SF):
        rows = resharding.op7_resharding(spark, path).collect()
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, brute.crc(r.text)) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
        if path == SF:
            sizes = [sum(r["size"] for r in by[j]) for j in range(16)]
            assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_rewriting_touches_changed_shards_alone(spark, tmp_path):
    """One byte of capacity goes from shard 1 to shard 2: shards 0 and 3 keep their files, and columns of any name pass through."""
    rows = [(i, "x" * (i % 7), i, f"s{i}", i * 2) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, shard string, block long")
    sizes = [sum(len(r[1]) + 1 for r in rows if r[0] % 4 == s) for s in range(4)]
    out = resharding.rewrite(docs, docs.doc_id % 4, f"{tmp_path}/out", 4, [sizes[0], sizes[1] - 9, sizes[2] + 9, sizes[3]])
    got = out.collect()
    assert Counter(tuple(r)[:0] + (r.doc_id, r.text, r["size"], r.shard, r.block) for r in got) == Counter(rows)
    moved = [r for r in got if r.reshard_new != r.doc_id % 4]
    assert moved and all((r.doc_id % 4, r.reshard_new) == (1, 2) for r in moved)
    written = {p.name for p in tmp_path.joinpath("out").iterdir() if p.is_dir()}
    assert written == {"reshard_new=1", "reshard_new=2"}
    for s in range(4):
        assert sorted(r.slot for r in resharding.with_slots(out).filter(f"reshard_new = {s}").collect()) == list(range(sum(r.reshard_new == s for r in got)))


def test_flow_moves_least():
    rng = np.random.default_rng(3)
    for _ in range(20):
        supply = [int(x) for x in rng.integers(0, 50, 5)]
        capacity = [int(x) for x in rng.integers(0, 60, 7)]
        if sum(capacity) < sum(supply):
            with pytest.raises(ValueError):
                resharding.min_cost_flow(supply, capacity)
            continue
        flow = resharding.min_cost_flow(supply, capacity)
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(5)] == supply
        assert all(sum(f for (_, j), f in flow.items() if j == k) <= capacity[k] for k in range(7))
        assert sum(f for (i, j), f in flow.items() if i == j) == sum(min(s, c) for s, c in zip(supply, capacity))


def embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [], 0), (302, [float("nan")] * 8, 0), (303, [None] + [1.0] * 7, 0), (304, [0.0] * 8, 0), (305, [1.0, 2.0], 0), (306, rows[5][1], 0), (307, rows[5][1], 1), (308, [float("inf")] * 8, 0), (5, rows[5][1], 0), (None, rows[5][1], 0), (320, [3e5] * 8, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_vector_searches(spark, monkeypatch):
    frame, rows = embeddings(spark)
    monkeypatch.setattr(vectors, "BLOCK", 60)  # several blocks of both sides are merged
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    used = [(i, np.pad(np.array(v, float), (0, 8 - len(v)))) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    exact = defaultdict(list)
    v = vectors.usable(frame, "vec_id", "embedding", zero=True)
    for r in vectors.top_k_exact(v, v.filter("id % 20 = 0"), k=20).collect():
        exact[r.query_id].append((r.rank, r.vec_id, r.score))
    for at, (i, q) in enumerate(used):
        if i % 20 == 0:
            want = sorted((-int((np.floor(64 * q) * np.floor(64 * x)).sum()), j) for other, (j, x) in enumerate(used) if other != at)[:20]
            assert sorted(exact[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    v = vectors.usable(frame, "vec_id", "embedding", zero=False)
    near = defaultdict(list)
    for r in vectors.nearest_by_hashing(v, v.filter("id % 10 = 0")).collect():
        near[r.query_id].append((r.rank, r.vec_id, r.score))
    used = [(i, x) for i, x in used if x.any()]
    hits = total = 0
    for at, (i, q) in enumerate(used):
        if i % 10 == 0:
            want = sorted((np.sqrt(((x - q) ** 2).sum()), j) for other, (j, x) in enumerate(used) if other != at)[:10]
            got = sorted(near[i])
            assert [g[0] for g in got] == list(range(1, 11)) and [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
            hits += len({g[1] for g in got} & {j for _, j in want})
            total += len({j for _, j in want})
    assert hits / total >= 0.9


def test_vector_queries_on_table(spark):
    from pyspark.sql import functions as F

    out = vectors.op9_nearest(spark, SF).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").filter(F.col("embedding").isNotNull()).collect()}
    hits = 0
    for q in {r.query_id for r in out}:
        want = sorted((np.sqrt(((x - rows[q]) ** 2).sum()), j) for j, x in rows.items() if j != q)[:10]
        hits += len({j for _, j in want} & {r.vec_id for r in out if r.query_id == q})
    assert hits / len(out) >= 0.9


@pytest.mark.parametrize("query", [secrets.op1_secret_scan, vectors.op2_top_k, substrings.op3_substring_dedup, quality.op4_quality, token_files.op5_token_files, bpe.op6_bpe, resharding.op7_resharding, mixing.op8_mixing, vectors.op9_nearest])
def test_empty_tables(spark, empty_dir, query):
    assert query(spark, empty_dir).count() == 0


def test_materialize_cuts_lineage(spark, docs):
    assert materialize(docs, "test").count() == docs.count()


def test_window_dedup(spark, sf_dir):
    for path in (SF, sf_dir):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
        got = Counter(map(tuple, substrings.op3_substring_dedup(spark, path).collect()))
        assert got == Counter(brute.window_dedup(rows))
        assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("seed", range(4))
def test_window_dedup_in_blocks_and_with_frequent_prefixes(spark, seed, monkeypatch):
    """Random texts over few words: repeats everywhere; groups of a few KB, so that prefixes are extended."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(rng.choice(list("abc"), 40)) for _ in range(3)]
    rows = [(int(i), " ".join([*rng.choice(list("abcdefgh"), rng.integers(0, 60)), passages[rng.integers(3)], *rng.choice(list("ab"), rng.integers(0, 30))])) for i in rng.permutation(120)]
    monkeypatch.setattr(substrings, "GROUP_BYTES", 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(docs).collect()}
    assert got == {d: tuple(r) for d, *r in brute.window_dedup(rows)}


def test_quality_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = quality.op4_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.97


def test_quality_hard_cases(spark, sf_dir):
    rows = quality.op4_quality(spark, sf_dir).collect()
    assert len(rows) == len(brute.documents()) and all(0 <= r.score <= 1 for r in rows)
    none = quality.score(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), None).collect()
    assert [r.score for r in none] == [0.5, 0.5]


def test_messages_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5])
    e, trans = rng.normal(size=9), rng.normal(size=4)
    forward, backward = quality.Chains(counts).messages(e, trans)
    at = 0
    for n in counts:
        total = np.zeros((n, 2))
        for labels in product((0, 1), repeat=int(n)):
            p = np.exp(sum(e[at + i] for i in range(n) if labels[i]) + sum(trans[2 * a + b] for a, b in zip(labels, labels[1:])))
            for i, x in enumerate(labels):
                total[i, x] += p
        assert np.allclose(forward[at : at + n] + backward[at : at + n], np.log(total[:, 1] / total[:, 0]))
        at += n


def test_line_features_of_odd_blocks():
    import pyarrow as pa

    from tessera.llm.common import text_blocks

    texts = ["", "\n", "a\n\nb", "x", None, "\n\n", "A!! b||\nA!! b||"]
    (_, data, offsets), = text_blocks(pa.array(texts))
    x, size, counts = quality.line_features(data, offsets)
    assert counts.tolist() == [len((t or "").split("\n")) for t in texts]
    assert size.tolist() == [len(line) for t in texts for line in (t or "").split("\n")] and np.isfinite(x).all() and (x >= 0).all()


def test_own_row_alone_is_left_out(spark):
    """Three equal rows of query 20 and a fourth row of that id: each copy finds the two others and the fourth."""
    rows = [(20, [1.0, 2.0])] * 3 + [(20, [1.0, 2.5]), (7, [-9.0, 1.0]), (8, [1e100, 0.0])]
    vecs = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame(rows[:3], vecs.schema)
    near = Counter((r.rank, r.vec_id, r.score) for r in vectors.nearest_by_hashing(vecs, queries, k=4).collect())
    assert near[1, 20, 0.0] == near[2, 20, 0.0] == near[3, 20, 0.5] == 3 and sum(near.values()) == 12
    top = Counter((r.rank, r.vec_id) for r in vectors.top_k_exact(vecs, queries, k=9).collect())
    assert top == Counter({(1, 8): 3, (2, 20): 3, (3, 20): 3, (4, 20): 3, (5, 7): 3})


def test_recall_on_the_larger_table(spark):
    from pyspark.sql import functions as F

    path = SF.replace("sf0.001", "sf0.1")
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").filter(F.col("embedding").isNotNull()).toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    out = vectors.op9_nearest(spark, path).toPandas()
    hits = total = 0
    for q, got in out.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        d[at] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got["vec_id"]))
        total += 10
    assert total >= 200 and hits / total >= 0.9


def test_repeated_queries_get_whole_lists(spark):
    """Query 20 stands twice with equal vectors: each copy gets its k best, and the rows of another query stay as they are."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(101)]
    rows.append(rows[20])
    vecs = spark.createDataFrame(rows, "id long, v array<double>")
    for search, k in ((vectors.top_k_exact, 20), (vectors.nearest_by_hashing, 10)):
        once = Counter(map(tuple, search(vecs, spark.createDataFrame([rows[20], rows[40]], vecs.schema)).collect()))
        twice = Counter(map(tuple, search(vecs, spark.createDataFrame([rows[20], rows[40], rows[20]], vecs.schema)).collect()))
        assert sum(n for r, n in once.items() if r[0] == 20) == k
        assert twice == Counter({r: n * (2 if r[0] == 20 else 1) for r, n in once.items()})


def crafted_pair():
    """Two words of 1,024 letters that every polynomial hash modulo 2**64 takes for equal."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_crafted_words_keep_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    a, b = crafted_pair()
    rows = [(0, a), (1, b), (2, f"x {b} {a}"), (3, "\0\0 \0"), (4, a)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(bpe.default_tokenizer())
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, str(tmp_path)).collect()}
    assert got == {d: (hashlib.sha256(np.array(ids[d], "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows}
    files = {r.doc_id: r.ids_crc32 for r in token_files.op5_token_files(spark, str(tmp_path)).collect()}
    assert files == {d: zlib.crc32(np.array([*ids[d], 2], "<u4").tobytes()) for d, _ in rows}


@pytest.mark.parametrize("kind", [bpe.ByteBPE, token_files.LibraryBPE])
def test_pieces_of_one_name_are_told_apart(kind):
    """All longer pieces under one name: bytes decide, within a block and against what is known."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.llm.common import text_blocks

    class OneName(kind):
        def names(self, data, starts, lengths):
            return np.where(lengths > 7, np.uint64(0xFF << 56), super().names(data, starts, lengths))

    library, ours = Tokenizer.from_file(bpe.default_tokenizer()), OneName(bpe.default_tokenizer())
    for texts in (["wonderful things happening", "everywhere wonderful"], ["considerable wonderful"], ["everything considerable", ""]):
        (_, data, offsets), = text_blocks(pa.array(texts))
        ids, counts = ours.encode_block(data, offsets)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_windows_of_crafted_words_and_a_passage_in_every_document(spark):
    a, b = crafted_pair()
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(0, " ".join([a] * 25)), (1, " ".join([b] * 25))] + [(i, f"{i} one {passage} two {i * 7}") for i in range(2, 300)]
    rows += [(None, rows[5][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(docs).collect())
    assert got == Counter(brute.window_dedup(rows))


def test_groups_of_suffixes_are_even():
    """Anchors have small hashes, groups must not show it."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(rng.choice(words, 2000)) for _ in range(60)]
    batch = pa.record_batch([pa.array(range(60)), pa.array(range(60)), pa.array(texts)], names=["doc_id", "key", "text"])
    sizes = Counter()
    for rows in substrings.suffixes(4, np.zeros(0, np.uint64), b"")([batch]):
        for g, places in zip(rows.column("grp").to_pylist(), rows.column("places").to_pylist()):
            sizes[g] += len(places)
    assert len(sizes) == 16 and max(sizes.values()) < 1.3 * sum(sizes.values()) / 16


def test_settings_are_as_before(spark, sf_dir):
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    substrings.op3_substring_dedup(spark, sf_dir)
    token_files.op5_token_files(spark, sf_dir)
    assert [spark.conf.get(k) for k in keys] == before


def brute_quality(model, text):
    """The score of a text by plain loops: features of each line, messages in the order of the lines."""
    import math
    import re

    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()", b"-_=+/\\"]
    of = {c: k for k, cs in enumerate(kinds, 1) for c in cs} | {c: 11 for c in range(128, 256)}
    lines = (text or "").encode().split(b"\n")
    split = [re.findall(rb"[^\x20\x09-\x0D]+", line) for line in lines]
    rows = []
    for line, words in zip(lines, split):
        count = [sum(of.get(c, 0) == k for c in line) for k in range(12)]
        size, n = len(line), len(words)
        share = [c / max(size, 1) for c in count]
        double = sum(x == y and of.get(x, 0) in (5, 6, 7, 8, 9, 10) for x, y in zip(line, line[1:]))
        echo = sum(x == y for x, y in zip(words, words[1:]))
        again = n > 0 and sum(sorted(w) == sorted(words) for w in split) > 1
        rows.append([*share, *map(math.sqrt, share), math.log1p(size) / 8, math.log1p(n) / 6, size == 0, min(size / max(n, 1), 40) / 10, double / max(n, 1), double > 1, again, echo / max(n, 1), count[2] / max(count[1] + count[2] + count[11], 1)])
    x = (np.array(rows, float) - model["mean"]) / model["spread"]
    none = np.zeros(x.shape[1])
    e = [float(np.r_[x[i], x[i - 1] if i else none, x[i + 1] if i + 1 < len(x) else none, i == 0, i + 1 == len(x), 1.0] @ model["weights"]) for i in range(len(x))]
    t = np.asarray(model["trans"]).reshape(2, 2)
    own = [np.array([0.0, v]) for v in e]
    forward, backward = [own[0]], [np.zeros(2)]
    for v in own[1:]:
        forward.append(np.array([np.logaddexp(forward[-1][0] + t[0, y], forward[-1][1] + t[1, y]) + v[y] for y in (0, 1)]))
    for v in own[:0:-1]:
        backward.append(np.array([np.logaddexp(t[y, 0] + v[0] + backward[-1][0], t[y, 1] + v[1] + backward[-1][1]) for y in (0, 1)]))
    good = [1 / (1 + math.exp(min(700, (f + b)[0] - (f + b)[1]))) for f, b in zip(forward, backward[::-1])]
    return sum(p * (len(line) + 1) for p, line in zip(good, lines)) / sum(len(line) + 1 for line in lines)


@pytest.mark.parametrize("where", ["hard", "sf"])
def test_quality_matches_plain_loops(spark, sf_dir, where):
    path = sf_dir if where == "hard" else SF
    documents, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(documents, labels)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.op4_quality(spark, path).collect()))
    want = sorted((d is None, d or 0, brute_quality(model, t)) for d, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 1e-3


def test_training_takes_whole_texts_within_its_bound(spark):
    rows = [(i, "good words here. " * 5 if i % 2 else "#### $$$$ ||||\n" * 5, i % 2) for i in range(200)]
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    assert quality.train(documents, labels, train_bytes=0) is None
    few = quality.score(documents, quality.train(documents, labels, train_bytes=1000)).collect()
    assert np.mean([(r.score > 0.5) == (r.doc_id % 2 == 1) for r in few]) > 0.95


def test_very_long_texts(spark, tmp_path):
    """A text of some MB in one line and one in many lines, through every operator on documents."""
    rng = np.random.default_rng(8)
    words = np.array([f"word{i}" for i in range(2000)])
    rows = [(0, " ".join(rng.choice(words, 300_000)), "en", "a", 1), (1, "\n".join(rng.choice(words, 60_000)), "en", "a", 1), (2, "short", "en", "b", 5), (3, "y" * 200_000, "en", "b", 5)]
    spark.createDataFrame(rows, brute.DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert Counter(map(tuple, substrings.op3_substring_dedup(spark, str(tmp_path)).collect())) == Counter(brute.window_dedup([r[:2] for r in rows]))
    assert Counter(tuple(r)[:6] for r in secrets.op1_secret_scan(spark, str(tmp_path)).collect()) == Counter((r[0], *brute.secrets(r[1])) for r in rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = {r[0]: hashlib.sha256(np.array(library.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in rows}
    assert {r.doc_id: r.ids_sha256 for r in bpe.op6_bpe(spark, str(tmp_path)).collect()} == want
    for query in (quality.op4_quality, token_files.op5_token_files, resharding.op7_resharding, mixing.op8_mixing):
        assert query(spark, str(tmp_path)).count() == 4


def test_crafted_words_do_not_repeat(spark):
    """Two words that an unkeyed invertible hash takes for equal."""
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join([*words[:7], "yleposr", *words[8:]])), (2, " ".join([*words[:7], "`Dnga2f&", *words[8:]])), (3, " ".join([*words[:7], "yleposr", *words[8:]]))]
    out = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 0, 3: 20}


def test_quality_passes_over_long_texts(spark):
    """A document that would take all of the training bytes or lines by itself is passed over; the others still train."""
    good, bad = "A plain line of words that says something.\nAnother one follows it here.", "$$$ !!! |||\n$$$ !!! |||"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(100, "x y " * 300_000), (101, "\n" * 2_000_000), (102, "x" * 9_600_000)]
    labels = [(i, i % 2) for i in range(60)] + [(100, 1), (101, 0), (102, 1)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, marked)
    assert model is not None
    got = {r.doc_id: r.score for r in quality.score(docs.filter("doc_id < 60"), model).collect()}
    assert min(v for k, v in got.items() if k % 2) > 0.5 > max(v for k, v in got.items() if not k % 2)


def test_a_pair_that_is_twice_in_the_ledger_counts_once(spark, docs):
    ledger = scratch_path(spark, "test-ledger")
    secrets.scan_blobs(docs, ledger)
    secrets.read_ledger(spark, ledger).coalesce(1).write.mode("append").parquet(ledger)  # two runs at once
    assert secrets.find_secrets(docs.select("doc_id", "text"), ledger, ["doc_id"]).count() == docs.count()
    assert secrets.redact_documents(docs, ledger).count() == docs.count()
