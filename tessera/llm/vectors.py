"""Searches over embeddings: exact top-k by inner product, and nearest neighbours by multi-index hashing.

Both deal vectors out in blocks of bounded size and send each block of queries to each block of
vectors: one task holds one pair of blocks, keeps the k best of each query there, and a second step
merges those. Nothing whole passes the driver, one task or one group. Each vector is sent once for
every ``QUERY_BLOCK`` queries; a pair of full blocks is about 10 MB and takes seconds to search,
so the search outweighs the shuffle at any size.

Edge cases, both: null vectors and vectors with null or non-finite components take no part (nor do
zero and empty vectors in the nearest-neighbour search); vectors of unequal length count as padded
with zeros; ids are taken as they are: a query leaves out its own row only, so another row with its id
is a candidate, and a row that is there m times finds the other m - 1; a repeated query row is searched
once and its result given for each copy; null ids take no part; an empty table gives an empty result;
extra columns are ignored; ties go to the smaller id. In the exact search scaled components are held
within 2**53 either way, and scores that leave 64 bits wrap around.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 16384  # vectors of a block
QUERY_BLOCK = 4096
ROWS = 64  # queries of one dense score array, so that it stays in a core's cache
LEAST_BLOCK = 1024  # small tables are cut further, so that all cores have work
K_EXACT, SCALE = 20, 64.0
LARGEST = 2.0**53  # of a scaled component
#: Hashing: bits of a code, substrings of it, and the bounds of the sample that rotation and radius are fitted on.
BITS, SUBSTRINGS, SAMPLE, SAMPLE_QUERIES, K_NEAR, TARGET_RECALL = 64, 8, 20_000, 200, 10, 0.97


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, v): finite vectors; those without any component other than 0 only if ``zero``."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.lit(True) if zero else F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite & some).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter rows are padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def blocked_search(vectors: DataFrame, queries: DataFrame, k: int, index: Callable, score: str, best_first_desc: bool) -> DataFrame:
    """``index(ids, X)`` of a block of vectors gives ``search(Q, own)``, which gives (query row, id, score); the k best of each query stay.

    ``vectors`` and ``queries`` are (id, v); ``own`` is the place of each query's own row in the block, or -1.
    """
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    cores = 2 * spark.sparkContext.defaultParallelism
    blocks, query_blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), cores)), max(1, -(-m // QUERY_BLOCK))
    tile = lambda a, b: F.struct(a.alias("b"), b.alias("q"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")
    # a row number is only a name: rows of one name are equal rows, which lie in one block
    name = F.xxhash64("id", "v").alias("row")
    vec = vectors.select(F.lit(0).alias("side"), "id", name, F.lit(0).cast("long").alias("copies"), "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda q: tile(block, q))).alias("tile"))
    # equal query rows are searched once and their result is given for each copy
    queries = queries.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    qs = queries.select(F.lit(1).alias("side"), "id", name, "copies", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: tile(b, query_block))).alias("tile"))
    names = ["query_id", "row", "copies", "vec_id", "score"]
    kind = pa.int64() if score == "int64" else pa.float64()

    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("side").to_numpy() == 1
        parts = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, score),)]
        if is_query.any() and not is_query.all():
            x = _matrix(table.column("v"))
            ids, rows, copies = (table.column(c).to_numpy() for c in ("id", "row", "copies"))
            order = np.lexsort((rows[~is_query], ids[~is_query]))
            cand_ids, cand_rows, cands = ids[~is_query][order], rows[~is_query][order], x[~is_query][order]
            by_row = np.argsort(cand_rows, kind="stable")
            q_ids, q_rows, q_copies, q = ids[is_query], rows[is_query], copies[is_query], x[is_query]
            at = np.minimum(np.searchsorted(cand_rows[by_row], q_rows), len(by_row) - 1)
            own = np.where((cand_rows[by_row[at]] == q_rows) & (cand_ids[by_row[at]] == q_ids), by_row[at], -1)  # the first of equal rows
            search = index(cand_ids, cands)
            for a in range(0, len(q), ROWS):
                at, found, scores = search(q[a : a + ROWS], own[a : a + ROWS])
                parts.append((q_ids[a + at], q_rows[a + at], q_copies[a + at], found, scores))
        columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], kind)], names=names)

    best = vec.unionByName(qs).groupBy("tile").applyInArrow(run, f"query_id long, row long, copies long, vec_id long, score {'long' if score == 'int64' else 'double'}")
    order = F.col("score").desc() if best_first_desc else F.col("score").asc()
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy(order, F.col("vec_id"))))
    best = ranked.filter(F.col("rank") <= k)
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def accumulate_scores(q: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Term at a time: each term's weighted postings are scattered into the dense score array of every query row that has the term."""
    scores = np.zeros((len(q), n), q.dtype)
    for term, (at, weights) in enumerate(postings):
        rows = np.flatnonzero(q[:, term])
        if not len(rows) or not len(at):
            continue
        if len(at) * 2 >= n:  # most of the block has the term: one dense posting list
            dense = np.zeros(n, q.dtype)
            dense[at] = weights
            if len(rows) == len(q):
                scores += q[:, term, None] * dense
            else:
                scores[rows] += q[rows, term, None] * dense
        else:
            scores[np.ix_(rows, at)] += q[rows, term, None] * weights
    return scores


def top_k_exact(vectors: DataFrame, queries: DataFrame, k: int = K_EXACT, scale: float = SCALE) -> DataFrame:
    """Exhaustive top-k by the inner product of ``floor(scale * x)``; ``vectors`` and ``queries`` are (id, v)."""

    def index(ids, x):
        x = np.clip(np.floor(x * scale), -LARGEST, LARGEST)
        most = np.abs(x).max(initial=0) * max(1, x.shape[1])
        posted = {}

        def postings(kind):
            if kind not in posted:
                whole = x.astype(kind)
                posted[kind] = [(at := np.flatnonzero(whole[:, t]), whole[at, t]) for t in range(x.shape[1])]
            return posted[kind]

        def search(q, own):
            q = np.clip(np.floor(q * scale), -LARGEST, LARGEST)
            kind = np.int64 if np.abs(q).max(initial=0) * most >= 2**31 else np.int32
            scores = accumulate_scores(q.astype(kind), postings(kind), len(ids))
            mine = np.flatnonzero(own >= 0)
            scores[mine, own[mine]] = np.iinfo(kind).min
            taken = np.ones(scores.shape, bool)
            taken[mine, own[mine]] = False
            keep = min(k, scores.shape[1])
            # the keep-th score of each row; all above it, and of those equal to it the smallest ids
            edge = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
            above, level = scores > edge[:, None], (scores == edge[:, None]) & taken
            need = keep - above.sum(1)
            level &= np.cumsum(level, axis=1) <= need[:, None]
            at, found = np.nonzero(above | level)
            return at, ids[found], scores[at, found].astype(np.int64)

        return search

    return blocked_search(vectors, queries, k, index, "int64", True)


def fit_codes(sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of learned rotated binary codes: principal directions, turned so that signs lose least (alternating sign and Procrustes steps)."""
    mean = sample.mean(0)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred, full_matrices=False)
    rng = np.random.default_rng(seed)
    basis = directions.T
    if basis.shape[1] < bits:  # more bits than directions: further random ones
        basis = np.hstack([basis, rng.normal(size=(sample.shape[1], bits - basis.shape[1]))])
    low = centred @ basis[:, :bits]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ w).T
    return mean, basis[:, :bits] @ turn


def code_bytes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(rows, substrings) bytes: each byte is one substring of the code."""
    return np.packbits((x - mean) @ projection > 0, axis=1)


_BITS_SET = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fit_index(sample: np.ndarray, k: int = K_NEAR, recall: float = TARGET_RECALL) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes fitted on the sample, and the Hamming radius that holds ``recall`` of its own nearest neighbours."""
    mean, projection = fit_codes(sample)
    codes = code_bytes(sample, mean, projection)
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    distances = (queries**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * queries @ sample.T
    nearest = np.argsort(distances, axis=1, kind="stable")[:, 1 : k + 1]
    query_codes = code_bytes(queries, mean, projection)
    apart = _BITS_SET[query_codes[:, None, :] ^ codes[nearest]].sum(2)
    return mean, projection, int(np.quantile(apart, recall)) if apart.size else BITS


def probe(codes: np.ndarray, query: np.ndarray, radius: int, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows with a code within ``radius`` of ``query``: by the pigeonhole principle one substring differs in at most ``radius // substrings`` bits, so the lists of all such values are read, and what they hold is checked."""
    each = radius // len(tables)
    hit = np.zeros(len(codes), bool)
    values = np.arange(256, dtype=np.uint8)
    for s, (order, bounds) in enumerate(tables):
        near = np.flatnonzero(_BITS_SET[values ^ query[s]] <= each)
        for v in near:
            hit[order[bounds[v] : bounds[v + 1]]] = True
    rows = np.flatnonzero(hit)
    apart = _BITS_SET[codes[rows] ^ query].sum(1)
    return rows[apart <= radius]


def nearest_by_hashing(vectors: DataFrame, queries: DataFrame, k: int = K_NEAR, sample: int = SAMPLE, radius: int | None = None) -> DataFrame:
    """The k nearest (Euclidean) among all vectors whose codes lie within a Hamming radius of the query's.

    Rotation and radius are fitted on at most ``sample`` vectors (those with the smallest id hashes);
    every vector is indexed. A block that holds fewer than k codes within the radius widens it for
    that query until it has k, so no query comes back short.
    """
    rows = vectors.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).select("v").collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(len(r[0]) for r in rows)
    fit = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        fit[i, : len(r[0])] = r[0]
    mean, projection, fitted = fit_index(fit, k)
    bound = fitted if radius is None else radius

    def codes_of(a):
        a = a[:, :width] if a.shape[1] >= width else np.hstack([a, np.zeros((len(a), width - a.shape[1]))])
        return code_bytes(a, mean, projection)

    def index(ids, x):
        codes = codes_of(x)
        tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            tables.append((order, np.searchsorted(codes[order, s], np.arange(257))))

        def search(q, own):
            query_codes = codes_of(q)
            at, found, scores = [], [], []
            for i in range(len(q)):
                r = bound
                while True:
                    near = probe(codes, query_codes[i], r, tables)
                    near = near[near != own[i]]
                    if len(near) >= k or r >= 8 * codes.shape[1]:
                        break
                    r += len(tables)
                d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[near], d))[:k]
                at.append(np.full(len(best), i))
                found.append(ids[near][best])
                scores.append(d[best])
            return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

        return search

    return blocked_search(vectors, queries, k, index, "float64", False)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=True)
    out = top_k_exact(vectors, vectors.filter(F.col("id") % 20 == 0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False)
    out = nearest_by_hashing(vectors, vectors.filter(F.col("id") % 100 == 0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
