"""Near-duplicates: improved consistent weighted sampling over TF-IDF word shingles, banded, verified.

Shingles are five consecutive words (a shorter text is one shingle). A shingle weighs tf * idf with
idf = 1 + ln(N / df) / ln(1 / RARE), which is 1 for a shingle that all N documents hold and 2 from a
share of ``RARE`` of them down (it stays 2 for rarer ones). So df is needed only above that share:
one pass names all shingles that may reach it (a shingle that ``RARE / 2`` of no run of ``CHUNK``
documents hold doesn't, nor one whose sum over such runs is less than ``RARE / 2`` of all), and a second
pass counts those in all documents. At most 2 * (shingles of a mean document) / RARE can be named,
whatever the input; that table goes to the tasks.

1. Equal texts are one node, addressed by their SHA-256. Each node gets ``SAMPLES`` consistent samples
   in bands of ``ROWS``, and one byte of each sample as a sketch.
2. In every bucket of a band, all members are paired with its least and its greatest node: rows stay
   linear in the members. Sketches drop pairs far below the threshold, and pairs within one component
   are not needed. What is left is verified on whole texts: weighted Jaccard similarity of 0.8 or more.
   Each node is verified against its likeliest centre first, then the pairs that still join two components.
3. The exact rest: in buckets that still hold several components all pairs of members in different
   components have their sketches compared, block by block inside the tasks; members with a near
   enough partner meet again with their texts, and the pairs are verified inside the task too, where
   pairs that earlier links have joined are left out. Only members and links leave a task, never pairs,
   so rows stay linear. Each pair of nodes that share a bucket is tested or lies within one component.
4. Components by label propagation with pointer jumping.

Counts and samples take 64-bit hashes of words; where two texts are verified their shingles are told apart by 128 bits of BLAKE2b of
their words besides, so texts that were made to have equal hashes are candidates and no more.

Sketches work on weights rounded to steps of 1/8 in the logarithm, which moves a similarity of 0.8 to
0.779 at worst: 62 of 80 samples are expected to be equal, ``LEAST_EQUAL`` is five standard deviations
below. Verification takes the weights as they are.

Result: one row for each row of the input with its class (least id of it).

Edge cases: null text counts as empty; texts without words are near-duplicates of equal texts only;
equal rows are rows of one class; null ids are ignored for the class name (null if there is no
other); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Words, arrow_batches, binary_array, drop_scratch, gather, materialize, mix, pair_hash, table, text_blocks

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
LEAST_EQUAL = 43
RARE, CHUNK = 0.01, 1000
REST_BLOCK, REST_SHINGLES = 1024, 1 << 19  # members and shingles of a block of a bucket
REST_PAIRS = 1 << 17  # pairs looked at at once
PORTION_BYTES = 1 << 20  # text taken at once: a text's shingles take some thirty times its bytes while they are made
BROADCAST_NODES = 100_000  # 32 bytes each
SALTS = 8  # tasks for the rows of one class or of one text
STEPS = 8  # weights are rounded to whole steps of 1/8 in their logarithm
LEVELS = 128
_DRAWS = 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a block: (row, hash, count), by row and hash. With ``exact`` (verification) ``hash`` is (3, shingles): the same, then 128 bits of a cryptographic hash."""
    words = Words(data, offsets)
    h = words.hashes()[None]
    if exact:
        h = np.concatenate([h, words.digests()])
    n = h.shape[1]
    doc = np.repeat(np.arange(len(offsets) - 1), words.counts)
    if n >= SHINGLE:
        two = pair_hash(h[:, :-1], h[:, 1:])
        five = pair_hash(pair_hash(two[:, :-3], two[:, 2:-1]), h[:, 4:])
        at = np.flatnonzero(doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :])
        row, value = doc[at], five[:, at]
    else:
        row, value = np.zeros(0, np.int64), np.zeros((len(h), 0), np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        x = np.tile(words.counts[short].astype(np.uint64), (len(h), 1))
        for k in range(SHINGLE - 1):
            more = words.counts[short] > k
            x[:, more] = pair_hash(x[:, more], h[:, words.first_word[short[more]] + k])
        row, value = np.r_[row, short], np.concatenate([value, x], 1)
    order = np.lexsort((*value[::-1], row))
    row, value = row[order], value[:, order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[:, 1:] != value[:, :-1]).any(0)]) if len(row) else np.zeros(0, np.int64)
    return row[first], value[:, first] if exact else value[0, first], np.diff(np.r_[first, len(row)])


def _chunk_counts(named: np.ndarray | None):
    """(shingle, documents) of a chunk of documents, and (null, documents) for the chunk: of the ``named`` shingles (sorted), or of those that at least RARE / 2 of the chunk hold."""

    def report(parts, n):
        value, held = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        wanted = held >= RARE / 2 * n if named is None else held > 0
        return pa.RecordBatch.from_arrays([pa.array([None, *value[wanted].view(np.int64).tolist()], pa.int64()), pa.array([n, *held[wanted].tolist()], pa.int64())], names=["shingle", "n"])

    def run(batches):
        parts, n, size = [], 0, 0
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0), PORTION_BYTES):
                value = shingles(data, offsets)[1]
                if named is not None and len(value):
                    value = value[named[np.minimum(np.searchsorted(named, value), len(named) - 1)] == value]
                parts.append(value)
                n, size = n + len(offsets) - 1, size + len(value)
                if n >= CHUNK and (named is None or size >= 1 << 20):
                    yield report(parts, n)
                    parts, n, size = [], 0, 0
        if n:
            yield report(parts, n)

    return run


class Weights:
    """tf * idf of shingles: a sorted table of the frequent ones, idf 2 for all others."""

    def __init__(self, frequent: np.ndarray, held: np.ndarray, documents: int):
        order = np.argsort(frequent)
        self.frequent = frequent[order]
        share = np.log(documents / np.maximum(held[order], 1)) / math.log(1 / RARE) if documents else np.zeros(len(order))
        self.idf = 1 + np.clip(share, 0, 1)

    def exact(self, value: np.ndarray, count: np.ndarray) -> np.ndarray:
        idf = np.full(len(value), 2.0)
        if len(self.frequent) and len(value):
            at = np.minimum(np.searchsorted(self.frequent, value), len(self.frequent) - 1)
            found = self.frequent[at] == value
            idf[found] = self.idf[at[found]]
        return count * idf

    def levels(self, value: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(STEPS * np.log(self.exact(value, count))), 0, LEVELS - 1).astype(np.int64)


def weigh(texts: DataFrame) -> Weights:
    """Weights for all texts of a column ``text``; the shingles that may be frequent are few by their definition and are gathered."""
    count = lambda named: materialize(texts.select("text").mapInArrow(_chunk_counts(named), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts")
    first = count(None)
    documents = first.filter("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    named = first.filter(F.col("shingle").isNotNull() & (F.col("n") >= RARE / 2 * documents)).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
    drop_scratch(first)
    if not len(named):
        return Weights(named, np.zeros(0), documents)
    second = count(np.sort(named))
    exact = second.filter(F.col("shingle").isNotNull() & (F.col("n") > RARE * documents)).toPandas()
    drop_scratch(second)
    return Weights(exact["shingle"].to_numpy(np.int64).view(np.uint64), exact["n"].to_numpy(np.float64), documents)


class Sampler:
    """Improved consistent weighted sampling: for sample j and shingle k, gamma draws r and c and a uniform b give
    t = floor(log(w) / r + b) and a = c / exp(r * (t - b + 1)); the shingle with the least a is sampled, with its t.

    Draws come from a table that the hash of (j, k) points into; for weights on a grid, log(a) and t are tables too.
    """

    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        r, c, b = rng.gamma(2, 1, _DRAWS), rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS)
        self.t, self.log_a = np.empty((LEVELS, _DRAWS), np.int16), np.empty((LEVELS, _DRAWS), np.float32)
        for level in range(LEVELS):  # a row at a time, since the whole tables in double precision would be several times as large
            self.t[level] = np.floor(level / STEPS / r + b)
            self.log_a[level] = np.log(c) - r * (self.t[level] - b + 1)
        self.t, self.log_a = self.t.ravel(), self.log_a.ravel()
        self.turn = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def sample(self, begins: np.ndarray, value: np.ndarray, level: np.ndarray) -> np.ndarray:
        """(documents, SAMPLES) hashes of the sampled (shingle, t); every document has a shingle."""
        lengths = np.diff(np.r_[begins, len(value)])
        base = level * _DRAWS
        out = np.empty((len(begins), SAMPLES), np.uint64)
        for j in range(SAMPLES):
            at = base + (value * self.turn[j] >> np.uint64(48)).astype(np.int64)
            a = self.log_a[at]
            least = np.minimum.reduceat(a, begins)
            hit = np.flatnonzero(a == np.repeat(least, lengths))
            name = value[hit] + self.t[at[hit]].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            doc = np.searchsorted(begins, hit, side="right") - 1
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            out[:, j] = mix(np.minimum.reduceat(name, first) ^ self.turn[j])
        return out


_SAMPLER: list[Sampler] = []


def _signatures(weights: Weights):
    def run(batches):
        if not _SAMPLER:
            _SAMPLER.append(Sampler())
        for batch in batches:
            nodes = batch.column(0)
            for at, data, offsets in text_blocks(batch.column(1), PORTION_BYTES):
                row, value, count = shingles(data, offsets)
                if not len(row):
                    continue
                begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sig = _SAMPLER[0].sample(begins, value, weights.levels(value, count))
                bands = []
                for b in range(BANDS):
                    h = np.full(len(sig), b + 1, np.uint64)
                    for j in range(ROWS):
                        h = pair_hash(h, sig[:, b * ROWS + j])
                    bands.append(h)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * BANDS, pa.int32()), pa.array(np.stack(bands, 1).ravel().view(np.int64)))
                sketch = binary_array((sig & np.uint64(255)).astype(np.uint8), np.arange(len(sig) + 1) * SAMPLES)
                held = pa.array(np.diff(np.r_[begins, len(row)]), pa.int64())
                yield pa.RecordBatch.from_arrays([nodes.slice(at, len(offsets) - 1).take(pa.array(row[begins])), keys, sketch, held], names=["node", "bands", "sketch", "held"])

    return run


def _equal_samples(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, SAMPLES) for c in ("sketch_a", "sketch_b"))
        equal = (a == b).sum(1)
        rows = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("centre", "node")] + [pa.array(equal, pa.int32())], names=["centre", "node", "equal"])
        yield rows.filter(pa.array(equal >= LEAST_EQUAL))


def _near_pairs(t: pa.Table, tile: np.ndarray):
    """Pairs (a, b) of rows of one tile (rows stand by tile) in different components whose sketches are near enough; what a bucket's ends were paired with was looked at before."""
    i, j, block, end = (t.column(c).to_numpy() for c in ("i", "j", "block", "end"))
    comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SAMPLES)
    n = len(tile)
    last = np.flatnonzero(np.r_[tile[1:] != tile[:-1], True])
    later = last[np.searchsorted(last, np.arange(n))] - np.arange(n)  # members after each in its tile
    before = np.r_[0, np.cumsum(later)]
    at = 0
    while at < n:
        upto = min(n, max(at + 1, int(np.searchsorted(before, before[at] + REST_PAIRS, side="right")) - 1))
        a, b = np.repeat(np.arange(at, upto), later[at:upto]), gather(np.arange(at, upto) + 1, later[at:upto])
        # pairs within one block belong to the tile of that block with itself
        wanted = (comp[a] != comp[b]) & ~(end[a] | end[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
        a, b = a[wanted], b[wanted]
        near = (sketch[a] == sketch[b]).sum(1) >= LEAST_EQUAL
        yield a[near], b[near]
        at = upto


def _tiles(batches):
    """Whole tiles as tables with the tile's number by row; rows come sorted by (band, i, j)."""
    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if kept is None else pa.concat_tables([kept, t])
        if not t.num_rows:
            continue
        keys = [t.column(c).to_numpy() for c in ("band", "i", "j")]
        first = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
        whole = int(np.flatnonzero(first)[-1])
        if whole:
            yield t.slice(0, whole), np.cumsum(first[:whole])
        kept = t.slice(whole)  # the last tile may go on
    if kept is not None and kept.num_rows:
        yield kept, np.zeros(kept.num_rows, np.int64)


def _portions(batches, most: int):
    """Whole tiles as ``_tiles``, of at most ``most`` bytes of text at once (one tile at least)."""
    for t, tile in _tiles(batches):
        size = np.r_[0, np.cumsum(pc.binary_length(t.column("text")).to_numpy())]
        begins = np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
        at = 0
        while at < len(begins) - 1:
            upto = max(at + 1, int(np.searchsorted(size[begins], size[begins[at]] + most, side="right")) - 1)
            yield t.slice(begins[at], begins[upto] - begins[at]), tile[begins[at] : begins[upto]]
            at = upto


def _rest_members(batches):
    """The rows of each tile that have a near enough partner in it."""
    for t, tile in _tiles(batches):
        hit = np.zeros(t.num_rows, bool)
        for a, b in _near_pairs(t, tile):
            hit[a] = hit[b] = True
        yield from t.filter(pa.array(hit)).to_batches()


def _rest_links(weights: Weights, threshold: float):
    """Of each tile (with texts) links (a, b) that join its components as all its similar pairs do."""

    def run(batches):
        for t, tile in _portions(batches, PORTION_BYTES):
            got = [(row + at, value, count) for at, data, offsets in text_blocks(t.column("text"), PORTION_BYTES) for row, value, count in [shingles(data, offsets, True)]]
            row, value, count = (np.concatenate([g[k] for g in got], -1) for k in range(3))
            w = weights.exact(value[0], count)
            order = np.lexsort(value[::-1])
            key = np.empty(len(row), np.int64)
            key[order] = np.cumsum(np.r_[0, (np.diff(value[:, order]) != 0).any(0)])[: len(row)]
            starts = np.searchsorted(row, np.arange(t.num_rows + 1))
            lengths, total = np.diff(starts), np.bincount(row, w, t.num_rows)
            of_a = np.zeros(int(key.max(initial=0)) + 1)
            comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
            up = list(range(int(comp.max()) + 1))

            def root(c):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            links = []
            for left, right in _near_pairs(t, tile):
                for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(left)) + 1):
                    if not len(part):
                        continue
                    a, own = left[part[0]], root(comp[left[part[0]]])
                    b = right[part][[root(c) != own for c in comp[right[part]].tolist()]]
                    mine = slice(starts[a], starts[a + 1])
                    of_a[key[mine]] = w[mine]
                    at, pair = gather(starts[b], lengths[b]), np.repeat(np.arange(len(b)), lengths[b])
                    shared = np.bincount(pair, np.minimum(of_a[key[at]], w[at]), len(b))
                    of_a[key[mine]] = 0
                    for other in b[shared / np.maximum(total[a] + total[b] - shared, 1e-300) >= threshold - 1e-12].tolist():
                        if root(comp[a]) != root(comp[other]):
                            up[root(comp[other])] = root(comp[a])
                            links.append((a, other))
            node = t.column("node").combine_chunks()
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(pairs[:, 0])), node.take(pa.array(pairs[:, 1]))], names=["a", "b"])

    return run


def _verify(weights: Weights, threshold: float):
    def run(batches):
        for batch in batches:
            size = np.cumsum(sum(pc.binary_length(batch.column(batch.schema.get_field_index(c))).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text_a", "text_b")))
            cuts = np.unique(np.r_[0, np.searchsorted(size, np.arange(PORTION_BYTES, int(size[-1]) if len(size) else 0, PORTION_BYTES)), batch.num_rows])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                n = part.num_rows
                sides = []
                for c in ("text_a", "text_b"):
                    got = [(row + at, value, count) for at, data, offsets in text_blocks(part.column(part.schema.get_field_index(c))) for row, value, count in [shingles(data, offsets, True)]]
                    sides += got
                row, value, count = (np.concatenate([g[i] for g in sides], -1) for i in range(3))
                w = weights.exact(value[0], count)
                order = np.lexsort((*value[::-1], row))
                row, value, w = row[order], value[:, order], w[order]
                both = np.flatnonzero((row[1:] == row[:-1]) & (value[:, 1:] == value[:, :-1]).all(0))
                shared = np.bincount(row[both], np.minimum(w[both], w[both + 1]), n)
                total = np.bincount(row, w, n)
                near = shared / np.maximum(total - shared, 1e-300)
                yield part.filter(pa.array(near >= threshold - 1e-12)).select(["a", "b"])

    return run


def node_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (node, comp; nodes without a row are their own) after the links of ``edges`` (a, b): materialized.

    Each round every component takes the least name among itself and its neighbours, then the name of
    that one's name; it ends when a round changes nothing.
    """
    of = lambda df, c: df.join(labels.withColumnsRenamed({"node": c, "comp": f"_{c}"}), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    links = of(of(edges, "a"), "b").filter("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    links = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    name = materialize(links.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("comp")), "names")
    while True:
        near = links.join(name.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        step = name.join(near, "node").select("node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        jumped = step.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("_next")), "comp", "left")
        new = materialize(jumped.select("node", "_old", F.least("comp", F.coalesce("_next", "comp")).alias("comp")), "names")
        ended = new.filter("_old != comp").isEmpty()
        drop_scratch(name)
        name = new
        if ended:
            break
    moved = labels.join(name.select(F.col("node").alias("comp"), F.col("comp").alias("_new")), "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp"))
    fresh = name.join(labels, "node", "left_anti").select("node", "comp")
    out = materialize(moved.unionByName(fresh), "labels")
    drop_scratch(name, links)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(node, comp) of the nodes that have near-duplicates among other texts, and verified links (a, b) between different texts that make those components: materialized."""
    with arrow_batches(docs.sparkSession, most_bytes=BATCH_BYTES):  # a pair's row holds two texts
        return _near_duplicates(docs, text, threshold)


def _near_duplicates(docs: DataFrame, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows = docs.select(node_of(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    weights = weigh(rows)
    signed = rows.mapInArrow(_signatures(weights), "node binary, bands array<long>, sketch binary, held long")
    signed = materialize(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("held").alias("held")), "signatures")
    # only buckets with two members or more can link
    members = signed.select("node", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    buckets = materialize(members.join(crowded, "band"), "buckets")
    sketch = signed.select("node", "sketch")
    # empty ones, which an empty list would make in Python workers of their own
    labels = sketch.filter(F.lit(False)).select("node", F.col("node").alias("comp"))
    links = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))

    def starred() -> DataFrame:
        """(centre, node, equal) of the pairs of members with their buckets' ends whose sketches are near enough."""
        ends = buckets.groupBy("band").agg(F.array(F.min("node"), F.max("node")).alias("_c")).select("band", F.explode("_c").alias("centre"))
        pairs = buckets.join(ends, "band").filter(F.col("node") != F.col("centre")).select("centre", "node").distinct()
        pairs = pairs.join(sketch.withColumnRenamed("sketch", "sketch_b"), "node").join(sketch.withColumnsRenamed({"node": "centre", "sketch": "sketch_a"}), "centre")
        return materialize(pairs.mapInArrow(_equal_samples, "centre binary, node binary, equal int"), "pairs")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of a materialized list of nodes: by a broadcast of the list if it is short, else by shuffle."""
        wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
        return rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar by their texts."""
        nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
        texts = texts_of(nodes)
        both = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
        out = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(weights, threshold), "a binary, b binary"), "verified")
        drop_scratch(nodes, pairs)
        return out

    def apart(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose ends lie in different components."""
        side = lambda c: labels.withColumnsRenamed({"node": c, "comp": f"_{c}"})
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")

    def rest() -> DataFrame:
        """Links (a, b) among all pairs of a bucket in different components, without those that the bucket's ends have. A bucket of three members has no such pair."""
        here = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = here.groupBy("band").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most"), F.min("node").alias("_low"), F.max("node").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_least != _most AND _n > 3")
        here = here.join(several.select("band", "_low", "_high", "_n"), "band").join(signed.select("node", "sketch", "held"), "node")
        known = here = materialize(here.select("band", "node", "comp", "sketch", "held", "_n", F.col("node").isin(F.col("_low"), F.col("_high")).alias("end")), "rest")
        if here.isEmpty():
            return links
        bulk = here.groupBy("band").agg(F.ceil(F.greatest(F.max("_n") / REST_BLOCK, F.sum("held") / REST_SHINGLES)).cast("int").alias("_blocks"))
        here = here.drop("_n").join(bulk, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        tiles = here.select("band", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "node", "comp", "sketch", "end")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda df: df.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
        near = materialize(dealt(tiles).mapInArrow(_rest_members, tiles.schema), "near")
        drop_scratch(known)
        if near.isEmpty():
            return links
        nodes = materialize(near.select("node").distinct(), "nodes")
        out = materialize(dealt(near.join(texts_of(nodes), "node")).mapInArrow(_rest_links(weights, threshold), "a binary, b binary"), "verified")
        drop_scratch(nodes, near)
        return out

    ordered = lambda df: df.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pending = starred()
    if not pending.isEmpty():
        # each node against its likeliest centre; that joins most of what belongs together, so few pairs are left to look at
        best = pending.groupBy("node").agg(F.max_by("centre", F.struct("equal", "centre")).alias("centre"))
        links = verified(materialize(ordered(best), "best"))
        labels = components(links, labels)
        left = materialize(apart(ordered(pending)), "left")
        if not left.isEmpty():
            near = verified(left)
            links = links.unionByName(near)
            labels = components(near, labels)
    drop_scratch(pending)
    near = rest()
    if near is not links and not near.isEmpty():
        links = links.unionByName(near)
        labels = components(near, labels)
    drop_scratch(signed, buckets)
    return labels, links


def _salted(rows: DataFrame, few: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``rows`` left joined with ``few`` (one row for each ``key``), where a key may hold a third of all rows: those are dealt over SALTS tasks, and each of the few goes to all of them."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_id, class_size, class_node): one row for each row of ``docs``."""
    labels, _ = near_duplicates(docs, text, threshold)
    rows = docs.select(F.col(id_col).alias("doc_id"), node_of(F.col(text)).alias("node"))
    joined = materialize(_salted(rows, labels, "node", ["doc_id"]).select("doc_id", "node", F.coalesce("comp", "node").alias("comp")), "classes")
    # classes of one row need no second look
    several = joined.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    found = _salted(joined, several, "comp", ["doc_id", "node"])
    return found.select("doc_id", "node", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("comp").alias("class_node"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that with the least id (null last), of equal ids the first text hash. Same columns."""
    cols = docs.columns
    labels, _ = near_duplicates(docs, "text", threshold)
    rows = docs.withColumn("_node", node_of(F.col("text")))
    joined = _salted(rows.select("doc_id", F.col("_node").alias("node")), labels, "node", ["doc_id"]).withColumn("_comp", F.coalesce("comp", "node"))
    copies = joined.groupBy("_comp", "doc_id", "node").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    first = copies.groupBy("_comp").agg(F.min_by(F.struct("doc_id", "node", "_n"), order).alias("_first"))
    first = materialize(first.select(F.col("_first.doc_id").alias("_id"), F.col("_first.node").alias("_of"), F.col("_first._n").alias("_n")), "firsts")
    kept = rows.join(first.select("_id", "_of"), (F.col("_node") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    if not first.filter("_n > 1").isEmpty():  # rows equal in id and text
        kept = kept.dropDuplicates(["doc_id", "_node"])
    return kept.select(*cols)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
