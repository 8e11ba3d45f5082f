"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

The index is cut by documents: a shard holds the postings of some 8 MB of text, built where the text
is read, so building shuffles nothing. Within a shard documents are numbered by ascending id. A
term's postings are cut into blocks of ``BLOCK``; a block keeps its last document, its greatest impact (what a
posting adds to a score for a weight of 1) and its gaps and counts as variable-length bytes.

A query is searched in each shard on its own. The pointers' shallow moves are made for a stretch of
documents at once: the ends of all blocks of the query's terms cut the shard into intervals within
which the sum of the blocks' greatest contributions is fixed. In document order, intervals whose sum isn't
above the threshold (the k-th best score so far) are skipped with their blocks still packed; the
blocks that reach into the others are unpacked (once a shard, whatever the number of queries) and
scored, and the threshold rises. Equal scores go to the smaller id, which comes first, so what
equals the threshold is skipped rightly. The k best of each shard are merged.

Weights need the number of documents with a term over all shards: that is a sum over the index's rows of
the queries' terms. Queries meet shards in blocks of ``QUERY_BLOCK``, with the postings of their own
terms only.

Edge cases: null and empty texts, and texts without terms, have no terms and aren't counted; a null id is the
largest; of rows with equal ids each is a document of its own; an item that is there twice gets its
results twice; items without terms get none; very long texts are whole (a shard of their own, at
most); empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Words, arrow_batches, binary_array, gather, materialize, table, text_blocks

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUTSIDE = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 16
TEXT_BYTES = 1 << 20  # of a round of numpy work
BLOCK, QUERY_BLOCK, K = 128, 256, 10
STRIDE = 4  # intervals of a query's first stretch; each stretch is twice as long as the one before
#: Fixed values of the score.
SCALE, GROWTH, LENGTH, BASE, SHARE = 1_000_000_000, 1000, 8, 100, 90
#: ``term`` null: the shard's documents (df: their number, payload: ids, tops: length factors, lasts: which ids are null).
INDEX = "shard long, term string, df long, lasts binary, tops binary, sizes binary, payload binary"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def impacts(tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What a posting adds to a score for a weight of 1."""
    return (SCALE * tf) // (GROWTH * tf + LENGTH * factor)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as variable-length bytes (seven bits each, the lowest first), and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    place = gather(np.zeros(len(values), np.int64), size)
    out = np.repeat(values, size) >> 7 * place & 127
    out[np.flatnonzero(place < np.repeat(size, size) - 1)] |= 128
    return out.astype(np.uint8), size


def unpack(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.r_[0, end[:-1] + 1]
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * gather(np.zeros(len(end), np.int64), end - start + 1), start) if len(end) else np.zeros(0, np.int64)


def count_terms(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with at least one term, and of all their terms."""

    def run(batches):
        for batch in batches:
            docs = terms = 0
            for _, data, offsets in text_blocks(batch.column(0), TEXT_BYTES):
                counts = Words(data, offsets, _OUTSIDE).counts
                docs, terms = docs + int((counts > 0).sum()), terms + int(counts.sum())
            yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})

    row = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _shard_rows(shard: int, parts: list, n_docs: int, n_terms: int):
    """Index rows of one shard; ``parts`` are (ids, which are null, terms of each document, encoded terms) of blocks of texts."""
    ids, null, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    words = pa.chunked_array([p[3] for p in parts]).unify_dictionaries()
    term = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64)
    names = words.chunk(0).dictionary
    order = np.lexsort((ids, null))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    ids, null, doc = ids[order], null[order], np.repeat(rank, counts)
    factor = (BASE - SHARE) + (SHARE * counts[order] * n_docs) // n_terms
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([null.astype(np.uint8).tobytes()]), pa.array([factor.astype("<i8").tobytes()]), pa.array([b""]), pa.array([ids.astype("<i8").tobytes()])], names=_NAMES)
    pairs, tf = np.unique(term * len(ids) + doc, return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    df = np.bincount(term, minlength=len(names))
    first = np.cumsum(df) - df
    at = np.arange(len(term)) - first[term]
    begin = np.flatnonzero(at % BLOCK == 0)
    size = np.diff(np.r_[begin, len(term)])
    last = doc[begin + size - 1]
    top = np.maximum.reduceat(impacts(tf, factor[doc]), begin)
    gap = doc - np.where(at == 0, 0, np.r_[0, doc[:-1]] + 1)
    # a block's gaps, then its counts
    values = np.empty(2 * len(term), np.int64)
    shift = np.repeat(begin, size)
    values[np.arange(len(term)) + shift] = gap
    values[np.arange(len(term)) + shift + np.repeat(size, size)] = tf
    data, width = pack(values)
    bytes_to = np.r_[0, np.cumsum(width)]
    block_at = bytes_to[2 * np.r_[begin, len(term)]]
    blocks = np.r_[0, np.cumsum(-(-df // BLOCK))]  # of each term
    for a in range(0, len(names), 8192):
        b = min(a + 8192, len(names))
        i, j = blocks[a], blocks[b]
        near = blocks[a : b + 1] - i
        columns = [binary_array(x[i:j].astype(kind), near * np.dtype(kind).itemsize) for x, kind in ((last, "<i4"), (top, "<i8"), (np.diff(block_at), "<i4"))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard)), names.slice(a, b - a).cast(pa.string()), pa.array(df[a:b]), *columns, binary_array(data[block_at[i] : block_at[j]], block_at[blocks[a : b + 1]] - block_at[i])], names=_NAMES)


_NAMES = [x.split(" ")[0] for x in INDEX.split(", ")]


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text): a row for each shard and term, written to the shared folder."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_batches(docs.sparkSession, most_bytes=BATCH_BYTES):
        n_docs, n_terms = count_terms(slim)

    def run(batches):
        shard, parts, held, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for at, data, offsets in text_blocks(batch.column(1), TEXT_BYTES):
                words = Words(_LOWER[data], offsets, _OUTSIDE)
                some = np.flatnonzero(words.counts)
                if not len(some):
                    continue
                parts.append((ids[at + some], null[at + some], words.counts[some], words.encoded()))
                held, rows = held + len(data), rows + len(some)
                if held >= SHARD_BYTES or rows >= SHARD_DOCS:
                    yield from _shard_rows(shard, parts, n_docs, n_terms)
                    shard, parts, held, rows = shard + 1, [], 0, 0
        if parts:
            yield from _shard_rows(shard, parts, n_docs, n_terms)

    with arrow_batches(docs.sparkSession, most_bytes=BATCH_BYTES):
        return materialize(slim.mapInArrow(run, INDEX), "ranked-index")


class Shard:
    """Postings of the wanted terms of one shard; blocks are unpacked when they are first needed."""

    def __init__(self, rows: pa.Table):
        head = rows.filter(rows.column("term").is_null())
        rows = rows.filter(rows.column("term").is_valid()).combine_chunks()
        self.ids = np.frombuffer(head.column("payload")[0].as_py(), "<i8")
        self.factor = np.frombuffer(head.column("tops")[0].as_py(), "<i8")
        self.null = np.frombuffer(head.column("lasts")[0].as_py(), bool)
        self.row = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
        joined = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).astype(np.int64)
        self.last, self.top, size = joined("lasts", "<i4"), joined("tops", "<i8"), joined("sizes", "<i4")
        self.data = joined("payload", np.uint8).astype(np.uint8)
        df = rows.column("df").to_numpy().astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.blocks = -(-df // BLOCK)  # of each term
        self.first = np.cumsum(self.blocks) - self.blocks
        n = len(self.last)
        self.before = np.r_[-1, self.last[:-1]][:n]
        self.before[self.first] = -1
        self.length = np.full(n, BLOCK)
        self.length[self.first + self.blocks - 1] = df - BLOCK * (self.blocks - 1)
        self.at = np.cumsum(self.length) - self.length
        self.byte_at, self.byte_length = np.cumsum(size) - size, size
        self.doc, self.impact = np.zeros(int(df.sum()), np.int32), np.zeros(int(df.sum()), np.int64)
        self.open = np.zeros(n, bool)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        values = unpack(self.data[gather(self.byte_at[blocks], self.byte_length[blocks])])
        length = self.length[blocks]
        start = 2 * (np.cumsum(length) - length)
        step = values[gather(start, length)] + 1
        total = np.cumsum(step)
        begin = np.cumsum(length) - length
        doc = total - np.repeat(total[begin] - step[begin], length) + np.repeat(self.before[blocks], length)
        place = gather(self.at[blocks], length)
        self.doc[place] = doc
        self.impact[place] = impacts(values[gather(start + length, length)], self.factor[doc])
        self.open[blocks] = True

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the shard) and scores of the k best for the terms of ``rows``, the best first."""
        block = gather(self.first[rows], self.blocks[rows])
        weight = np.repeat(weights, self.blocks[rows])
        most = self.top[block] * weight
        cut = np.unique(np.r_[self.before[block] + 1, self.last[block] + 1])
        lo, hi = np.searchsorted(cut, self.before[block] + 1), np.searchsorted(cut, self.last[block] + 1)
        change = np.zeros(len(cut), np.int64)
        np.add.at(change, lo, most)
        np.subtract.at(change, hi, most)
        bound = np.cumsum(change)[:-1]
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        a, step = 0, STRIDE
        while a < len(bound):
            b = min(a + step, len(bound))
            live = bound[a:b] > least
            if live.any():
                seen = np.r_[0, np.cumsum(live)]
                need = np.flatnonzero(seen[np.clip(hi, a, b) - a] > seen[np.clip(lo, a, b) - a])
                self.unpack(block[need])
                at = gather(self.at[block[need]], self.length[block[need]])
                doc = self.doc[at] - cut[a]
                wanted = np.repeat(live, np.diff(cut[a : b + 1]))
                inside = np.flatnonzero((doc >= 0) & (doc < len(wanted)))
                inside = inside[wanted[doc[inside]]]
                # sums stay below 2**53, where doubles are exact
                score = np.bincount(doc[inside], (self.impact[at] * np.repeat(weight[need], self.length[block[need]]))[inside], len(wanted)).astype(np.int64)
                better = np.flatnonzero(score > least)
                if len(better) > k:
                    better = better[score[better] >= np.partition(score[better], -k)[-k]]
                docs, scores = np.r_[docs, better + cut[a]], np.r_[scores, score[better]]
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                least = int(scores[-1]) if len(scores) == k else 0
            a, step = b, 2 * step
        return docs, scores


def _search_tile(k: int):
    def run(rows: pa.Table) -> pa.Table:
        asked = rows.column("wanted").combine_chunks()
        asked = asked.filter(asked.is_valid()).flatten()
        rows = rows.filter(rows.column("df").is_valid())
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))]
        if len(asked) and len(rows):
            shard = Shard(rows.drop_columns(["wanted"]))
            q, w = asked.field("q").to_numpy(), asked.field("w").to_numpy()
            row = np.array([shard.row.get(t, -1) for t in asked.field("term").to_pylist()], np.int64)
            order = np.flatnonzero(row >= 0)
            order = order[np.argsort(q[order], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(q[order])) + 1) if len(order) else []:
                doc, score = shard.search(row[part], w[part], k)
                found.append((np.full(len(doc), q[part[0]]), shard.ids[doc], shard.null[doc], score))
        q, ids, null, score = (np.concatenate([f[i] for f in found]) for i in range(4))
        return pa.table([pa.array(q), pa.array(ids, mask=null), pa.array(score)], names=["q", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above 0."""
    shards = index.filter("term IS NULL")
    n_docs = shards.agg(F.sum("df")).first()[0] or 0
    asked = materialize(items.select(F.col(item_id).alias("item_id"), F.array_distinct(terms_of(F.col(text))).alias("terms")).withColumn("q", F.monotonically_increasing_id()), "ranked-items")
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    terms = asked.select("q", F.explode("terms").alias("term"))
    known = index.filter("term IS NOT NULL")
    # a term's rows, one a shard, are summed before they meet
    df = known.select("term", "df").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weights = df.select("term", w.alias("w")).filter("w > 0")
    wanted = terms.join(weights, "term").groupBy(F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int").alias("tile")).agg(F.collect_list(F.struct("q", "term", "w")).alias("wanted"))
    wanted = materialize(wanted, "ranked-queries")
    needed = wanted.select("tile", F.explode("wanted.term").alias("term")).distinct()
    # each query block gets the rows of its own terms, and the list of each shard's documents
    postings = known.join(needed, "term").select("shard", "tile", *_NAMES[1:], F.lit(None).cast(wanted.schema["wanted"].dataType).alias("wanted"))
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("tile")
    heads = shards.select("shard", every, *_NAMES[1:], F.lit(None).cast(wanted.schema["wanted"].dataType).alias("wanted"))
    asks = shards.select("shard", every).join(wanted, "tile").select("shard", "tile", *(F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields[1:]), "wanted")
    best = postings.unionByName(heads).unionByName(asks).groupBy("shard", "tile").applyInArrow(_search_tile(k), "q long, doc_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
