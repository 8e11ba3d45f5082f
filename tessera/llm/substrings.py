"""Substring dedup: repeated windows of words, from suffix trees that are partitioned by prefix.

Only suffixes that start at anchors are put into trees (a sparse suffix tree). Each window of
``WIDTH`` words holds one anchor: its place with the least hash of ``PREFIX`` consecutive words, the
leftmost of equals. Equal windows have their anchor at the same offset, so the two suffixes that
start at the anchors share their first words, and it is enough to bring together suffixes with
equal prefixes. An anchor serves a run of consecutive windows and stands for all of them, which
makes about an eighth as many suffixes as there are words.

1. Map side, per block of documents: anchors, and the path hash of every window. Of windows that
   are equal within the block only the earliest goes on; the others are already known as repeats.
   So a window that a third of all documents share leaves each block once.
2. Suffixes are dealt by a prefix of variable length, so that groups stay near ``GROUP_BYTES`` of
   text. A first pass counts: in any block that has its share of a frequent prefix it is seen as
   frequent, and sums over blocks give the list of those above ``1 / groups`` of all suffixes
   (at most ``MAX_FREQUENT``, whatever the input). A frequent prefix is extended to the whole
   window: its windows are dealt one by one, by their path hash.
3. In a group, suffixes are sorted by prefix; a subtree has an internal node only where two share
   it. Below, windows are sorted by path hash: equal ones are a node at depth WIDTH, with its
   earliest window as the kept one.
4. What repeats (runs of window starts) goes back to its document, and the words are removed there.

A subtree is held as sorted path hashes, not as linked nodes: windows are compared by 64 bits for the
prefix and 40 more for the whole window. Both come from 64-bit hashes of words whose keys (eight kilobytes of SHAKE-128 of a
secret) each run draws anew, so no text can be made to look like another one; the result doesn't depend on them. Consecutive repeated windows of a document make one run, which
is a maximal repeat.

Edge cases: null text has no words; null ids come before all others (as an id of -2**63 does); documents of under WIDTH words
keep all; rows with an equal id are copies of one document's place: a window starts earlier only by
a smaller id or an earlier start, so such rows don't remove each other's words at the same start;
an empty table gives an empty result; extra columns are ignored; texts of any length are handled.
"""

from __future__ import annotations

from secrets import token_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Words, arrow_batches, binary_array, drop_scratch, gather, materialize, mix, pair_hash, secret_lanes, table, text_blocks

WIDTH, PREFIX = 20, 5
GROUP_BYTES = 4 << 20  # text whose suffixes make one group
BLOCK = 2 << 20  # text of a block on the map side
MAX_FREQUENT = 1 << 16  # frequent prefixes: no more can have such a share each
_SPAN = WIDTH - PREFIX + 1  # places for an anchor in a window
NULL_ID = -(1 << 63)


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of PREFIX words and of WIDTH words from each place on (shorter by PREFIX - 1 and WIDTH - 1), by doubling."""
    power = {1: words}
    size = 1
    while size * 2 <= WIDTH:
        h = power[size]
        power[size * 2] = pair_hash(h[:-size], h[size:])
        size *= 2

    def of(n: int) -> np.ndarray:
        out, at = None, 0
        for size in sorted(power, reverse=True):
            if n & size:
                part = power[size][at:]
                out = part if out is None else pair_hash(out[: len(part)], part)
                at += size
        return out[: len(words) - n + 1]

    return of(PREFIX), of(WIDTH)


def leftmost_minimum(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values, the place of its least value, the leftmost of equals."""
    at = np.arange(len(h))
    size = 1
    while size < span:
        step = min(size, span - size)
        right = at[step:]
        left = at[: len(right)]
        at = np.where(h[right] < h[left], right, left)
        size += step
    return at


def _repeat_rows(doc: np.ndarray, key: np.ndarray, at: np.ndarray):
    """For repeated windows (document, its key, start): one row a document with its runs, as numbers start * 2**32 + length."""
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    fresh = np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0) | (np.diff(at) != 1)] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    runs = at[first] << 32 | np.diff(np.r_[first, len(doc)])
    doc, key = doc[first], key[first]
    rows = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0)]) if len(doc) else np.zeros(0, np.int64)
    bounds = np.r_[rows, len(doc)] if len(doc) else np.zeros(1, np.int64)
    return doc[rows], key[rows], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(runs, pa.int64()))


#: A row is either a document's repeats (grp < 0) or a block's suffixes for one group.
_LEAF = [("grp", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("repeats", pa.list_(pa.int64())), ("prefixes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("paths", pa.binary())]
LEAF_SCHEMA = "grp long, doc_id long, key long, repeats array<long>, prefixes binary, docs binary, places binary, paths binary"


def block_windows(data: np.ndarray, offsets: np.ndarray, secret: bytes):
    """Of a block: its words, prefix hashes by place, and for each window of WIDTH words its path hash, document, start and anchor."""
    words = Words(data, offsets)
    n = len(words.starts)
    if n < WIDTH:
        return None
    prefix, path = window_hashes(words.hashes(secret_lanes(secret)))
    doc = np.repeat(np.arange(len(offsets) - 1), words.counts)
    start = np.flatnonzero(doc[: n - WIDTH + 1] == doc[WIDTH - 1 :])  # windows within one document
    if not len(start):
        return None
    return words, prefix, path[start], doc[start], start, leftmost_minimum(prefix, _SPAN)[start]


def prefix_counts(share: float, secret: bytes):
    """For mapInArrow over (text): (prefix, count) of prefixes with at least ``share`` of a block's suffixes, and (null, suffixes)."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0), BLOCK):
                found = block_windows(data, offsets, secret)
                if found is None:
                    continue
                _, prefix, _, _, start, anchor = found
                h, n = np.unique(prefix[anchor[np.r_[True, anchor[1:] != anchor[:-1]]]], return_counts=True)
                often = n >= max(2.0, share * n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([None, *h[often].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[often].tolist()], pa.int64())], names=["prefix", "n"])

    return run


def frequent_prefixes(slim: DataFrame, groups: int, secret: bytes) -> np.ndarray:
    """Sorted hashes of the prefixes with more than about 1 / groups of all suffixes."""
    share = max(1 / groups, 1 / MAX_FREQUENT)
    counts = slim.select("text").mapInArrow(prefix_counts(share, secret), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "prefix-counts")
    total = counts.filter("prefix IS NULL").agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("prefix").isNotNull() & (F.col("n") >= max(2.0, share * total))).select("prefix").toPandas()["prefix"]
    drop_scratch(counts)
    return np.sort(often.to_numpy(np.int64).view(np.uint64))


def suffixes(bits: int, frequent: np.ndarray, secret: bytes):
    """For mapInArrow over (doc_id, key, text): repeats within blocks, and the suffixes of each group."""
    group_shift = np.uint64(64 - bits)

    def block_rows(ids, keys, data, offsets):
        found = block_windows(data, offsets, secret)
        if found is None:
            return
        words, prefix, path, doc, start, anchor = found
        place = start - words.first_word[doc]
        # equal windows of the block: the earliest goes on, with all that start at the same place of the same id
        order = np.argsort(path)
        same = path[order][1:] == path[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        keep = np.ones(len(start), bool)
        if len(order):
            order = order[np.lexsort((place[order], ids[doc[order]], path[order]))]
            p, d, a = path[order], ids[doc[order]], place[order]
            lead = np.maximum.accumulate(np.where(np.r_[True, p[1:] != p[:-1]], np.arange(len(p)), 0))
            again = (d != d[lead]) | (a != a[lead])
            keep[order[again]] = False
            gone = ~keep
            if gone.any():
                by, key, runs = _repeat_rows(ids[doc[gone]], keys[doc[gone]], place[gone])
                m = len(by)
                none = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(-1 - (pair_hash(by.view(np.uint64), key.view(np.uint64)) >> np.uint64(2)).astype(np.int64)), pa.array(by), pa.array(key), runs, none, none, none, none], names=[x for x, _ in _LEAF])
        # runs of windows with the same anchor make one suffix
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)])
        lives = np.add.reduceat(keep.astype(np.int64), first) > 0
        length = np.diff(np.r_[first, len(start)])[lives]
        at = first[lives]
        h = prefix[anchor[at]]
        offset = anchor[at] - start[at]
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
            single = gather(at[often], length[often])
            single = single[keep[single]]
            at, length = np.r_[at[~often], single], np.r_[length[~often], np.ones(len(single), np.int64)]
            h = np.r_[h[~often], pair_hash(path[single], prefix[anchor[single]])]
            offset = np.r_[offset[~often], np.zeros(len(single), np.int64)]
        # anchors are least hashes, so their hashes are small: groups go by a further hash, which spreads them evenly
        dealt = mix(h + np.uint64(1))
        order = np.argsort(dealt, kind="stable")
        at, length, h, offset = at[order], length[order], h[order], offset[order]
        group = (dealt[order] >> group_shift).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cut = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.zeros(0, np.int64)
        bounds = np.r_[cut, len(group)]
        who = doc[at]
        whole = np.stack([ids[who], keys[who]], 1).astype("<i8")
        # place of the first window, offset of the anchor in it, number of windows
        where = np.stack([place[at], offset, length], 1).astype("<i4")
        total = np.r_[0, np.cumsum(length)]
        each = gather(at, length)
        low = (path[each] & np.uint64(0xFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        m = len(cut)
        none_long = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(group[cut]), none_long, none_long, pa.nulls(m, pa.list_(pa.int64())), binary_array(h.astype("<u8"), bounds * 8), binary_array(whole, bounds * 16), binary_array(where, bounds * 12), binary_array(low, total[bounds] * 5)], names=[x for x, _ in _LEAF])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, data, offsets in text_blocks(batch.column(2), BLOCK):
                yield from block_rows(ids[at : at + len(offsets) - 1], keys[at : at + len(offsets) - 1], data, offsets)

    return run


def subtrees(batches):
    """For mapInArrow over rows sorted by group: repeats pass, and each group's deep nodes give further ones. One group is held at a time."""
    at, parts = None, []
    for batch in batches:
        group = batch.column(0).to_numpy(zero_copy_only=False)
        ready = group < 0
        if ready.any():
            yield batch.filter(pa.array(ready)).select(["doc_id", "key", "repeats"])
        for i in np.flatnonzero(~ready).tolist():
            if group[i] != at:
                yield from _subtree(parts)
                at, parts = group[i], []
            h, docs, where, low = (batch.column(c)[i].as_py() for c in (4, 5, 6, 7))
            parts.append((np.frombuffer(h, "<u8"), np.frombuffer(docs, "<i8").reshape(-1, 2), np.frombuffer(where, "<i4").reshape(-1, 3), np.frombuffer(low, np.uint8).reshape(-1, 5)))
    yield from _subtree(parts)


def _subtree(parts: list[tuple[np.ndarray, ...]]):
    if not parts:
        return
    h, docs, where, low = (np.concatenate([p[i] for p in parts]) for i in range(4))
    where = where.astype(np.int64)
    # prefixes that only one suffix has lead to a leaf
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h), bool)
    shared[order] = np.r_[False, same] | np.r_[same, False]
    if not shared.any():
        return
    rank = np.zeros(len(h), np.int64)
    rank[order] = np.cumsum(np.r_[0, ~same])
    begins = np.cumsum(where[:, 2]) - where[:, 2]
    pick = np.flatnonzero(shared)
    length = where[pick, 2]
    ends = np.cumsum(length)
    step = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
    suffix = np.repeat(pick, length)
    wide = np.zeros((len(suffix), 8), np.uint8)
    wide[:, :5] = low[begins[suffix] + step]
    # path: the window's own hash and the anchor's offset in it; node: the prefix's place in the sorted order
    path = wide.view("<u8").ravel() << np.uint64(8) | (where[suffix, 1] - step).astype(np.uint64)
    ids, place = docs[suffix, 0], where[suffix, 0] + step
    order = np.lexsort((place, ids, path, rank[suffix]))
    p, r, d, a = path[order], rank[suffix][order], ids[order], place[order]
    fresh = np.r_[True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))
    again = order[(d != d[lead]) | (a != a[lead])]
    if not len(again):
        return
    by, key, runs = _repeat_rows(ids[again], docs[suffix[again], 1], place[again])
    yield pa.RecordBatch.from_arrays([pa.array(by), pa.array(key), runs], names=["doc_id", "key", "repeats"])


def repeated_windows(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, key, repeats), materialized: runs of starts of windows that also start earlier, as numbers start * 2**32 + length.

    ``key`` is a hash of the text that keeps rows with equal ids apart; null ids are NULL_ID.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-int(size) // GROUP_BYTES))
    bits = max(0, (groups - 1).bit_length())
    parts = max(-(-(1 << bits) // 4), int(spark.conf.get("spark.sql.shuffle.partitions")))
    secret = token_bytes(16)  # drawn here, so all tasks and their repetitions have the same
    with arrow_batches(spark, most_bytes=BATCH_BYTES):  # a row holds a block's suffixes of a group
        leaves = slim.mapInArrow(suffixes(bits, frequent_prefixes(slim, 1 << bits, secret), secret), LEAF_SCHEMA)
        dealt = leaves.repartition(parts, "grp").sortWithinPartitions("grp")
        return materialize(dealt.mapInArrow(subtrees, "doc_id long, key long, repeats array<long>"), "repeats")


def _removal(batches):
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            ids, texts, lists = (batch.column(i) for i in range(3))
            out = []
            for text, found in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if not found:
                    out.append((n, 0, b" ".join(words)))
                    continue
                edge = np.zeros(n + 1, np.int64)
                runs = np.array(found, np.int64)
                start, length = runs >> 32, runs & 0xFFFFFFFF
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length + WIDTH - 1, -1)
                keep = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                out.append((n, n - len(keep), b" ".join([words[i] for i in keep.tolist()])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2].decode() for o in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document with the words that no earlier window covers, joined by one space."""
    # of one document only, and of rows equal in id and text together once
    found = repeated_windows(docs).select("doc_id", "key", F.explode("repeats").alias("run")).groupBy("doc_id", "key").agg(F.collect_set("run").alias("found"))
    rows = docs.select("doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_key", F.xxhash64("text"))
    joined = rows.join(found.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), ["_id", "_key"], "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "found").mapInArrow(_removal, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
