"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. Emissions are linear in features of the line and of its two neighbours
(shares of byte classes, lengths, repeated punctuation, words and lines); transitions tie a line's
label to the next one's. Forward and backward messages, as log-odds, run over all documents of a
block at once, line by line; a document's score is the mean of its lines' marginal probabilities of
good, weighted by line length.

Training: a line's label is its document's. At most ``TRAIN_DOCS`` labelled documents are used,
those with the smallest id hashes among the ids that are not held out, as many of them as have
``TRAIN_BYTES`` of text and ``TRAIN_LINES`` lines; the bounds are parameters. They are used whole; a
document that has more than an eighth of a bound by itself is passed over, so the others always make
seven eighths of it if there are so many. The conditional likelihood is maximized by Adam on the driver. Scores use whole texts and nothing but the text.

Edge cases: null text counts as empty, which is one empty line; null ids are not held out; labels
that are null or whose document is missing are ignored, repeated ones count once for each row;
without usable labels every score is 0.5; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import Words, table, text_blocks

TRAIN_DOCS, TRAIN_BYTES, STEPS, RATE, DECAY = 2000, 8 << 20, 160, 0.08, 1e-3
#: Lines of the training texts (132 bytes of features each), and the share of either bound that one document may have.
TRAIN_LINES, LONGEST_SHARE = 250_000, 8
ACCEPT = 0.3
#: Byte classes of the features.
_CLASS = np.zeros(256, np.int64)
for _name, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()", b"-_=+/\\"], start=1):
    _CLASS[list(_bytes)] = _name
_CLASS[128:] = 11
_KINDS = 12  # class 0: all other bytes (controls, the backquote)
WIDTH = 2 * _KINDS + 9


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes) of every line of a block, and the number of lines of each document (at least one)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    # a line begins at each document's start and behind each break; empty documents have one empty line
    begin = np.r_[offsets[:-1], breaks + 1]
    doc = np.r_[np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1]
    order = np.lexsort((np.r_[np.zeros(len(offsets) - 1), np.ones(len(breaks))], begin, doc))
    begin, doc = begin[order], doc[order]
    lines = len(begin)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    last = np.r_[doc[1:] != doc[:-1], True]
    end = np.where(last, offsets[doc + 1], np.r_[begin[1:], n] - 1)
    size = end - begin
    line = np.repeat(np.arange(lines), size + (~last))
    kinds = np.bincount(line * _KINDS + _CLASS[data], minlength=lines * _KINDS).reshape(lines, _KINDS).astype(np.float32)
    kinds[:, 0] -= ~last  # the break itself
    share = kinds / np.maximum(size, 1)[:, None]
    marks = np.isin(_CLASS[data], (4, 5, 6, 7, 8, 9, 10)) & (_CLASS[data] != 4)
    double = np.bincount(line[1:], marks[1:] & (data[1:] == data[:-1]) & (line[1:] == line[:-1]), lines)
    words = Words(data, np.r_[begin, n])
    n_words = words.counts
    each = words.hashes()
    of = np.repeat(np.arange(lines), n_words)
    echo = np.bincount(of[1:], (each[1:] == each[:-1]) & (of[1:] == of[:-1]), lines)
    hashes = np.r_[np.uint64(0), np.cumsum(each, dtype=np.uint64)]
    text = hashes[words.first_word[1:]] - hashes[words.first_word[:-1]]  # equal for lines of equal words
    _, place, times = np.unique(text + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    again = (times[place] > 1) & (n_words > 0)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 11]
    out = np.concatenate([share, np.sqrt(share), np.stack([np.log1p(size) / 8, np.log1p(n_words) / 6, (size == 0), np.minimum(size / np.maximum(n_words, 1), 40) / 10, double / np.maximum(n_words, 1), double > 1, again, echo / np.maximum(n_words, 1), kinds[:, 2] / np.maximum(letters, 1)], 1)], 1)
    return out.astype(np.float32), size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and of the line after it in its document, edges and a constant."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.r_[first[1:], True]
    before = np.vstack([np.zeros((1, x.shape[1]), x.dtype), x[:-1]])
    before[first] = 0
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]), x.dtype)])
    after[last] = 0
    return np.hstack([x, before, after, np.stack([first, last, np.ones(len(x))], 1).astype(x.dtype)])


class Chains:
    """Documents of a block, longest first, so that those with a line t are a leading slice."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.start = (np.cumsum(counts) - counts)[self.order]
        self.counts = counts[self.order]
        self.alive = [int(k) for k in np.searchsorted(-self.counts, -np.arange(1, (self.counts[0] if len(counts) else 0) + 1), side="right")]

    def messages(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good: of all up to a line, and of all behind it."""
        t00, t01, t10, t11 = trans
        forward, backward = e.copy(), np.zeros_like(e)
        for t in range(1, len(self.alive)):
            at = self.start[: self.alive[t]] + t
            m = forward[at - 1]
            forward[at] += np.logaddexp(t11 + m, t01) - np.logaddexp(t10 + m, t00)
        for t in range(len(self.alive) - 2, -1, -1):
            at = self.start[: self.alive[t + 1]] + t
            m = e[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(t11 + m, t10) - np.logaddexp(t01 + m, t00)
        return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = STEPS) -> dict:
    """Weights and transitions that maximize the mean conditional log-likelihood of the documents' line labels."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = with_neighbours((x - mean) / spread, counts)
    chains = Chains(counts)
    y = np.repeat(label, counts).astype(np.float64)
    share = np.repeat(1.0 / np.maximum(counts, 1), counts) / len(counts)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.array([share[at] @ (1 - y[at]), 0.0, 0.0, share[at] @ y[at]])  # labels don't change within a document
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        e = (x @ w[:-4].astype(x.dtype)).astype(np.float64)
        forward, backward = chains.messages(e, w[-4:])
        p = _sigmoid(forward + backward)
        a, b = forward[at], e[at + 1] + backward[at + 1]
        joint = np.stack([np.zeros_like(a), b, a, a + b]) + w[-4:, None]
        joint = np.exp(joint - joint.max(0))
        grad = np.r_[(((y - p) * share).astype(x.dtype) @ x), seen - (joint / joint.sum(0)) @ share[at]] - DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return {"mean": mean, "spread": spread, "weights": w[:-4], "trans": w[-4:]}


def score_block(model: dict | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(offsets) - 1, 0.5)
    x, size, counts = line_features(data, offsets)
    e = (with_neighbours((x - model["mean"]) / model["spread"], counts) @ model["weights"].astype(np.float32)).astype(np.float64)
    forward, backward = Chains(counts).messages(e, model["trans"])
    p = _sigmoid(forward + backward)
    weight = size + 1.0
    first = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, train_lines: int = TRAIN_LINES) -> dict | None:
    """The model from a bounded sample of labelled rows that are not held out."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    sample = usable.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "y").limit(train_docs)

    def features(batches):
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(1), 1 << 20):
                x, _, counts = line_features(data, offsets)
                first = np.cumsum(counts) - counts
                rows = [x[a : a + n].tobytes() for a, n in zip(first, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.array(rows, pa.binary())], names=["y", "x"])

    # a window over a sample of bounded size; texts come with it only where they fit, and one that is long by itself is passed over
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.octet_length(text).cast("long").alias("_bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_lines")).join(F.broadcast(sample), "doc_id")
    sized = sized.groupBy("doc_id", "y").agg(F.sum("_bytes").alias("_bytes"), F.sum("_lines").alias("_lines")).filter((F.col("_bytes") <= train_bytes // LONGEST_SHARE) & (F.col("_lines") <= train_lines // LONGEST_SHARE))
    running = lambda c: F.sum(c).over(Window.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "y", "_bytes").rowsBetween(Window.unboundedPreceding, 0))
    fits = sized.select("doc_id", "y", running("_bytes").alias("_b"), running("_lines").alias("_l")).filter((F.col("_b") <= train_bytes) & (F.col("_l") <= train_lines)).select("doc_id", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(fits), "doc_id").select("y", "text").mapInArrow(features, "y int, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["y", "x"])  # the same order whatever the partitions
    parts = [np.frombuffer(r, np.float32).reshape(-1, WIDTH) for r in rows["x"]]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), rows["y"].to_numpy(np.float64) > 0)


def score(docs: DataFrame, model: dict | None, out: str = "score") -> DataFrame:
    """``docs`` with a score of ``text`` from 0 to 1."""
    docs = docs.drop(out)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            parts = [score_block(model, data, offsets) for _, data, offsets in text_blocks(texts, 1 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without what the classifier rejects; same columns."""
    return score(docs, train(docs, labels), "_quality").filter(F.col("_quality") >= accept).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
