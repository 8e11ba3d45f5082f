"""Shared helpers: inputs, shared scratch tables, and numpy text kernels over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from hashlib import blake2b, shake_128

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the ASCII white space bytes that separate words (0x20 and 0x09 to 0x0D).
WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_BYTES = 4 << 20  # text handled by one round of numpy work
BATCH_BYTES = 8 << 20  # of one Arrow batch
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset.

    Unset and local (tests): a temporary folder. Unset on a cluster: the warehouse, which is shared.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if conf.get("spark.master", "local").startswith("local") and "cluster" not in conf.get("spark.master", ""):
            root = f"file://{tempfile.gettempdir()}/tessera-scratch"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path  # for drop_scratch
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int | None = None, most_rows: int | None = None):
    """Within the block Arrow batches to Python workers hold no more than that (and one row): the session's defaults are held several times by each task.

    A plan takes the setting when it runs, so results have to be written within the block.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": most_bytes, "spark.sql.execution.arrow.maxRecordsPerBatch": most_rows}
    before = {k: spark.conf.get(k, None) for k, v in wanted.items() if v is not None}
    try:
        for k in before:
            spark.conf.set(k, str(wanted[k]))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEEP = (np.uint64(1) << (np.arange(9, dtype=np.uint64) * np.uint64(8)).clip(max=np.uint64(63))) - np.uint64(1)  # the low n bytes
_KEEP[8] = np.uint64(0xFFFFFFFFFFFFFFFF)
_LANE = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))  # a key for each lane's place
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def lanes_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one little-endian number (zeros behind the end), without a copy of each."""
    return np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(9, np.uint8)]), strides=(1,))


def secret_lanes(secret: bytes) -> np.ndarray:
    """Keys for the lanes of ``span_hashes`` that nobody can know who hasn't the secret."""
    return np.frombuffer(shake_128(secret).digest(8 * 1024), "<u8")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes_keys: np.ndarray = _LANE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: its lanes of eight bytes, each with the key of its place, go through a finalizer before they are added up.

    Under the public keys texts can be made that have equal hashes, so those only serve where bytes or ``digests`` are compared behind it.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes, length = lanes_at(data), ends - starts
    h = mix((lanes[starts] & _KEEP[np.minimum(length, 8)]) ^ lanes_keys[0])
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8  # lanes behind the first
        at = gather(np.zeros(len(long), np.int64) + 1, more)
        span = np.repeat(long, more)
        left = np.minimum(length[span] - 8 * at, 8)
        key = lanes_keys[at & 1023] + (at >> 10).astype(np.uint64) * _LENGTH
        h[long] += np.add.reduceat(mix((lanes[starts[span] + 8 * at] & _KEEP[left]) ^ key), np.cumsum(more) - more)
    return mix(h + length.astype(np.uint64) * _LENGTH)


def equal_spans(lanes: np.ndarray, starts: np.ndarray, other_lanes: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each span of one array (as ``lanes_at``) has the bytes of the span of the same length in another."""
    n = (lengths + 7) // 8
    at, span = gather(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
    differ = (lanes[starts[span] + 8 * at] ^ other_lanes[others[span] + 8 * at]) & _KEEP[np.minimum(lengths[span] - 8 * at, 8)]
    out = np.ones(len(n), bool)
    out[span[differ != 0]] = False
    return out


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of spans: bytes and length themselves up to seven bytes, else a hash (with a first byte that no short span has)."""
    length = ends - starts
    keys = (lanes_at(data)[starts] & _KEEP[np.minimum(length, 7)]) | length.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(length > 7)
    keys[long] = span_hashes(data, starts[long], ends[long]) | np.uint64(0xFF << 56)
    return keys


class Words:
    """Words of a block of documents, as arrays: where each starts and ends in ``data``, and its document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE):
        """``outside``: by byte, whether it separates words."""
        self.data, self.offsets = data, offsets
        self.inside = solid = ~outside[data]
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets[:-1]] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | begins[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | begins[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.starts, offsets)  # of each document; one more at the end
        self.counts = np.diff(self.first_word)

    def encoded(self) -> pa.DictionaryArray:
        """The words as a dictionary array: equal bytes, equal index."""
        bounds = np.r_[0, np.cumsum(self.ends - self.starts)]
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(self.data[self.inside].tobytes())]).dictionary_encode()

    def hashes(self, lanes_keys: np.ndarray = _LANE) -> np.ndarray:
        """A 64-bit hash of each word's bytes (``span_hashes``)."""
        return span_hashes(self.data, self.starts, self.ends, lanes_keys)

    def digests(self) -> np.ndarray:
        """The first 128 bits of BLAKE2b of each word's bytes, as (2, words) numbers."""
        words = self.encoded()
        out = b"".join([blake2b(w, digest_size=16).digest() for w in words.dictionary.to_pylist()])
        return np.ascontiguousarray(np.frombuffer(out, "<u8").reshape(-1, 2).T)[:, words.indices.to_numpy()]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA24BAED4963EE407) + b * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Slices of a string array of about ``block_bytes`` (a longer text comes alone): first row, data, offsets."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        end = min(end, n)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_array(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of the slices of ``data`` between consecutive ``bounds`` (in bytes)."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
