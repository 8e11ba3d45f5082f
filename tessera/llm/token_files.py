"""Token ids in Parquet list columns, with selective token and metadata reads.

Layout: one row for each document, files and rows in ascending id order, list columns with
dictionary encoding where it pays and delta encoding else (the Parquet v2 writer), a set row group
and page size, so that column and offset indexes let a read of a few documents touch a few pages.
``doc_id``, ``n_tokens`` and the place in the part are columns of their own: metadata reads never
touch the ids.

Edge cases: a null text counts as empty and has the end id only; null ids sort first; rows with
equal ids stand in the order of their text hashes (rows equal in both are interchangeable); an
empty table writes an empty file; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, ByteBPE, default_tokenizer, loaded, with_end
from .common import arrow_batches, materialize, scratch_path, table, text_blocks

ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
#: Bytes of text for one part of the range-partitioned write.
PART_BYTES = 32 << 20
PUSHED_IDS = 1000
BATCH_ROWS = 1000  # documents of one Arrow batch on the way back from the files


class LibraryBPE(ByteBPE):
    """The tokenizers library on each new piece of text; pieces are encoded independently of each other, so known ones come from the cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__(path)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        # one call and one result for all pieces; word_ids say which piece an id comes from
        got = self.library.encode([raw[a : a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(starts))


def _rows(path: str, end: int | None):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe, at, part = loaded(path, LibraryBPE), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, data, offsets in text_blocks(batch.column(1), BLOCK_BYTES):
                ids, bounds = with_end(*bpe.encode_block(data, offsets), end)
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
                at += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encode ``text`` and write the files in ascending ``doc_id`` order (one shuffle of the texts, by range)."""
    slim = docs.select("doc_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    tokens = ordered.mapInArrow(_rows(tokenizer or default_tokenizer(), end), SCHEMA)
    tokens.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.dictionary.page.size", 1 << 20).option("parquet.column.index.truncate.length", 64).parquet(path)


def starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all documents before a document, to rows with part, part_start and n_tokens. One row for each part stands in the sums."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.select("part", before.alias("_before")), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens: from the metadata columns alone."""
    return starts(spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "part_start", "n_tokens"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The ids of all or of some documents; a filter on ``doc_id`` reaches row groups and pages."""
    tokens = spark.read.schema(SCHEMA).parquet(path)
    return tokens if doc_ids is None else tokens.filter(F.col("doc_id").isin(doc_ids))


def read_slices(spark: SparkSession, path: str, slices: DataFrame) -> DataFrame:
    """Tokens [first, first + count) of documents, for a table (doc_id, first, count). The ids of a short table are pushed to the row groups and pages."""
    ids = [r[0] for r in slices.select("doc_id").distinct().limit(PUSHED_IDS + 1).collect()]
    tokens = read_tokens(spark, path, ids if len(ids) <= PUSHED_IDS else None)
    return tokens.join(slices, "doc_id").select("doc_id", "first", "count", F.slice("ids", F.col("first") + 1, F.col("count")).alias("ids"))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        bounds = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "ids"], pa.array(sums, pa.int64())], names=[*[n for n in batch.schema.names if n != "ids"], "ids_crc32"])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    with arrow_batches(spark, most_rows=BATCH_ROWS):
        write_tokens(table(spark, sf_dir, "documents"), path, end=2)
        tokens = spark.read.schema(SCHEMA).parquet(path)
        checked = materialize(tokens.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"), "token-checks")
    return starts(checked).select("doc_id", "start", "n_tokens", "ids_crc32")
