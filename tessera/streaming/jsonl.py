"""JSONL logs as a stream: bytes as they were appended, put together to whole lines.

``JsonlLogs`` is a streaming source over a folder of growing files. Its offset is the number of bytes of each file, so a
query that starts again goes on where the last committed batch ended. What it reads are pieces of bytes that may end
anywhere, in a line or in a sign; ``whole_lines`` cuts them to lines where they are read and carries the incomplete last line of each file as state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK_BYTES, TASK_BYTES = 64 << 10, 4 << 20


class Stretch(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class JsonlReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.chunk, self.task = int(options.get("chunkBytes", CHUNK_BYTES)), int(options.get("taskBytes", TASK_BYTES))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = self._files()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(self.suffix) and not f.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(name, at, min(at + self.task, size)) for name, size in sorted(end.items()) for at in range(start.get(name, 0), size, self.task)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, folder = self._files()
        with system.open_input_file(f"{folder}/{partition.name}") as f:
            for at in range(partition.start, partition.end, self.chunk):
                yield partition.name, at, f.read_at(min(self.chunk, partition.end - at), at)


class JsonlLogs(DataSource):
    """Options: path, suffix (of file names), chunkBytes, taskBytes. Files only grow; they are read by the tasks, so every node reaches the path."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_logs"

    def schema(self) -> str:
        return "stream string, start long, chunk binary"

    def streamReader(self, schema) -> JsonlReader:
        return JsonlReader(self.options)


def split_lines(tail: bytes, at: int, chunks: Iterable[tuple[int, bytes]]) -> tuple[list[tuple[int, bytes]], bytes, int]:
    """Whole lines with the places where they begin, what is left, and the place of the next byte. A chunk that was seen before (up to ``at``) is passed over."""
    lines = []
    for start, chunk in sorted(chunks):
        if start > at:
            raise ValueError(f"bytes {at} to {start} are missing")
        chunk = chunk[at - start :]
        begin = at - len(tail)
        *whole, tail = (tail + chunk).split(b"\n") if b"\n" in chunk else [tail + chunk]
        for line in whole:
            lines.append((begin, line))
            begin += len(line) + 1
        at += len(chunk)
    return lines, tail, at


def cut_runs(rows: Iterable[list[tuple[str, int, bytes]]]) -> Iterator[tuple[list[tuple[str, int, bytes]], list[tuple[str, int, int, bytes]]]]:
    """For each batch of chunks (stream, start, bytes) its whole lines (stream, place, line), and the open pieces (stream, begins, place, bytes) of its stretches.

    A stretch is a run of chunks that follow each other. Its first piece goes to its first line break, its last one begins behind the
    last line break; between ``begins`` and ``place`` lie whole lines.
    """
    now, at, begins, tail = None, -1, None, b""  # ``begins``: of the last piece, None while no line break has come

    def rest() -> list[tuple]:
        place = at - len(tail)
        return [(now, place if begins is None else begins, place, tail)] if now is not None and (tail or begins is not None and place > begins) else []

    for batch in rows:
        lines, pieces, i = [], [], 0
        while i < len(batch):
            name, start, _ = batch[i]
            j, end = i, start
            while j < len(batch) and batch[j][:2] == (name, end):
                end += len(batch[j][2])
                j += 1
            if (name, start) != (now, at):
                pieces += rest()
                now, at, begins, tail = name, start, None, b""
            place = at - len(tail)
            *whole, tail = b"".join([tail, *(c for *_, c in batch[i:j])]).split(b"\n")
            for line in whole:
                end_ = place + len(line) + 1
                if begins is None:
                    pieces.append((name, place, place, line + b"\n"))
                    begins = end_
                else:
                    lines.append((name, place, line))
                place = end_
            at, i = end, max(j, i + 1)
        yield lines, pieces
    yield [], rest()


def stitch(tail: bytes, at: int, pieces: Iterable[tuple[int, int, bytes]]) -> tuple[list[tuple[int, bytes]], bytes, int]:
    """As ``split_lines``, of open pieces (begins, place, bytes)."""
    lines = []
    for begins, place, piece in sorted(pieces):
        if place == begins:
            found, tail, at = split_lines(tail, at, [(begins, piece)])
            lines += found
        elif begins > at:
            raise ValueError(f"bytes {at} to {begins} are missing")
        elif place + len(piece) > at:
            tail, at = piece, place + len(piece)
    return lines, tail, at


def _shown(lines: Iterable[tuple]) -> list[tuple]:
    return [(*where, line.decode("utf-8", "replace")) for *where, line in lines if line.strip()]


def whole_lines(chunks: DataFrame) -> DataFrame:
    """(stream, place, value): the complete lines of each stream that aren't blank, by the byte where they begin; an incomplete last line waits for its end.

    Lines are cut where the bytes are read, which is done twice; only what is open at the ends of a stretch goes to the task of its stream.
    """

    def cut(which: int, schema: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for parts in cut_runs(list(zip(*(b.column(c).to_pylist() for c in ("stream", "start", "chunk")), strict=True)) for b in batches):
                rows = parts[1] if which else _shown(parts[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        return run

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        tail, at = state.get if state.exists else (b"", 0)
        come = pd.concat(list(frames))
        lines, tail, at = stitch(bytes(tail), at, [(int(b), int(p), bytes(c)) for b, p, c in zip(come["begins"], come["place"], come["piece"], strict=True)])
        state.update((tail, at))
        yield pd.DataFrame([(key[0], *r) for r in _shown(lines)], columns=["stream", "place", "value"]).astype({"place": "int64"})

    text, number, raw = pa.string(), pa.int64(), pa.binary()
    inner = chunks.mapInArrow(cut(0, pa.schema([("stream", text), ("place", number), ("value", text)])), "stream string, place long, value string")
    pieces = chunks.mapInArrow(cut(1, pa.schema([("stream", text), ("begins", number), ("place", number), ("piece", raw)])), "stream string, begins long, place long, piece binary")
    ends = pieces.groupBy("stream").applyInPandasWithState(run, "stream string, place long, value string", "tail binary, at long", "append", GroupStateTimeout.NoTimeout)
    return inner.unionByName(ends)
