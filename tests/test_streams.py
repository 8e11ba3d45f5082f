"""Streams with state: order of arrival, restarts, bounds."""

import datetime
import json
import random

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import temporal
from tessera.streaming import jsonl, ordered, session_cache, stateful

DAY = datetime.datetime(2024, 1, 1)


def run(spark, out, folder):
    with ordered.rocks_state(spark):
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


@given(st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"")), max_size=8), st.lists(st.integers(0, 60), max_size=6), st.booleans())
def test_lines_cut_anywhere(lines, cuts, ended):
    data = b"\n".join(lines) + (b"\n" if ended else b"")
    at, places, tail, got = 0, sorted({min(c, len(data)) for c in cuts} | {len(data)}), b"", []
    start = 0
    for end in places:
        chunk = (start, data[start:end])
        found, tail, at = jsonl.split_lines(tail, at, [chunk, chunk])  # a chunk that comes twice counts once
        got += found
        start = end
    whole = data.split(b"\n")
    assert [line for _, line in got] == whole[:-1] and tail == whole[-1] and all(data[p : p + len(x)] == x for p, x in got)


@given(st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"")), max_size=12), st.integers(1, 5), st.integers(1, 9), st.integers(1, 4), st.booleans())
def test_only_the_ends_of_stretches_are_open(lines, chunk, stretch, batch, ended):
    data = b"\n".join(lines) + (b"\n" if ended else b"")
    inner, pieces = [], []
    for a in range(0, len(data), stretch):
        chunks = [("s", at, data[at : min(at + chunk, a + stretch)]) for at in range(a, min(a + stretch, len(data)), chunk)]
        parts = list(jsonl.cut_runs(chunks[i : i + batch] for i in range(0, len(chunks), batch)))
        mine = [x[1:] for _, some in parts for x in some]
        assert len(mine) <= 2
        inner += [x[1:] for some, _ in parts for x in some]
        pieces += mine
    found, tail, at = jsonl.stitch(b"", 0, pieces[::-1])
    whole = data.split(b"\n")
    assert [x for _, x in sorted(inner + found)] == whole[:-1] and tail == whole[-1] and at == len(data) and all(data[p : p + len(x)] == x for p, x in inner + found)


def test_whole_lines_do_not_pass_through_the_state_of_their_stream():
    lines = [("s", i * 10, b"123456789\n") for i in range(1000)]
    parts = list(jsonl.cut_runs([lines]))
    assert sum(len(x[3]) for _, some in parts for x in some) == 10 and sum(len(some) for some, _ in parts) == 999


def test_missing_bytes_are_an_error():
    with pytest.raises(ValueError):
        jsonl.split_lines(b"", 3, [(5, b"x\n")])


def test_growing_logs_and_restarts(spark, tmp_path):
    events = [json.dumps({"type": "stream_event", "session": f"s{k}", "position": i, "event": {"delta": {"type": "text_delta", "text": f"é{i}🙂"}}}, ensure_ascii=False) for k in range(2) for i in range(20)]
    logs = {k: ("\n".join(events[k * 20 : k * 20 + 20]) + "\n\n{broken\n").encode() for k in range(2)}
    (tmp_path / "in").mkdir()
    spark.dataSource.register(jsonl.JsonlLogs)
    for part, end in enumerate((333, 334, 901, 10**6)):
        for k, data in logs.items():
            if k == 0 or part > 0:
                (tmp_path / "in" / f"log{k}.jsonl").write_bytes(data[:end])
        chunks = spark.readStream.format("jsonl_logs").options(path=str(tmp_path / "in"), suffix=".jsonl", chunkBytes="7", taskBytes="50").load()
        rows = run(spark, stateful.parse_lines(jsonl.whole_lines(chunks)), tmp_path)
    assert sorted((r.session, r.position, r.delta) for r in rows) == sorted((f"s{k}", i, f"é{i}🙂") for k in range(2) for i in range(20))


def test_order_of_arrival_does_not_matter_and_late_rows_are_told(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, i % 2, "lo", rnd.random() < 0.5, DAY + datetime.timedelta(hours=rnd.randint(0, 200))) for i in range(60)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    schema = "id long, student_id long, lo_id string, is_correct boolean, attempted_at timestamp_ntz"
    beat = lambda h: [(-h, -1, "", False, DAY + datetime.timedelta(hours=h))]
    late = [(900, 0, "lo", True, DAY + datetime.timedelta(hours=3))]
    for part in (shuffled[:20], shuffled[20:], beat(1000), late, beat(2000)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ordered.ordered_mastery(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "10 days")
        got = run(spark, stream, tmp_path)
    want = temporal.mastery_history(spark.createDataFrame(rows, schema), ["student_id", "lo_id"]).select("student_id", "lo_id", "n", F.round("score", 9), "system_from").collect()
    assert sorted((r.student_id, r.lo_id, r.n, round(r.score, 9), r.system_from) for r in got if not r.late and r.student_id >= 0) == sorted(map(tuple, want))
    assert [(r.id, r.n, r.score) for r in got if r.late] == [(900, None, None)]


def test_snapshots_are_replayed_rebuilt_and_evicted(spark, tmp_path):
    hour = 3_600_000
    cache = session_cache.Snapshots({}, 3 * hour, 2)
    assert cache.request("a", 0, "A0") == ("A0", True) and cache.request("a", 3 * hour - 1, "A1") == ("A0", False)
    assert cache.request("a", 3 * hour, "A2") == ("A2", True)  # expired: built again
    assert cache.request("b", 4 * hour, "B0")[1] and cache.request("c", 4 * hour, "C0")[1] and list(cache.held) == ["b", "c"]
    assert cache.request("a", 4 * hour, "A3") == ("A3", True) and list(cache.held) == ["c", "a"]  # the one that was built first goes
    rnd = random.Random(3)
    rows = [("x" if i % 3 else "y", i, f"s{rnd.randint(0, 9)}", DAY + datetime.timedelta(minutes=7 * i), f"ctx{i}") for i in range(200)]
    schema = "cache string, id long, session string, at timestamp, context string"
    for part in (rows[:50], rows[50:120], rows[120:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, session_cache.snapshot_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), most=4), tmp_path)
    want = session_cache.snapshot_batch(spark.createDataFrame(rows, schema), most=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and 0 < sum(r.built for r in want) < 200


class _Lists:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Maps(dict):
    containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__


class _Handle:
    def __init__(self):
        self.timers = set()
        self.getListState, self.getMapState = lambda *_: _Lists(), lambda *_: _Maps()
        self.listTimers, self.registerTimer, self.deleteTimer = lambda: iter(self.timers), self.timers.add, self.timers.discard


class _Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_one_key_of_state_holds_all_los_of_a_student():
    processor, handle = ordered.OrderedMastery(0), _Handle()
    processor.init(handle)
    come = pd.DataFrame([(1, lo, i, True, 1000 * (10 - i)) for i, lo in enumerate(["a", "b", "a"])], columns=["student_id", "lo_id", "id", "is_correct", "at"])
    assert list(processor.handleInputRows((1,), iter([come]), _Watermark(-1))) == [] and handle.timers == {8}
    rows = pd.concat(processor.handleExpiredTimer((1,), _Watermark(9), None))
    assert [(r.lo_id, r.n, r.id) for r in rows.itertuples()] == [("a", 1, 2), ("b", 1, 1)] and handle.timers == {10}
    rows = pd.concat(processor.handleExpiredTimer((1,), _Watermark(10), None))
    assert [(r.lo_id, r.n, r.id) for r in rows.itertuples()] == [("a", 2, 0)] and handle.timers == set()


def test_requests_of_a_batch_wait_as_columns_and_are_answered_in_parts():
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd

    held, n = {}, 200_000
    one = session_cache.SessionCache(3_600_000, 50)
    one.sessions = SimpleNamespace(exists=lambda: False, removeKey=held.pop, updateValue=held.__setitem__)
    one.handle = SimpleNamespace(listTimers=lambda: iter(()), deleteTimer=None, registerTimer=lambda t: None)
    frame = lambda a: pd.DataFrame({"id": range(a, a + 10_000)}).assign(session=lambda d: "s" + (d["id"] * 7919 % 97).astype(str), at_ms=lambda d: (n - d["id"]) // 3 * 1000, context=lambda d: "c" + d["id"].astype(str))
    got, largest = [], 0
    tracemalloc.start()
    for out in one.handleInputRows(("x",), (frame(a) for a in range(0, n, 10_000)), None):
        largest = max(largest, len(out))
        got.append((len(out), int(out["id"].iloc[0]), int(out["id"].iloc[-1]), int(out["built"].sum())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = sorted((r.at_ms, r.id, r.session, r.context) for a in range(0, n, 10_000) for r in frame(a).itertuples())
    cache = session_cache.Snapshots({}, 3_600_000, 50)
    built = [cache.request(s, at, c)[1] for at, _, s, c in rows]
    assert largest <= session_cache.ROWS and sum(k for k, *_ in got) == n and got[0][1] == rows[0][1] and got[-1][2] == rows[-1][1]
    assert sum(b for *_, b in got) == sum(built) and held == {(s,): v for s, v in cache.held.items()}
    assert peak < 30e6, peak
