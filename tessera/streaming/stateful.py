"""Small stateful streaming operators; each has a batch twin that says what is right.

Within a micro-batch rows of a key are taken in event order. (``ordered`` has folds that wait for the watermark,
``session_cache``, ``guard`` and ``jsonl`` have states of their own.)
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tessera.functions import protocol
from tessera.functions.text import slices


def turn_cap(turns: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Turns (surface, session, student_id, position) that a cap per surface still allows; surfaces without a cap are free. State is a counter."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("position")
        left = max(0, caps[key[0]] - seen) if key[0] in caps else len(rows)
        state.update((seen + len(rows),))
        yield rows.head(left)[["surface", "session", "student_id", "position"]]

    return turns.groupBy("surface", "session", "student_id").applyInPandasWithState(run, "surface string, session long, student_id long, position long", "seen long", "append", GroupStateTimeout.NoTimeout)


def turn_cap_batch(turns: DataFrame, caps: dict[str, int]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("surface", "session", "student_id").orderBy("position"))
    cap = F.coalesce(*[F.when(F.col("surface") == k, F.lit(v)) for k, v in caps.items()], F.lit(2**31 - 1))
    return turns.withColumn("_n", n).filter(F.col("_n") <= cap).drop("_n")


def first_per_key(events: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """First row of each key while it is remembered (``ttl`` behind the watermark): snapshots that are built once, results that count once."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines of a JSONL stream (value) to typed rows; lines that are no JSON or of no known type go."""
    shape = "type STRING, session STRING, position LONG, event STRUCT<delta: STRUCT<type: STRING, text: STRING>>, is_error BOOLEAN"
    j = lines.select(F.from_json("value", shape).alias("j")).select("j.*").filter(F.col("type").isin("stream_event", "result"))
    return j.select("session", "position", F.col("event.delta.text").alias("delta"), (F.col("type") == "result").alias("is_end"))


def paced_schedule(tokens: DataFrame, partition: list[str], order: str, words: int = 3, dwell_ms: int = 850) -> DataFrame:
    """Reveal time of each token: a dwell for every ``words`` tokens before it."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1
    return tokens.withColumn("at_ms", F.floor(n / words) * dwell_ms)


#: Fixed values of the reveal: words of a tick, its dwell, and those behind a sentence, a beat and a directive; the first tick; the bounds of catching up.
TICK_WORDS, TICK_MS, SENTENCE_MS, BEAT_MS, DIRECTIVE_MS, FIRST_MS = 3, 850, 1150, 1700, 1500, 60
CATCH_UP_MS, LEAST_MS, LETTERS_A_WORD = 2000, 50, 6
SENTENCE_END = "[.!?؟…]$"


def revealed_tokens(text: str | None) -> list[tuple[int, str]]:
    """(end, token) of the words and the complete directives of a message; a directive is one token, whatever it holds."""
    out, last = [], 0
    for start, end, *_ in [*protocol.scan_directives(text or ""), (len(text or ""), len(text or ""))]:
        out += [(last + m.end(), m[0]) for m in re.finditer(r"\S+", text[last:start])] if text else []
        if end > start:
            out.append((end, text[start:end]))
        last = end
    return out


@F.pandas_udf(ArrayType(StructType().add("end", IntegerType()).add("token", StringType())))
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in (some for batch in batches for some in slices(batch)):
        yield texts.map(lambda s: [{"end": e, "token": t} for e, t in revealed_tokens(s)])


def reveal_schedule(messages: DataFrame, key: list[str], text: str = "text", ended_ms: str | None = None) -> DataFrame:
    """key, tick, end, at_ms, dwell_ms: when each piece of a message is shown, up to which character, and how long it stays before the next.

    A tick has ``TICK_WORDS`` words; it ends early behind a sentence or a directive, which have dwells of their own. From the first tick
    at or after ``ended_ms`` (a column: when the message was complete) the rest is spread over ``CATCH_UP_MS`` at most.
    """
    tokens = messages.select(*key, F.length(text).alias("_len"), (F.col(ended_ms) if ended_ms else F.lit(None)).cast("double").alias("_ended"), F.posexplode(_tokens(F.col(text))).alias("_i", "_t")).select(*key, "_len", "_ended", "_i", "_t.*")
    order = Window.partitionBy(*key).orderBy("_i")
    directive = F.col("token").startswith("{{")
    stops = directive | F.col("token").rlike(SENTENCE_END)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tokens = tokens.withColumn("_d", directive).withColumn("_stop", stops).withColumn("_part", F.coalesce(F.sum(F.col("_stop").cast("int")).over(before), F.lit(0)))
    words = F.coalesce(F.sum((~F.col("_d")).cast("int")).over(Window.partitionBy(*key, "_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ticks = tokens.withColumn("_tick", F.floor(words / TICK_WORDS)).groupBy(*key, "_len", "_ended", "_part", "_tick").agg(F.max(F.struct("_i", "end", "token", "_d", "_stop")).alias("_l"))
    dwell = F.when(F.col("_l._d"), F.when(F.col("_l.token") == "{{beat}}", BEAT_MS).otherwise(DIRECTIVE_MS)).when(F.col("_l._stop"), SENTENCE_MS).otherwise(TICK_MS).cast("double")
    by_tick = Window.partitionBy(*key).orderBy("_i")
    up_to = by_tick.rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.select(*key, "_len", "_ended", F.col("_l._i").alias("_i"), F.col("_l.end").alias("end"), dwell.alias("_dwell"))
    ticks = ticks.withColumn("_raw", FIRST_MS + F.coalesce(F.sum("_dwell").over(up_to), F.lit(0.0)))
    left = F.greatest(F.lit(1), F.ceil((F.col("_len") - F.col("end")) / (TICK_WORDS * LETTERS_A_WORD)))
    hurried = F.least(F.col("_dwell"), F.greatest(F.lit(float(LEAST_MS)), F.lit(float(CATCH_UP_MS)) / left))
    ticks = ticks.withColumn("dwell_ms", F.when(F.col("_raw") >= F.col("_ended"), hurried).otherwise(F.col("_dwell")))
    return ticks.select(*key, (F.row_number().over(by_tick) - 1).alias("tick"), "end", (FIRST_MS + F.coalesce(F.sum("dwell_ms").over(up_to), F.lit(0.0))).alias("at_ms"), "dwell_ms")


def retried_cost(calls: DataFrame) -> DataFrame:
    """Total cost and attempts of each call, and whether its last attempt was valid."""
    return calls.groupBy("call_id").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("attempts"), F.max_by("valid", "attempt").alias("valid"))
