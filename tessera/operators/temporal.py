"""Bitemporal and slowly changing tables: folds of ordered events, current views, snapshots, lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph

PRIOR, RATE, LOW, HIGH = 0.3, 0.15, 0.02, 0.98
CHUNK = 256
HOT = 1_000_000  # attempts of one key


def current(df: DataFrame, to: str = "system_to") -> DataFrame:
    """Rows that are believed now: those whose validity is open."""
    return df.filter(F.col(to).isNull())


def as_of(df: DataFrame, at: Column, start: str = "system_from", to: str = "system_to") -> DataFrame:
    """Rows that were believed at one point in time (half-open validity)."""
    return df.filter((F.col(start) <= at) & (F.col(to).isNull() | (F.col(to) > at)))


def step(old: Column, outcome: Column) -> Column:
    """One step of the clamped moving average."""
    return F.least(F.lit(HIGH), F.greatest(F.lit(LOW), old + F.lit(RATE) * (outcome - old)))


def _fold(start: Column, outcomes: Column) -> Column:
    """Scores after each outcome."""
    empty = F.expr("CAST(array() AS array<double>)")
    return F.aggregate(outcomes, empty, lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), start), x))))


def _identity() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))


def _apply(f: Column, x: Column) -> Column:
    """A clamped linear function: min(hi, max(lo, a * x + b))."""
    return F.least(f["hi"], F.greatest(f["lo"], f["a"] * x + f["b"]))


def _then(f: Column, g: Column) -> Column:
    """``g`` after ``f``."""
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), _apply(g, f["lo"]).alias("lo"), _apply(g, f["hi"]).alias("hi"))


def _stepped(f: Column, y: Column) -> Column:
    """One attempt after ``f``."""
    return _then(f, F.struct(F.lit(1 - RATE).alias("a"), (F.lit(RATE) * y).alias("b"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))


def mastery_history(attempts: DataFrame, keys: list[str], ts: str = "attempted_at", tie: str = "id", correct: str = "is_correct", hot: int = HOT) -> DataFrame:
    """keys, n, score, system_from, system_to: one row for each attempt, closed by the next one of its key.

    The clamped moving average of a stretch of attempts is itself a clamped linear function, so a history is
    cut into chunks: each chunk's function is composed on its own, functions run over the chunks of a key, and each
    chunk is then played from its start. Keys with more than ``hot`` attempts are first cut into pieces by ranges of
    (key, time), each of which has one function; so no task holds a key's whole history, however long it is.
    """
    rows = attempts.select(*keys, F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.when(F.col(correct), 1.0).otherwise(0.0).alias("_y"))
    long = graph.cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select(*keys))
    if long.isEmpty():
        return _played(rows.withColumn("_piece", F.lit(0)), keys, None)
    cold, warm = rows.join(long, keys, "left_anti"), rows.join(long, keys, "left_semi")
    parts = max(2, int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = warm.repartitionByRange(parts, *keys, "_ts", "_tie").withColumn("_piece", F.spark_partition_id())
    return _played(cold.withColumn("_piece", F.lit(0)), keys, None).unionByName(_played(graph.cut(pieces), keys, "_piece"))


def _played(rows: DataFrame, keys: list[str], piece: str | None) -> DataFrame:
    """The history of rows that are cut into pieces (or not: ``piece`` None)."""
    part = [*keys, "_piece"] if piece else keys
    at = F.row_number().over(Window.partitionBy(*part).orderBy("_ts", "_tie"))
    numbered = rows.withColumn("_r", at)
    chunks = numbered.groupBy(*part, F.floor((F.col("_r") - 1) / CHUNK).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("_r", "_ts", "_y"))).alias("_rows"))
    chunks = chunks.withColumn("_f", F.aggregate("_rows", _identity(), lambda f, r: _stepped(f, r["_y"])))
    after, before = Window.partitionBy(*part).orderBy("_chunk"), Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_rows")[0]["_ts"]
    chunks = chunks.withColumn("_before", F.collect_list("_f").over(before)).withColumn("_next", F.lead(first).over(after))
    start, done, onward = F.lit(PRIOR), F.lit(0), F.lit(None)
    if piece:
        chunks = graph.cut(chunks)
        whole = chunks.groupBy(*part).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_chunk", "_f"))), _identity(), lambda f, c: _then(f, c["_f"])).alias("_g"), F.sum(F.size("_rows")).alias("_n"), F.min(first).alias("_first"))
        earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece
        whole = whole.select(*part, F.aggregate(F.collect_list("_g").over(earlier), F.lit(PRIOR), lambda x, g: _apply(g, x)).alias("_start"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_done"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_onward"))
        chunks = chunks.join(whole, part)
        start, done, onward = F.col("_start"), F.col("_done"), F.col("_onward")
    scores = _fold(F.aggregate("_before", start, lambda x, f: _apply(f, x)), F.transform("_rows", lambda r: r["_y"]))
    ends = F.concat(F.transform(F.slice("_rows", 2, CHUNK), lambda r: r["_ts"]), F.array(F.coalesce("_next", onward)))
    each = chunks.select(*keys, done.alias("_done"), F.explode(F.arrays_zip("_rows", scores.alias("_scores"), ends.alias("_ends"))).alias("r"))
    return each.select(*keys, (F.col("r._rows._r") + F.col("_done")).cast("int").alias("n"), F.col("r._scores").alias("score"), F.col("r._rows._ts").alias("system_from"), F.col("r._ends").alias("system_to"))


def continued_history(attempts: DataFrame, keys: list[str], ts: str = "attempted_at", tie: str = "id", correct: str = "is_correct") -> DataFrame:
    """keys, n, score, system_from of a batch of attempts that goes on from a stored state: ``_n`` and ``_score`` of each key (null: none yet). A key's rows of one batch are one array."""
    rows = attempts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.when(F.col(correct), 1.0).otherwise(0.0).alias("_y")))).alias("_rows"), F.first("_n").alias("_n"), F.first("_score").alias("_score"))
    played = rows.withColumn("_scores", _fold(F.coalesce("_score", F.lit(PRIOR)), F.transform("_rows", lambda r: r["_y"])))
    each = played.select(*keys, "_n", F.posexplode(F.arrays_zip("_rows", "_scores")).alias("_i", "r"))
    return each.select(*keys, (F.coalesce("_n", F.lit(0)) + F.col("_i") + 1).cast("long").alias("n"), F.col("r._scores").alias("score"), F.col("r._rows._ts").alias("system_from"))


def baseline_current(mastery: DataFrame, keys: list[str]) -> DataFrame:
    """First score of each key, its open score, and when each began."""
    open_ = F.col("system_to").isNull()
    return mastery.groupBy(*keys).agg(
        F.min_by("score", F.struct("system_from", "n")).alias("baseline"), F.min("system_from").alias("baseline_at"),
        F.max(F.when(open_, F.col("score"))).alias("current"), F.max(F.when(open_, F.col("system_from"))).alias("current_at"),
    )


def session_delta(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """First and last value of each key within a session, and their difference."""
    seq = F.struct(*order)
    out = events.groupBy(*keys).agg(F.min_by(value, seq).alias("first_value"), F.max_by(value, seq).alias("last_value"))
    return out.withColumn("delta", F.col("last_value") - F.col("first_value"))


def as_of_join(probes: DataFrame, facts: DataFrame, keys: list[str], probe_ts: str, fact_ts: str, values: list[str]) -> DataFrame:
    """For each probe the values of the last fact at or before it: one sort over both, no range join."""
    a = probes.select(*probes.columns, F.col(probe_ts).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(facts.schema[v].dataType).alias(f"_{v}") for v in values])
    b = facts.select(*[F.col(k) if k in keys else F.lit(None).cast(probes.schema[k].dataType).alias(k) for k in probes.columns], F.col(fact_ts).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    seen = [F.last(F.when(F.col("_side") == 0, F.struct(*[f"_{v}" for v in values])), ignorenulls=True).over(w).alias("_seen")]
    return both.select("*", *seen).filter("_side = 1").select(*probes.columns, *[F.col(f"_seen._{v}").alias(v) for v in values])


def scoped_replace(current_rows: DataFrame, incoming: DataFrame, scope: DataFrame, key: str, scope_key: str | None = None) -> DataFrame:
    """Replace what lies in a scope: rows of the scope go, all incoming rows come."""
    kept = current_rows.join(scope.select(F.col(scope_key or key).alias(key)).distinct(), key, "left_anti")
    return kept.select(*current_rows.columns).unionByName(incoming.select(*current_rows.columns))


def insert_new(current_rows: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Insert rows whose key is new; within a batch the first by ``order`` wins."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(current_rows.select(key), key, "left_anti").select(*incoming.columns)
