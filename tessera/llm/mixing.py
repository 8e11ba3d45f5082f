"""Mix sources to target weights by capped water-filling. DataFrame functions only.

Targets: a source's cap is ``max_epochs`` times its size; the water level L, with
target = min(cap, L * weight), is found in one ordered pass over the sources by cap/weight. It is
the fixed point of "clamp what is above its cap, share the excess by weight, repeat".

Takes: ``floor(target / size)`` whole repetitions of every document, and one more for a seeded part:
documents of a source stand in the order of a seeded hash, and those before the point where the
rest of the target is used up are taken once more. The order is cut into hash buckets whose sums are
added first, so that only the one bucket that holds that point is sorted, never a whole source.

Edge cases: a null text has size 0; a null source is a source, listed last; a source of size 0 has
target 0; an empty table gives an empty result; extra columns do not matter; equal ids and equal
rows are rows of their own, placed by id and then text hash (rows equal in both are interchangeable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Fixed values of the query.
WEIGHTS, TOTAL, MAX_EPOCHS = (3.0, 1.0, 2.0), 1.5, 2.0
BUCKETS = 1 << 12
BROADCAST_SOURCES = 10_000  # a table of sources longer than this is joined by shuffle instead


def water_fill(sizes: DataFrame, total: float = TOTAL, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``sizes`` (source, source_size, weight): one row for each source."""
    capped = sizes.withColumn("_cap", F.col("source_size") * F.lit(max_epochs)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if all sources before this one are full; the first source that such a level does not fill gives the level of all that follow
    leveled = capped.withColumn("_level", level)
    found = F.first(F.when(F.col("_level") < F.col("_ratio"), F.col("_level")), ignorenulls=True).over(everything.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("_found", found).withColumn("target", F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("weight")))).drop("_cap", "_ratio", "_level", "_found")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights that repeat over the sources by code point, null last."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))


def mix_takes(sized: DataFrame, total: float = TOTAL, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: int = 8, whole_documents: bool = False) -> DataFrame:
    """For a materialized table with doc_id, source, size and ``h`` (a hash of id and text): add source_size, target, taken.

    The document at the cut takes the words that are missing to the target; with ``whole_documents``
    it is taken whole if at least half of it lies before the cut, else not.
    """
    sized = sized.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "h")).withColumn("_bucket", F.shiftrightunsigned("_order", 64 - (BUCKETS.bit_length() - 1)).cast("int"))
    sums = materialize(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    targets = water_fill(cyclic_weights(sums.groupBy("source").agg(F.sum("_words").alias("source_size")), weights), total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    key = F.col("t.source").eqNullSafe(F.col("b.source"))
    before = Window.partitionBy("b.source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.alias("b").join(targets.alias("t"), key).withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    cut = cut.filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest"))).groupBy(F.col("b.source").alias("source")).agg(F.min("_bucket").alias("_cut"), F.min_by("_before", "_bucket").alias("_cut_before"))
    plan = materialize(targets.alias("t").join(cut.alias("b"), key, "left").select("t.*", F.coalesce("_cut", F.lit(BUCKETS)).alias("_cut"), F.coalesce("_cut_before", F.lit(0)).alias("_cut_before")), "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = sized.alias("b").join(plan.alias("t"), key).select("b.*", "source_size", "target", "_whole", "_rest", "_cut", "_cut_before")
    out = [c for c in sized.columns if not c.startswith("_")] + ["source_size", "target"]
    clear = rows.filter(F.col("_bucket") != F.col("_cut")).select(*out, (F.col("size") * (F.col("_whole") + (F.col("_bucket") < F.col("_cut")).cast("long"))).alias("taken"), (F.col("_whole") + (F.col("_bucket") < F.col("_cut")).cast("long")).alias("repeats"))
    running = Window.partitionBy("source").orderBy("_order", "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = rows.filter(F.col("_bucket") == F.col("_cut")).withColumn("_left", F.col("_rest") - F.col("_cut_before") - F.coalesce(F.sum("size").over(running), F.lit(0)))
    once_more = F.col("_left") * 2 >= F.col("size") if whole_documents else F.col("_left") >= F.col("size")
    part = F.when(once_more, F.col("size")).otherwise(F.lit(0) if whole_documents else F.greatest(F.col("_left"), F.lit(0)))
    at_cut = at_cut.select(*out, (F.col("size") * F.col("_whole") + part).cast("long").alias("taken"), (F.col("_whole") + (once_more & (F.col("size") > 0)).cast("long")).alias("repeats"))
    return clear.unionByName(at_cut)


def size_documents(docs: DataFrame) -> DataFrame:
    words = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("h"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, whole documents only; same columns."""
    cols = docs.columns
    key = docs.withColumn("_h", F.xxhash64("text"))
    takes = mix_takes(materialize(size_documents(docs), "mix-sizes"), whole_documents=True, **options)
    # equal rows (same id and text) are interchangeable: their repetitions are summed and dealt out, what doesn't go round by their number
    takes = takes.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.sum("repeats").alias("_repeats"), F.count(F.lit(1)).alias("_copies"))
    takes = takes.filter("_repeats > 0")
    joined = key.join(takes.withColumnRenamed("_h", "_th"), key["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")))
    single = joined.filter("_copies = 1").withColumn("_each", F.col("_repeats"))
    nth = F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.lit(0)))
    several = joined.filter("_copies > 1").withColumn("_each", F.floor(F.col("_repeats") / F.col("_copies")) + (nth <= F.col("_repeats") % F.col("_copies")).cast("long"))
    dealt = single.unionByName(several).filter("_each > 0")
    return dealt.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_each")))).select(*cols)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(size_documents(table(spark, sf_dir, "documents")), "mix-sizes")
    return mix_takes(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")
