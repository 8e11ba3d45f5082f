"""Sinks: a snapshot is complete when its marker is there; tables that change together are written as numbered batches of which the marker comes last."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import graph, temporal


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, the warehouse on a cluster and a temporary folder in local mode (tests)."""
    conf = spark.sparkContext.getConf()
    master = conf.get("spark.master", "local")
    alone = master.startswith("local") and "cluster" not in master
    root = conf.get("spark.checkpoint.dir", None) or (f"file://{tempfile.gettempdir()}/tessera-streams" if alone else spark.conf.get("spark.sql.warehouse.dir"))
    return root.rstrip("/")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """All tables of one snapshot; each folder gets its success mark from the committer, the manifest comes last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest")


def is_complete(spark: SparkSession, path: str) -> bool:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/_SUCCESS")
    return fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if not is_complete(spark, path):
        raise ValueError(f"the snapshot at {path} is not complete")
    return {r.name: spark.read.parquet(f"{path}/{r.name}") for r in spark.read.json(f"{path}/_manifest").collect()}  # names only


def load_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that can be written once all nodes are there, and those that dangle."""
    return graph.both_present(edges, nodes), graph.dangling(edges, nodes)


def dry_run(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Row counts before and after for each table, without writing anything."""
    parts = [before[n].agg(F.count(F.lit(1)).alias("before")).crossJoin(after[n].agg(F.count(F.lit(1)).alias("after"))).select(F.lit(n).alias("name"), "before", "after", (F.col("after") - F.col("before")).alias("delta")) for n in before]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_batch(tables: dict[str, DataFrame], path: str, batch_id: int, buckets: dict[int, int] | None = None) -> None:
    """Append rows to several tables at once: all under ``path/batch=N``, visible when the manifest is there.

    A batch that was committed before is left as it is, one that was broken off is written again, so each counts once.
    ``buckets`` goes into the manifest (see ``BUCKETS``).
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path}/batch={batch_id:012d}"
    if is_complete(spark, folder):
        return
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("bucket") if name == STATE else out).parquet(f"{folder}/{name}")
    spark.createDataFrame([(sorted(tables), {str(k): v for k, v in (buckets or {}).items()})], "names array<string>, buckets map<string,long>").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of all committed batches, in order: one listing."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_manifest/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(str(f.getPath().getParent().getParent()) for f in found or [])


def read_batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of one table in all committed batches."""
    done = [f"{f}/{name}" for f in committed(spark, path)]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


#: The open mastery row of each key is kept beside the log in this many buckets. A batch writes the buckets that it changes anew,
#: and its manifest says for each bucket which batch wrote it last, so a batch reads the manifest before it and its own buckets: no
#: more files for a long log than for a short one.
BUCKETS, STATE = 64, "state"
STATE_ROWS = "student_id long, lo_id string, n long, score double, system_from timestamp_ntz"


def buckets_before(spark: SparkSession, path: str, batch_id: int | None) -> dict[int, int]:
    """By bucket the batch that wrote it last, as of the batch before (None: as of the last one)."""
    folder = f"{path}/batch={(batch_id or 0) - 1:012d}"
    if not batch_id or not is_complete(spark, folder):
        earlier = [f for f in committed(spark, path) if batch_id is None or int(f.rsplit("=", 1)[1]) < batch_id]
        if not earlier:
            return {}
        folder = earlier[-1]
    row = spark.read.schema("buckets map<string,long>").json(f"{folder}/_manifest").first()
    return {int(k): v for k, v in row[0].items()} if row and row[0] else {}


def read_state(spark: SparkSession, path: str, last: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
    """Open mastery rows of some buckets (None: of all)."""
    folders = [f"{path}/batch={last[b]:012d}/{STATE}/bucket={b}" for b in (sorted(last) if buckets is None else buckets) if b in last]
    return spark.read.schema(STATE_ROWS).parquet(*folders) if folders else spark.createDataFrame([], STATE_ROWS)


ATTEMPT_LOG = "attempt_id long, student_id long, lo_id string, question_id string, given_answer string, is_correct boolean, attempted_at timestamp_ntz"
MASTERY_LOG = "student_id long, lo_id string, n long, score double, system_from timestamp_ntz"
EXPLANATION_LOG = "attempt_id long, question_id string, wrong_answer string, output_md string, grounded_ok boolean, cached boolean"


def record_attempts(batch: DataFrame, batch_id: int, questions: DataFrame, path: str) -> None:
    """One micro-batch of attempts (id, student_id, question_id, given_answer, attempted_at): for ``foreachBatch``.

    Attempts on live ``questions`` (id, lo_id, question_type, correct_answer, canonical_solution: array<struct<step, text_md>>,
    status) are graded; the attempt, the new mastery row and, for a wrong answer, the explanation from the
    canonical solution are appended as one batch. Mastery rows are never changed: a row is open until the next of
    its key, so appending one closes the one before (``read_mastery``). Of what is stored only the batch's buckets are read.
    """
    spark = batch.sparkSession
    q = questions.filter("status = 'live'").select(F.col("id").alias("question_id"), "lo_id", "question_type", "correct_answer", "canonical_solution")
    graded = batch.select(F.col("id").alias("attempt_id"), "student_id", "question_id", "given_answer", "attempted_at").join(q, "question_id")
    graded = graph.cut(graded.withColumn("is_correct", numbers.grade(F.col("question_type"), F.col("correct_answer"), F.col("given_answer"))))
    keys = ["student_id", "lo_id"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    touched = [r[0] for r in graded.select(bucket.alias("b")).distinct().collect()]  # no more than BUCKETS
    written = buckets_before(spark, path, batch_id)
    stored = graph.cut(read_state(spark, path, written, touched))
    last = stored.select(*keys, F.col("n").alias("_n"), F.col("score").alias("_score"))
    mastery = graph.cut(temporal.continued_history(graded.join(last, keys, "left"), keys, tie="attempt_id"))
    newest = mastery.groupBy(*keys).agg(F.max_by(F.struct("n", "score", "system_from"), "n").alias("_r")).select(*keys, "_r.*")
    state = stored.join(newest.select(*keys), keys, "left_anti").unionByName(newest).withColumn("bucket", bucket).repartition("bucket")
    shown = F.array_join(F.transform("canonical_solution", lambda s: F.concat(F.lit("**Step "), s["step"], F.lit(".** "), s["text_md"])), "\n\n")
    wrong = graded.filter(~F.col("is_correct")).select("attempt_id", "question_id", F.col("given_answer").alias("wrong_answer"), F.coalesce(shown, F.lit("")).alias("output_md"), F.lit(True).alias("grounded_ok"), F.lit(False).alias("cached"))
    write_batch({"attempts": graded.select("attempt_id", *keys, "question_id", "given_answer", "is_correct", "attempted_at"), "mastery": mastery, "explanations": wrong, STATE: state}, path, batch_id, written | dict.fromkeys(touched, batch_id))


def read_mastery(spark: SparkSession, path: str) -> DataFrame:
    """The mastery table of ``record_attempts``: (student_id, lo_id, n, score, system_from, system_to)."""
    log = read_batches(spark, path, "mastery", MASTERY_LOG)
    return log.withColumn("system_to", F.lead("system_from").over(Window.partitionBy("student_id", "lo_id").orderBy("n")))


def read_open_mastery(spark: SparkSession, path: str) -> DataFrame:
    """The open rows alone, from the buckets: (student_id, lo_id, n, score, system_from)."""
    return read_state(spark, path, buckets_before(spark, path, None))


LEDGER = "session string, student_id long, surface string, turn_index long, user_message string, assistant_message string, citations string, cost_usd double, latency_ms long"
REDACTED = "[REDACTED]"


def ledger_rows(turns: DataFrame) -> DataFrame:
    """Ledger rows of chat turns (session, student_id, surface, turn_index, user_message, text, redacted, is_error, cost_usd, latency_ms).

    A redacted turn is recorded without its text, citations and cost; a failed or empty one isn't recorded.
    """
    from tessera.functions import protocol

    kept = turns.filter(F.col("redacted") | (~F.col("is_error") & (F.coalesce(F.col("text"), F.lit("")) != "")))
    red = F.col("redacted")
    cites = F.to_json(F.when(red, F.expr("CAST(array() AS array<struct<kind:string,id:string>>)")).otherwise(protocol.citations(F.col("text"))))
    return kept.select("session", "student_id", "surface", "turn_index", "user_message", F.when(red, F.lit(REDACTED)).otherwise(F.col("text")).alias("assistant_message"), cites.alias("citations"), F.when(red, 0.0).otherwise(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), "latency_ms")


def append_ledger(batch: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch of chat turns to the ledger: for ``foreachBatch``."""
    write_batch({"ledger": ledger_rows(batch)}, path, batch_id)
