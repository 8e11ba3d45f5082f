"""Secret scans over content-addressed blobs, with an incremental ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text, so a text that occurs under
many paths or in many versions is one blob. A ledger holds the (blob, rule version) pairs that were
scanned and their findings; a scan looks only at pairs that the ledger lacks, appends to it, and
joins all findings back to the paths.

Spans come from two aligned native arrays per kind: the matches, and the gaps that ``split`` leaves
between them. Summed lengths of both give each match's place in code points.

Edge cases: a null text counts as empty (its blob is the empty one); equal texts share a blob; an
empty table gives an empty result; extra columns of the input are ignored; null ids stay rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

#: The kinds of secrets in their listed order, with pattern, the group that is measured, and its least length.
RULES = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
#: Of the rules themselves, so a changed rule scans every blob again.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
LEDGER_SCHEMA = "blob string, rule_version string, findings array<struct<start:int,kind:int,end:int>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text: Column, kind: int) -> Column:
    """array<struct<start, kind, end>> of one kind's kept matches in ``text``."""
    _, pattern, group, least = RULES[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len"), F.length(F.get(measured, i)).alias("measured")))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc, s):
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["len"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["measured"] >= least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(steps, state, step, lambda acc: acc["spans"])).otherwise(none)


def findings(text: Column) -> Column:
    """All kept spans of a text by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, k) for k in range(len(RULES))]))


def scan_blobs(versions: DataFrame, ledger_dir: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``versions`` that ``ledger_dir`` has not seen under ``rule_version``; append them; return the whole ledger for that rule version."""
    spark = versions.sparkSession
    ledger = read_ledger(spark, ledger_dir).filter(F.col("rule_version") == rule_version)
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # one copy of each text leaves a task, then what the ledger knows goes
    unseen = blobs.groupBy("blob").agg(F.first("_text").alias("_text")).join(ledger.select("blob"), "blob", "left_anti")
    scanned = unseen.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("_text")).alias("findings"))
    scanned.write.mode("append").option("compression", "zstd").parquet(ledger_dir)
    return read_ledger(spark, ledger_dir).filter(F.col("rule_version") == rule_version)


def read_ledger(spark: SparkSession, ledger_dir: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_dir)


def _once(ledger: DataFrame) -> DataFrame:
    """(blob, findings) of blobs that have any: once, even if two runs have written the same pair."""
    return ledger.filter(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))


def find_secrets(versions: DataFrame, ledger_dir: str, keys: list[str], text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """``keys`` of every version with ``secret_blob`` and ``secret_findings`` (empty array: none)."""
    known = _once(scan_blobs(versions, ledger_dir, text, rule_version)).withColumnsRenamed({"blob": "secret_blob", "findings": "secret_findings"})
    paths = versions.select(*keys, blob_id(F.col(text)).alias("secret_blob"))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return paths.join(known, "secret_blob", "left").withColumn("secret_findings", F.coalesce("secret_findings", none))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every found span replaced by ``mark`` (spans that overlap are replaced as one)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        cut = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), cut.alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def redact_documents(docs: DataFrame, ledger_dir: str) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, ``n_chars`` brought up to date; same columns.

    Spans are found once for each blob and joined to the rows by blob.
    """
    cols = docs.columns
    known = _once(scan_blobs(docs, ledger_dir)).withColumnsRenamed({"blob": "_blob", "findings": "_found"})
    out = docs.withColumn("_blob", blob_id(F.col("text"))).join(known, "_blob", "left")
    clean = F.when(F.col("_found").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("_found")))
    out = out.withColumn("text", clean)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("_found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*cols)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "secret-ledger"), ["doc_id"])
    shown = F.array_join(F.transform("secret_findings", lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secret_findings", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown, 256).alias("base_sha256"), shown.alias("spans"))
