"""Tables that change together: a version is a manifest of folders, and publishing it is one rename.

A load writes the tables that it changes into new folders and then publishes a manifest that names the
folder of every table; unchanged tables keep theirs. A reader holds one manifest, so what it reads stays as
it was, whatever is published meanwhile. A load that is broken off leaves folders that no manifest
names. Two loads from one version can't both publish: the second finds the number taken.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

MANIFESTS = "_versions"
AT_ONCE = 4


class Conflict(Exception):
    """Another load has published the version first."""


@dataclass(frozen=True)
class Version:
    spark: SparkSession
    root: str
    number: int
    #: By table: folder and schema (as JSON).
    tables: dict[str, tuple[str, str]]

    def table(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        path, schema = self.tables[name]
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)

    def all(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.tables}


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Published versions, in order."""
    _, path, fs = _files(spark, f"{root}/{MANIFESTS}")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def version(spark: SparkSession, root: str, number: int) -> Version:
    text = spark.read.text(f"{root}/{MANIFESTS}/{number:012d}.json", wholetext=True).first()[0]
    return Version(spark, root, number, {k: tuple(v) for k, v in json.loads(text).items()})


def latest(spark: SparkSession, root: str) -> Version | None:
    known = numbers(spark, root)
    return version(spark, root, known[-1]) if known else None


def write(spark: SparkSession, root: str, changed: dict[str, DataFrame]) -> dict[str, tuple[str, str]]:
    """Write tables into new folders that no version names yet, ``AT_ONCE`` at a time: a small table or a last long task leaves no cores idle."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    put = inheritable_thread_target(spark)(lambda name, df: df.write.mode("errorifexists").parquet(f"{folder}/{name}"))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(put, changed.keys(), changed.values()))
    return {name: (f"{folder}/{name}", df.schema.json()) for name, df in changed.items()}


def publish(spark: SparkSession, root: str, base: Version | None, written: dict[str, tuple[str, str]]) -> Version:
    """Make what was written, with the other tables of ``base``, the next version."""
    number = base.number + 1 if base else 1
    tables = {**(base.tables if base else {}), **written}
    jvm, target, fs = _files(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(tables).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(draft), context.makeQualified(target), options)  # without an option to overwrite
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {number} of {root} is there already") from None
        raise
    return Version(spark, root, number, tables)


def commit(spark: SparkSession, root: str, base: Version | None, changed: dict[str, DataFrame]) -> Version:
    return publish(spark, root, base, write(spark, root, changed))
