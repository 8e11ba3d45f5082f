"""With spark.checkpoint.dir set, what the operations and graph loops write lies there and nowhere else."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
from pyspark.sql import SparkSession
shared, own, sf = sys.argv[1:]
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", f"file://{shared}").config("spark.local.dir", own).getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("op3_substring_dedup", "op7_resharding", "op10_near_dedup", "g1_layers", "snk6_record_attempts"):
    assert queries[name](spark, sf).count() > 0
"""


def test_everything_is_written_in_the_shared_folder(tmp_path):
    shared, own, tmp = (tmp_path / n for n in ("shared", "own", "tmp"))
    for folder in (shared, own, tmp):
        folder.mkdir()
    done = subprocess.run([sys.executable, "-c", RUN, str(shared), str(own), "/root/testdata/sf0.001"], cwd=ROOT, env={**__import__("os").environ, "TMPDIR": str(tmp)}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert {p.name.split("-")[0] for p in shared.iterdir()} >= {"repeats", "shards", "classes", "snk6"}
    assert not list(tmp.rglob("*.parquet")) and not list(own.rglob("part-*.parquet"))
