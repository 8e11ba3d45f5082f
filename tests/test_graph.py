"""Graphs deeper than any fixed bound."""

import os
import subprocess
import sys

import pytest

from tessera.operators import graph


def test_chain_of_more_than_a_hundred_steps(spark):
    n = 104
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src_id long, dst_id long").coalesce(1)
    got = graph.prerequisite_chain(edges, spark.createDataFrame([(n,)], "root long")).collect()
    assert sorted((r.id, r.depth) for r in got) == [(i, n - i) for i in range(n)]


def test_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src_id long, dst_id long")
    roots = spark.createDataFrame([(0,)], "root long")
    with pytest.raises(ValueError, match="cycle"):
        graph.prerequisite_chain(edges, roots)
    assert sorted((r.id, r.depth) for r in graph.prerequisite_chain(edges, roots, min_depth_only=True).collect()) == [(0, 3), (1, 2), (2, 1)]


def test_layers_beyond_a_thousand_are_placed(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, order_in_parent int")
    layered = spark.createDataFrame([("a", 0), ("b", 1500), ("c", 1500)], "id string, layer int")
    edges = spark.createDataFrame([("a", "b")], "src_id string, dst_id string")
    got = graph.barycentric_order(nodes, edges, layered).collect()
    assert sorted((r.id, r.layer, r.position) for r in got) == [("a", 0, 0), ("b", 1500, 0), ("c", 1500, 1)]


def _components(pairs):
    """By reach from every node."""
    after = {a: {b for x, b in pairs if x == a} for pair in pairs for a in pair}

    def reach(a):
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        return seen

    far = {a: reach(a) for a in after}
    return {(a, min(b for b in far[a] if a in far[b])) for a in after if a in far[a]}


def test_nodes_between_cycles_are_on_none(spark):
    got = graph.cycle_components(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 5)], "src_id int, dst_id int"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (5, 5), (6, 5)}


def test_components_of_any_graph(spark):
    import random

    rnd = random.Random(1)
    cases = [[(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] for n, m in ((12, 14), (30, 45))]
    cases += [[(i, (i + 1) % 60) for i in range(60)] + [(100 + i, 101 + i) for i in range(60)] + [(7, 100), (200, 200)]]  # a long cycle, a long chain, a loop
    offset = 1000
    pairs = [(a + i * offset, b + i * offset) for i, case in enumerate(cases) for a, b in case]
    assert {tuple(r) for r in graph.cycle_components(spark.createDataFrame(pairs, "src_id int, dst_id int")).collect()} == _components(pairs)


def test_layers_of_cycles_are_null(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "e"), ("e", "f"), ("a", "f")], "src_id string, dst_id string")
    got = {r.id: r.layer for r in graph.layers(spark.createDataFrame([("z",)], "id string"), e).collect()}
    assert got == {"z": 0, "a": 0, "b": None, "c": None, "d": None, "e": 1, "f": 2}


ROUNDS = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", f"file://{sys.argv[1]}").getOrCreate()
from tessera.operators import graph
steps = spark.createDataFrame([(i, i + 1) for i in range(8)], "src_id long, dst_id long")
rows = graph.cut(steps)
for _ in range(6):
    rows = graph.cut(rows.join(rows.selectExpr("src_id AS dst_id", "dst_id AS end"), "dst_id", "left").select("src_id", "dst_id"))
assert sorted((r.src_id, r.dst_id) for r in rows.collect()) == [(i, i + 1) for i in range(8)]
print("size", rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
"""


def test_estimates_do_not_grow_with_the_rounds(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", ROUNDS, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("size")[1]) < 1 << 20
