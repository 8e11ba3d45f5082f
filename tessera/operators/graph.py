"""Reachability, layers, cycles, lineage and adjacency over edge tables (src_id, dst_id, edge_type).

Iterative operators run a driver loop over DataFrames. Only row counts come to the driver; each
round is written to ``spark.checkpoint.dir`` (if one is set), so lineage stays short and
survives lost executors. Loops end on cyclic data, since known pairs are never added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared checkpoint folder; without one (small local runs) keep the rows in memory and on disk.

    The rows are a Parquet table there, of which Spark knows the size. A checkpoint keeps the estimate of the plan that it
    ends: joins multiply estimates, so in a loop their digits double every round until the driver does nothing else.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return df.persist()


def reachable(edges: DataFrame, roots: DataFrame, forward: bool = True) -> DataFrame:
    """(root, id): everything that can be reached from each root, the root included, as a set.

    ``edges`` is (src_id, dst_id); ``roots`` is (root). Semi-naive: each round follows the new pairs only.
    """
    a, b = ("src_id", "dst_id") if forward else ("dst_id", "src_id")
    step = cut(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct())
    seen = new = cut(roots.select("root", F.col("root").alias("id")).distinct())
    while True:
        new = cut(new.join(step, "id").select("root", F.col("next").alias("id")).distinct().join(seen, ["root", "id"], "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): the longest path that leads to each node; null for nodes on a cycle or behind one. Unknown endpoints are added.

    A node is taken when all edges that lead to it have come from taken nodes, so each edge is joined once
    in all. What is open between rounds are the nodes that some but not all of their edges have reached. There is
    one round for each layer.
    """
    edges = edges.select("src_id", "dst_id").distinct()
    into = edges.groupBy("dst_id").agg(F.count(F.lit(1)).alias("_in"))
    edges = cut(edges.join(into, "dst_id").select("src_id", "dst_id", "_in").repartition("src_id"))
    known = cut(nodes.select("id").union(edges.select("src_id")).union(edges.select("dst_id")).distinct())
    open_ = known.join(edges.select(F.col("dst_id").alias("id")), "id", "left_anti").withColumn("left", F.lit(0).cast("long"))
    seen, k = open_.select("id", F.lit(0).alias("layer")), 0
    while True:
        front = open_.filter("left = 0").select(F.col("id").alias("src_id"))
        reached = edges.join(front, "src_id").select(F.col("dst_id").alias("id"), F.lit(None).cast("long").alias("left"), F.col("_in"), F.lit(1).alias("_n"))
        waiting = open_.filter("left > 0").select("id", "left", F.lit(None).cast("long").alias("_in"), F.lit(0).alias("_n"))
        open_ = cut(reached.unionByName(waiting).groupBy("id").agg((F.coalesce(F.max("left"), F.max("_in")) - F.sum("_n")).alias("left")))
        k += 1
        now = open_.filter("left = 0")
        if now.isEmpty():
            return known.join(seen, "id", "left")
        seen = seen.unionByName(now.select("id", F.lit(k).alias("layer")))
        if k % 25 == 0:
            seen = cut(seen)  # a plan of a few unions


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from nodes that none leads to and those to nodes that none leaves."""
    into, out = edges.select(F.col("dst_id").alias("src_id")).distinct(), edges.select(F.col("src_id").alias("dst_id")).distinct()
    return edges.join(into, "src_id", "left_semi").join(out, "dst_id", "left_semi").select("src_id", "dst_id")


def _shortcuts(edges: DataFrame, salt: int) -> DataFrame:
    """(id, before, after) of nodes with one edge in and one out, no two of them neighbours: each can be left out for an edge from ``before`` to ``after``."""
    one = edges.groupBy(F.col("dst_id").alias("id")).agg(F.max("src_id").alias("before"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").join(edges.groupBy(F.col("src_id").alias("id")).agg(F.max("dst_id").alias("after"), F.count(F.lit(1)).alias("_m")).filter("_m = 1"), "id")
    one = one.filter("before != id AND after != id").select("id", "before", "after", F.struct(F.xxhash64("id", F.lit(salt)).alias("h"), "id").alias("_h"))
    beside = lambda c: one.select(F.col("id").alias(c), F.col("_h").alias(f"_{c}"))
    least = one.join(beside("before"), "before", "left").join(beside("after"), "after", "left")
    return least.filter((F.col("_before").isNull() | (F.col("_h") < F.col("_before"))) & (F.col("_after").isNull() | (F.col("_h") < F.col("_after")))).select("id", "before", "after")


def _colours(edges: DataFrame) -> DataFrame:
    """(id, colour): the greatest id among a node and all that lead to it. Each round follows the colours that changed."""
    colour = cut(edges.select(F.col("src_id").alias("id")).union(edges.select("dst_id")).distinct().withColumn("colour", F.col("id")))
    moved = colour
    while True:
        sent = edges.join(moved.select(F.col("id").alias("src_id"), "colour"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.max("colour").alias("_c"))
        new = cut(colour.join(sent, "id", "left").select("id", F.greatest("colour", "_c").alias("colour"), (F.coalesce("_c", "colour") > F.col("colour")).alias("_moved")))
        colour, moved = new.select("id", "colour"), new.filter("_moved").select("id", "colour")
        if moved.isEmpty():
            return colour


def cycle_components(edges: DataFrame) -> DataFrame:
    """(id, component): the nodes that lie on cycles, with the least id of their strongly connected component.

    Ends of paths are trimmed and chains are contracted, both in rounds, so trees and long chains take few of them (as many
    as the logarithm of a chain's length). What is left is coloured forward by the greatest id that leads to a node; the nodes of a
    colour from which its namesake can be reached backward are its component. Edges between colours lie on no
    cycle and go, and so does what has been found, until nothing is left.
    """
    edges = cut(edges.select("src_id", "dst_id").distinct())
    loops = edges.filter("src_id = dst_id").select(F.col("src_id").alias("id"))
    left = cut(edges.filter("src_id != dst_id"))
    chains: list[DataFrame] = []
    found: list[DataFrame] = []
    n = left.count()
    while n:
        while n:  # trim and contract
            trimmed = cut(_trimmed(left))
            short = cut(_shortcuts(trimmed, len(chains)))
            some = not short.isEmpty()
            if some:
                chains.append(short)
                gone = short.select("id")
                kept = trimmed.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").select("src_id", "dst_id")
                new = short.select(F.col("before").alias("src_id"), F.col("after").alias("dst_id"))
                loops = loops.union(new.filter("src_id = dst_id").select("src_id"))
                trimmed = cut(kept.union(new.filter("src_id != dst_id")).distinct())
            m = trimmed.count()
            left, n, before = trimmed, m, n
            if not some and m == before:
                break
        if not n:
            break
        colour = _colours(left)
        side = lambda c: colour.withColumnsRenamed({"id": c, "colour": f"_{c}"})
        inner = cut(left.join(side("src_id"), "src_id").join(side("dst_id"), "dst_id").filter("_src_id = _dst_id").select("src_id", "dst_id"))
        roots = colour.filter("id = colour").select(F.col("colour").alias("root"))
        part = cut(reachable(inner, roots, forward=False).withColumnRenamed("root", "component"))
        several = part.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("component")
        found.append(part.join(several, "component", "left_semi").select("id", "component"))
        done = part.select("id")
        left = cut(inner.join(done.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(done.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti").select("src_id", "dst_id"))
        n = left.count()
    out = cut(loops.distinct().withColumn("component", F.col("id")))
    for part in found:
        out = out.join(part.select("id"), "id", "left_anti").unionByName(part.select("id", "component"))
    out = cut(out)
    for short in reversed(chains):  # what was left out lies on a cycle if both its neighbours lie on one and the same
        ends = short.join(out.select(F.col("id").alias("before"), "component"), "before").join(out.select(F.col("id").alias("after"), F.col("component").alias("_c")), "after").filter("component = _c")
        out = cut(out.unionByName(ends.select("id", "component")))
    least = out.groupBy("component").agg(F.min("id").alias("_least"))
    return out.join(least, "component").select("id", F.col("_least").alias("component"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """(id): the nodes that lie on a cycle."""
    return cycle_components(edges).select("id")


def prerequisite_chain(edges: DataFrame, roots: DataFrame, min_depth_only: bool = False) -> DataFrame:
    """(root, id, depth): every depth at which a node occurs below a root, or the least one only.

    No path without repeats has as many steps as there are nodes; where a cycle goes on beyond that, every depth
    would be without end, so it is an error. The least depths exist with cycles too.
    """
    step = cut(edges.select(F.col("dst_id").alias("id"), F.col("src_id").alias("next")).distinct())
    nodes = step.select("id").union(step.select("next")).distinct().count()
    level = cut(roots.select("root", F.col("root").alias("id")).distinct())
    out = level.withColumn("depth", F.lit(0)).filter("depth > 0")
    depth = 0
    while True:
        depth += 1
        level = level.join(step, "id").select("root", F.col("next").alias("id")).distinct()
        level = cut(level.join(out.select("root", "id"), ["root", "id"], "left_anti") if min_depth_only else level)
        if level.isEmpty():
            return out
        if depth > nodes and not min_depth_only:
            raise ValueError("prerequisite_chain: the edges hold a cycle")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
        if depth % 25 == 0:
            out = cut(out)  # a plan of a few unions


def course_subtree(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(id): a course, all below it by part_of, the LOs that those teach, and topics that are only about the subtree."""
    spark = edges.sparkSession
    part = edges.filter("edge_type = 'part_of'").select("src_id", "dst_id")
    below = reachable(part, spark.createDataFrame([(root,)], "root string"), forward=False).select("id")
    inner = below.union(edges.filter("edge_type = 'teaches'").join(below.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select("dst_id")).distinct()
    about = edges.filter("edge_type = 'about'")
    known = about.join(inner.select(F.col("id").alias("src_id"), F.lit(True).alias("_in")), "src_id", "left")
    topics = known.groupBy(F.col("dst_id").alias("id")).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("_all")).filter("_all").select("id")
    return inner.union(topics).distinct()


def node_subject(nodes: DataFrame, edges: DataFrame, current_only: bool = False) -> DataFrame:
    """(lo_id, subject) by LO <- teaches - module - part_of -> course; closed edges count unless ``current_only``."""
    e = edges.filter("system_to IS NULL") if current_only else edges
    t = e.filter("edge_type = 'teaches'").select(F.col("src_id").alias("module_id"), F.col("dst_id").alias("lo_id"))
    p = e.filter("edge_type = 'part_of'").select(F.col("src_id").alias("module_id"), F.col("dst_id").alias("course_id"))
    lo = nodes.filter("kind = 'learning_objective'").select(F.col("id").alias("lo_id"))
    course = nodes.filter("kind = 'course'").select(F.col("id").alias("course_id"), "subject")
    return lo.join(t, "lo_id").join(p, "module_id").join(course, "course_id").select("lo_id", "subject")


def lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every LO with its module and course (null where an edge is missing); conditions sit on the joined sides, so no LO is lost."""
    t = edges.filter("edge_type = 'teaches' AND system_to IS NULL").select(F.col("src_id").alias("_m"), F.col("dst_id").alias("lo_id"))
    m = nodes.filter("kind = 'module'").select(F.col("id").alias("_m"), F.col("id").alias("module_id"), F.col("label").alias("module_label"), F.col("order_in_parent").alias("module_order"))
    p = edges.filter("edge_type = 'part_of' AND system_to IS NULL").select(F.col("src_id").alias("module_id"), F.col("dst_id").alias("_c"))
    c = nodes.filter("kind = 'course'").select(F.col("id").alias("_c"), F.col("id").alias("course_id"), F.col("label").alias("course_label"), "subject")
    lo = nodes.filter("kind = 'learning_objective'").select(F.col("id").alias("lo_id"), "label", "order_in_parent")
    return lo.join(t, "lo_id", "left").join(m, "_m", "left").join(p, "module_id", "left").join(c, "_c", "left").drop("_m", "_c")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, prerequisites): sorted list of direct predecessors."""
    return edges.groupBy(F.col("dst_id").alias("id")).agg(F.array_sort(F.collect_set("src_id")).alias("prerequisites"))


def eligibility(los: DataFrame, prerequisites: DataFrame, scores: DataFrame, gate: float = 0.5) -> DataFrame:
    """(student_id, lo_id, eligible): all prerequisites reach the gate; a missing score is 0, no prerequisites is eligible.

    ``los`` is (student_id, lo_id), ``scores`` is (student_id, lo_id, score).
    """
    pre = prerequisites.select(F.col("dst_id").alias("lo_id"), F.col("src_id").alias("pre_id"))
    got = los.join(pre, "lo_id").join(scores.select("student_id", F.col("lo_id").alias("pre_id"), "score"), ["student_id", "pre_id"], "left")
    met = got.groupBy("student_id", "lo_id").agg(F.bool_and(F.coalesce("score", F.lit(0.0)) >= gate).alias("_met"))
    return los.join(met, ["student_id", "lo_id"], "left").select("student_id", "lo_id", F.coalesce("_met", F.lit(True)).alias("eligible"))


def consecutive_edges(series: DataFrame, present: DataFrame, partition: list[str], order: list[str], id_col: str) -> DataFrame:
    """Edges between neighbours of an ordered series, without repeats, where both ends are present."""
    nxt = series.withColumn("dst_id", F.lead(id_col).over(Window.partitionBy(*partition).orderBy(*order)))
    pairs = nxt.filter("dst_id IS NOT NULL").select(F.col(id_col).alias("src_id"), "dst_id").distinct()
    return both_present(pairs, present)


def both_present(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    ids = nodes.select("id", F.lit(True).alias("_is"))
    src = ids.withColumnsRenamed({"id": "src_id", "_is": "_s"})
    dst = ids.withColumnsRenamed({"id": "dst_id", "_is": "_d"})
    return edges.join(src, "src_id", "left").join(dst, "dst_id", "left").filter("_s IS NULL OR _d IS NULL").select(*edges.columns)


def far_ends(bridges: DataFrame, here: DataFrame, subjects: DataFrame) -> DataFrame:
    """For each bridge that touches the set ``here`` (id): (this_id, other_id, rationale, subject), once for each pair; a bridge inside the set counts from its source; ends without a subject go."""
    s = here.select(F.col("id").alias("src_id"), F.lit(True).alias("_s"))
    d = here.select(F.col("id").alias("dst_id"), F.lit(True).alias("_d"))
    touched = bridges.join(s, "src_id", "left").join(d, "dst_id", "left").filter("_s OR _d")
    from_src = F.coalesce("_s", F.lit(False))
    oriented = touched.select("id", "rationale", F.when(from_src, F.col("src_id")).otherwise(F.col("dst_id")).alias("this_id"), F.when(from_src, F.col("dst_id")).otherwise(F.col("src_id")).alias("other_id"))
    once = oriented.groupBy("this_id", "other_id").agg(F.min_by("rationale", "id").alias("rationale"))
    known = subjects.filter("subject IS NOT NULL").groupBy("lo_id").agg(F.min("subject").alias("subject"))
    return once.join(known.withColumnRenamed("lo_id", "other_id"), "other_id").select("this_id", "other_id", "rationale", "subject")


def pinned(expr: Column) -> Column:
    """Sort key that puts rows for which ``expr`` holds first."""
    return F.coalesce(expr, F.lit(False)).desc()


def barycentric_order(nodes: DataFrame, edges: DataFrame, layered: DataFrame) -> DataFrame:
    """(id, layer, position): within each layer by the mean position of placed predecessors (the layer's middle without any), then order and id.

    Layer after layer, since each depends on the one above; rows stay in tables.
    """
    edges = cut(edges.select("src_id", "dst_id"))
    info = cut(nodes.join(layered, "id").select("id", "layer", "order_in_parent"))
    sizes = cut(info.groupBy("layer").agg(F.count(F.lit(1)).alias("_n")))
    placed = None
    for layer in sorted(r[0] for r in sizes.filter("layer IS NOT NULL").select("layer").collect()):
        here = info.filter(F.col("layer") == layer).join(sizes, "layer")
        mid = (F.col("_n") - 1) / 2
        if placed is not None:
            bary = edges.join(placed.select(F.col("id").alias("src_id"), "position"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.avg("position").alias("_b"))
            here = here.join(bary, "id", "left")
        else:
            here = here.withColumn("_b", F.lit(None).cast("double"))
        rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.coalesce("_b", mid), "order_in_parent", "id")) - 1
        row = cut(here.select("id", "layer", rank.alias("position")))
        placed = row if placed is None else cut(placed.unionByName(row))
    return placed if placed is not None else info.select("id", "layer", F.lit(0).alias("position"))


def merge_installments(rules: DataFrame, key: str, clauses: str, order: str) -> DataFrame:
    """Join the clause lists of all installments of a topic in their order."""
    return rules.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, clauses))), lambda r: r[clauses])).alias(clauses), F.count(F.lit(1)).alias("installments"))
