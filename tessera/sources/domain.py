"""The learning-graph domain over the synthetic star schema.

region, nation, customer and orders stand for courses, modules, learning objectives (LOs) and
questions; events for attempts, parts for visuals, conversations for a chat ledger. ``PRELUDE``
states the same tables as SQL, for oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import temporal

LO = "concat('lo:u', c_nationkey, '-', c_custkey % 3 + 1, '-', c_custkey)"
FROM = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


class Tables:
    """Lazy domain tables of one folder; each is a plan, read when it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lo_keys(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey AS k", f"{LO} AS lo_id", "c_nationkey")

    @cached_property
    def nodes(self) -> DataFrame:
        course = self.raw("region").selectExpr("concat('c:', r_regionkey) AS id", "'course' AS kind", "r_name AS label", "r_regionkey AS order_in_parent", "CASE WHEN r_regionkey < 4 THEN lower(r_name) END AS subject")
        module = self.raw("nation").selectExpr("concat('m:', n_nationkey) AS id", "'module' AS kind", "n_name AS label", "n_nationkey AS order_in_parent", "CAST(NULL AS STRING) AS subject")
        lo = self.raw("customer").selectExpr(f"{LO} AS id", "'learning_objective' AS kind", "c_name AS label", "CAST(c_custkey % 10 AS INT) AS order_in_parent", "CAST(NULL AS STRING) AS subject")
        return course.unionByName(module).unionByName(lo)

    def _edges(self, df: DataFrame, id_: str, src: str, dst: str, kind: str, k: str, closed: bool = False, rationale: str = "CAST(NULL AS STRING)") -> DataFrame:
        return df.selectExpr(f"CAST({id_} AS BIGINT) AS id", f"{src} AS src_id", f"{dst} AS dst_id", f"'{kind}' AS edge_type", f"concat('v', {k} % 3) AS syllabus_version", f"{FROM} + make_interval(0, 0, 0, CAST({k} % 28 AS INT)) AS system_from", f"{f'{FROM} + make_interval(0, 0, 0, CAST({k} % 28 + 5 AS INT))' if closed else 'CAST(NULL AS TIMESTAMP_NTZ)'} AS system_to", f"{rationale} AS rationale")

    @cached_property
    def edges(self) -> DataFrame:
        cust, keys = self.raw("customer"), self.lo_keys
        parts = [
            self._edges(self.raw("nation"), "n_nationkey", "concat('m:', n_nationkey)", "concat('c:', n_regionkey)", "part_of", "n_nationkey"),
            self._edges(cust, "c_custkey + 1000", "concat('m:', c_nationkey)", LO, "teaches", "c_custkey"),
            self._edges(cust.filter("c_custkey % 13 = 0"), "c_custkey + 10000000", "concat('m:', (c_nationkey + 1) % 25)", LO, "teaches", "c_custkey", closed=True),
        ]
        child = keys.filter("k > 0").selectExpr("k AS child", "lo_id AS dst", "(k - 1) div 2 AS parent").join(keys.selectExpr("k AS parent", "lo_id AS src"), "parent")
        parts.append(self._edges(child, "child + 20000000", "src", "dst", "prerequisite", "child"))
        bridge = keys.filter("k % 10 = 0").selectExpr("k", "lo_id AS src", "k * 7 + 3 AS far").join(keys.selectExpr("k AS far", "lo_id AS dst"), "far", "left")
        parts.append(self._edges(bridge, "k + 30000000", "src", "coalesce(dst, concat('lo:gone-', k))", "relates_to", "k", rationale="concat('r', k)"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def current(self) -> DataFrame:
        return temporal.current(self.edges)

    @cached_property
    def questions(self) -> DataFrame:
        q = self.raw("orders").selectExpr(
            "concat('q:', o_orderkey) AS id", "o_custkey AS k", "CASE WHEN o_orderpriority < '3' THEN 'basic' WHEN o_orderpriority < '4' THEN 'standard' ELSE 'advanced' END AS tier",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'mcq' ELSE 'numeric' END AS question_type", "CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'review' ELSE 'draft' END AS status",
            "CAST(o_orderkey % 7 AS STRING) AS correct_answer", "CAST(o_orderkey % 200 AS INT) AS source_page", "CAST(o_orderkey % 5 AS BIGINT) AS run_id", "o_orderdate AS created_at",
        )
        return q.join(self.lo_keys.select("k", "lo_id"), "k").drop("k")

    @cached_property
    def runs(self) -> DataFrame:
        return self.spark.range(4).selectExpr("id", "concat('x', id) AS extractor")

    @cached_property
    def attempts(self) -> DataFrame:
        a = self.raw("events").selectExpr("event_id AS id", "user_id AS student_id", "CAST(get_json_object(props, '$.k') AS BIGINT) % 25 AS k", "concat('q:', event_id % 1000) AS question_id", "CAST(event_id % 7 AS STRING) AS given_answer", "value > 50 AS is_correct", "event_id div 100 AS session_id", "ts AS attempted_at")
        return a.join(F.broadcast(self.lo_keys.filter("k < 25").select("k", "lo_id")), "k").drop("k")

    @cached_property
    def students(self) -> DataFrame:
        return self.raw("events").selectExpr("user_id AS id").distinct().selectExpr("id", "concat('Student ', id) AS display_name")

    @cached_property
    def mastery(self) -> DataFrame:
        return temporal.mastery_history(self.attempts, ["student_id", "lo_id"])

    @cached_property
    def visuals(self) -> DataFrame:
        v = self.raw("part").selectExpr("concat('v:', p_partkey) AS id", "p_partkey % 150 AS k", "lower(p_type) AS kind", "p_name AS caption", "p_size AS source_page")
        return v.join(self.lo_keys.select("k", "lo_id"), "k").drop("k")

    @cached_property
    def checks(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'purchase'").selectExpr("event_id AS id", "user_id AS student_id", "CAST(least(100, floor(value)) AS INT) AS score", "CASE event_id % 5 WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' WHEN 3 THEN 'europe' END AS subject", "ts AS created_at")

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations").selectExpr("conv_id", "turn", "role", "text", "CASE WHEN conv_id % 4 = 0 THEN 'spine' WHEN conv_id % 4 = 1 THEN 'learn' WHEN conv_id % 4 = 2 THEN 'review' ELSE 'explain' END AS surface", "conv_id % 7 AS student_id", "CASE WHEN turn % 3 != 2 THEN CAST(length(text) / 1000.0 AS DOUBLE) END AS cost_usd")

    @cached_property
    def node_subject(self) -> DataFrame:
        from tessera.operators import graph

        return graph.node_subject(self.nodes, self.edges)


#: The same tables for oracles (DuckDB SQL over the raw tables).
PRELUDE = """
WITH RECURSIVE lo_keys AS (SELECT c_custkey AS k, 'lo:u' || c_nationkey || '-' || (c_custkey % 3 + 1) || '-' || c_custkey AS lo_id, c_nationkey FROM customer),
nodes AS (
  SELECT 'c:' || r_regionkey AS id, 'course' AS kind, r_name AS label, r_regionkey AS order_in_parent, CASE WHEN r_regionkey < 4 THEN lower(r_name) END AS subject FROM region
  UNION ALL SELECT 'm:' || n_nationkey, 'module', n_name, n_nationkey, NULL FROM nation
  UNION ALL SELECT lo_id, 'learning_objective', c_name, CAST(c_custkey % 10 AS INT), NULL FROM customer JOIN lo_keys ON k = c_custkey),
raw_edges AS (
  SELECT n_nationkey AS id, 'm:' || n_nationkey AS src_id, 'c:' || n_regionkey AS dst_id, 'part_of' AS edge_type, n_nationkey AS k, FALSE AS closed, CAST(NULL AS VARCHAR) AS rationale FROM nation
  UNION ALL SELECT k + 1000, 'm:' || c_nationkey, lo_id, 'teaches', k, FALSE, NULL FROM lo_keys
  UNION ALL SELECT k + 10000000, 'm:' || ((c_nationkey + 1) % 25), lo_id, 'teaches', k, TRUE, NULL FROM lo_keys WHERE k % 13 = 0
  UNION ALL SELECT c.k + 20000000, p.lo_id, c.lo_id, 'prerequisite', c.k, FALSE, NULL FROM lo_keys c JOIN lo_keys p ON p.k = (c.k - 1) // 2 WHERE c.k > 0
  UNION ALL SELECT a.k + 30000000, a.lo_id, coalesce(b.lo_id, 'lo:gone-' || a.k), 'relates_to', a.k, FALSE, 'r' || a.k FROM lo_keys a LEFT JOIN lo_keys b ON b.k = a.k * 7 + 3 WHERE a.k % 10 = 0),
edges AS (
  SELECT CAST(id AS BIGINT) AS id, src_id, dst_id, edge_type, 'v' || (k % 3) AS syllabus_version, TIMESTAMP '2024-01-01' + to_days(CAST(k % 28 AS INT)) AS system_from,
    CASE WHEN closed THEN TIMESTAMP '2024-01-01' + to_days(CAST(k % 28 + 5 AS INT)) END AS system_to, rationale FROM raw_edges),
cur AS (SELECT * FROM edges WHERE system_to IS NULL),
questions AS (
  SELECT 'q:' || o_orderkey AS id, lo_id, CASE WHEN o_orderpriority < '3' THEN 'basic' WHEN o_orderpriority < '4' THEN 'standard' ELSE 'advanced' END AS tier,
    CASE WHEN o_orderkey % 2 = 0 THEN 'mcq' ELSE 'numeric' END AS question_type, CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'review' ELSE 'draft' END AS status,
    CAST(o_orderkey % 7 AS VARCHAR) AS correct_answer, CAST(o_orderkey % 200 AS INT) AS source_page, CAST(o_orderkey % 5 AS BIGINT) AS run_id, o_orderdate AS created_at
  FROM orders JOIN lo_keys ON k = o_custkey),
runs AS (SELECT range AS id, 'x' || range AS extractor FROM range(4)),
attempts AS (
  SELECT event_id AS id, user_id AS student_id, lo_id, 'q:' || (event_id % 1000) AS question_id, CAST(event_id % 7 AS VARCHAR) AS given_answer, value > 50 AS is_correct, event_id // 100 AS session_id, ts AS attempted_at
  FROM events JOIN lo_keys ON k = CAST(json_extract_string(props, '$.k') AS BIGINT) % 25),
students AS (SELECT DISTINCT user_id AS id, 'Student ' || user_id AS display_name FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY student_id, lo_id ORDER BY attempted_at, id) AS n FROM attempts),
folded AS (
  SELECT student_id, lo_id, n, attempted_at, least(0.98, greatest(0.02, 0.3::DOUBLE + 0.15 * ((CASE WHEN is_correct THEN 1 ELSE 0 END) - 0.3::DOUBLE))) AS score FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.student_id, x.lo_id, x.n, x.attempted_at, least(0.98, greatest(0.02, f.score + 0.15 * ((CASE WHEN x.is_correct THEN 1 ELSE 0 END) - f.score)))
  FROM folded f JOIN numbered x ON x.student_id = f.student_id AND x.lo_id = f.lo_id AND x.n = f.n + 1),
mastery AS (SELECT student_id, lo_id, n, score, attempted_at AS system_from, lead(attempted_at) OVER (PARTITION BY student_id, lo_id ORDER BY n) AS system_to FROM folded),
visuals AS (SELECT 'v:' || p_partkey AS id, lo_id, lower(p_type) AS kind, p_name AS caption, p_size AS source_page FROM part JOIN lo_keys ON k = p_partkey % 150),
checks AS (
  SELECT event_id AS id, user_id AS student_id, CAST(least(100, floor(value)) AS INT) AS score, CASE event_id % 5 WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' WHEN 3 THEN 'europe' END AS subject, ts AS created_at
  FROM events WHERE event_type = 'purchase'),
turns AS (
  SELECT conv_id, turn, role, text, CASE WHEN conv_id % 4 = 0 THEN 'spine' WHEN conv_id % 4 = 1 THEN 'learn' WHEN conv_id % 4 = 2 THEN 'review' ELSE 'explain' END AS surface, conv_id % 7 AS student_id,
    CASE WHEN turn % 3 != 2 THEN CAST(length(text) / 1000.0 AS DOUBLE) END AS cost_usd FROM conversations),
node_subject AS (
  SELECT lo.id AS lo_id, c.subject FROM nodes lo JOIN edges t ON t.dst_id = lo.id AND t.edge_type = 'teaches' JOIN edges p ON p.src_id = t.src_id AND p.edge_type = 'part_of' JOIN nodes c ON c.id = p.dst_id AND c.kind = 'course' WHERE lo.kind = 'learning_objective')
"""
