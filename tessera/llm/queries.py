"""Queries of this subpackage."""

from __future__ import annotations

import importlib

NAMES = {
    "op1_secret_scan": "secrets", "op2_top_k": "vectors", "op3_substring_dedup": "substrings", "op4_quality": "quality", "op5_token_files": "token_files", "op6_bpe": "bpe", "op7_resharding": "resharding", "op8_mixing": "mixing", "op9_nearest": "vectors", "op10_near_dedup": "minhash", "op11_sentencepiece": "sentencepieces", "op12_ranked_search": "ranked", "op13_spelling": "spelling",
}


def queries():
    import corpus_pipeline

    out = {name: getattr(importlib.import_module(f"tessera.llm.{module}"), name) for name, module in NAMES.items()}
    return {**out, "pipeline": corpus_pipeline.run}


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {kind} AS kind, CAST({at} AS BIGINT) AS start, CAST({at} + length(m[i]) AS BIGINT) AS "end" FROM (
      SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
      WHERE length(v[i]) >= {least}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""

OP1 = f"""WITH s AS ({_spans(0, _ASSIGN, 2, 6)} UNION ALL {_spans(1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans(2, "[0-9a-f]+", 0, 24)}),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)"""

OP2 = """WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.n != c.n WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""

OP3 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 19], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS i FROM w WHERE len(l) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(20) r(k)),
word AS (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
s AS (SELECT count(*) AS docs, sum(len(l)) AS terms FROM d WHERE len(l) > 0),
p AS (SELECT r, doc_id, len(l) AS n, unnest(l) AS term FROM d), tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
q AS (SELECT DISTINCT i, item_id, unnest(l) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM benchmark)),
x AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10"""

#: crc32 byte by byte over a table that a recursion makes; a run's letters above 0x7F are two UTF-8 bytes. Near pairs meet by what is left without one character.
OP13 = rf"""WITH RECURSIVE step(b, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
run AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
code AS (SELECT run, n, list_transform(range(1, length(key) + 1), lambda i: CAST(unicode(key[i]) AS BIGINT)) AS u FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM run)),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))), lambda a, c: xor(a >> 8, t[xor(a & 255, c) + 1])), 4294967295) AS h FROM code, crc),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-b_n, b)) AS b, max(b_n) AS b_n FROM pair GROUP BY a),
form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * n THEN b END AS form, CASE WHEN b_n >= 2 * n THEN b_n END AS form_n FROM word LEFT JOIN best ON a = word),
walk(word, root, k) AS (SELECT word, word, 0 FROM form UNION ALL SELECT walk.word, form.form, k + 1 FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word) USING (word)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against plain versions of their contracts."""
    return {"op1_secret_scan": OP1, "op2_top_k": OP2, "op3_substring_dedup": OP3, "op12_ranked_search": OP12, "op13_spelling": OP13}
