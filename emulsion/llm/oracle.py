"""DuckDB SQL of the queries that SQL can express on whole tables.

Decontamination: a stretch of 13 aligned words with at most two substitutions always holds four equal words in a row, so
joining all runs of four words proposes every alignment; the count of equal words in each stretch then decides, as in the definition.
The other operators are learned, sequential or set-valued and are tested against brute force.
"""

OP7 = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
b AS (SELECT * FROM bw WHERE len(w) >= 8),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 2)) AS p, w FROM dw WHERE len(w) >= 8),
dh AS (SELECT doc_id, p, hash(w[p], w[p + 1], w[p + 2], w[p + 3]) AS h FROM dg),
bg AS (SELECT item_id, unnest(range(1, len(w) - 2)) AS q, w FROM b),
bh AS (SELECT item_id, q, hash(w[q], w[q + 1], w[q + 2], w[q + 3]) AS h FROM bg),
cand AS (SELECT DISTINCT dh.doc_id, bh.item_id, dh.p - bh.q AS g FROM dh JOIN bh ON dh.h = bh.h),
same AS (
  SELECT c.doc_id, c.item_id, c.g, len(b.w) AS m,
         list_transform(range(1, len(b.w) + 1), lambda q: CASE WHEN c.g + q >= 1 AND c.g + q <= len(dw.w) AND b.w[q] = dw.w[c.g + q] THEN 1 ELSE 0 END) AS s
  FROM cand c JOIN b ON b.item_id = c.item_id JOIN dw ON dw.doc_id = c.doc_id),
leak AS (
  SELECT DISTINCT doc_id, item_id FROM same
  WHERE list_max(list_transform(range(1, greatest(m - 13, 0) + 2), lambda i: list_sum(s[i:i + least(m, 13) - 1]))) >= CASE WHEN m >= 13 THEN 11 ELSE m END),
agg AS (SELECT doc_id, list_sort(list(item_id)) AS item_ids FROM leak GROUP BY doc_id)
SELECT d.doc_id, a.item_ids IS NOT NULL AS contaminated, CAST(coalesce(len(a.item_ids), 0) AS BIGINT) AS n_items, coalesce(a.item_ids, CAST([] AS BIGINT[])) AS item_ids
FROM documents d LEFT JOIN agg a USING (doc_id)
"""

ORACLES = {"op7_benchmark_decontamination": OP7}
