"""DuckDB SQL with the same results, where SQL can say it."""

OP1 = r"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM base),
keyed AS (
  SELECT rid, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
marked AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

OP11 = r"""
WITH RECURSIVE kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
ranked AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM kept),
rounds AS (
  SELECT 0 AS r, c, x FROM ranked WHERE c < 8
  UNION ALL
  SELECT r + 1, c, list(part ORDER BY d) FROM (
    SELECT r, c, d, CASE WHEN n = 0 THEN old ELSE (total - ((total % n) + n) % n) // n END AS part FROM (
      SELECT r, c, d, any_value(old) AS old, count(*) FILTER (WHERE mine) AS n,
        coalesce(sum(v) FILTER (WHERE mine), 0)::BIGINT AS total FROM (
        SELECT r, c, mine, unnest(range(64)) AS d, unnest(x) AS v, unnest(centre) AS old FROM (
          SELECT r, c, x, centre, row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1 AS mine FROM (
            SELECT o.r, o.c, k.rid, k.x, o.x AS centre,
              list_sum(list_transform(list_zip(k.x, o.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
            FROM kept k, rounds o WHERE o.r < 10)))
      GROUP BY r, c, d))
  GROUP BY r, c),
final AS (SELECT c, x FROM rounds WHERE r = 10),
placed AS (
  SELECT vec_id, c, dist, centre FROM (
    SELECT k.rid, k.vec_id, f.c, f.x AS centre,
      list_sum(list_transform(list_zip(k.x, f.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM kept k, final f)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1)
SELECT vec_id, c::INTEGER AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256 FROM placed
"""

OP8 = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 100 = 0) q JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

ORACLES = {"op1_line_dedup": OP1, "op8_top_k": OP8, "op11_centroids": OP11}
