"""DuckDB SQL for the registered queries of phrase mining, clustering and the Jaccard join."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def phrases(longest: int = 5, least: int = 100, first: int = 2000) -> str:
    grams = "\nUNION ALL ".join(
        f"SELECT lang, {k} AS k, ws[i:i+{k - 1}] AS ws FROM places WHERE i + {k - 1} <= len(ws)" for k in range(1, longest + 1)
    )
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
grams AS ({grams}),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, k, ws HAVING count(*) >= {least}),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
cand AS (SELECT * FROM f WHERE k >= 2),
cuts AS (SELECT lang, phrase, ws, a, k, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, total.n, cuts.c,
         CAST((1000::HUGEINT * cuts.a * total.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ws = cuts.ws[1:c]
  JOIN f y ON y.lang = cuts.lang AND y.ws = cuts.ws[c+1:]
  JOIN total ON total.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
spans AS (SELECT lang, ws, k, a, unnest(range(2, k)) AS m FROM cand),
inside AS (
  SELECT lang, array_to_string(ws[s:s+m-1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS s FROM spans) GROUP BY 1, 2),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {first}
"""


def clusters(k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2") -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v.v AS v, c.c AS c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c.c) = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
      SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {dim + 1})) AS j FROM a{i}) GROUP BY c, j)
    GROUP BY c) n ON n.c = o.c)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS c, v FROM v
  ORDER BY sha256('{salt}:' || vec_id), v LIMIT {k}),
{",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, v AS w FROM c{rounds}) USING (c)
"""


def jaccard(size: int = 4, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i+{size - 1}], ' ')) END) AS sh FROM d),
f AS MATERIALIZED (SELECT min(rid) AS sid, list_sort(sh) AS sh, min(doc_id) AS least, len(list_sort(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
w AS MATERIALIZED (SELECT sid, n, unnest(sh) AS w FROM f),
p AS MATERIALIZED (SELECT a.sid AS x, b.sid AS y FROM w a JOIN w b ON a.w = b.w AND a.sid < b.sid
    AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.sid, b.sid, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT sid AS node, sid AS root FROM f UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
c AS (SELECT node AS sid, min(root) AS root FROM r GROUP BY node),
l AS (SELECT root, min(least) AS component_id FROM c JOIN f USING (sid) GROUP BY root),
m AS (SELECT f.sh, l.component_id FROM c JOIN f USING (sid) JOIN l USING (root))
SELECT s.doc_id, len(s.sh) AS n_shingles, CASE WHEN len(s.sh) > 0 THEN m.component_id ELSE s.doc_id END AS component_id
FROM s LEFT JOIN m ON list_sort(s.sh) = m.sh
"""
