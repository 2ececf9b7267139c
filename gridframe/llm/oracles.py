"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_ASCII = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each_line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split
), keyed AS (
  SELECT doc_id, i, line, {_LOWER_ASCII.format(f"trim(line, {_BLANKS})")} AS k FROM each_line
), repeated AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op12(k: int = 40, rounds: int = 5) -> str:
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
)""",
        """cells AS MATERIALIZED (
  SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM kept
)""",
        f"""c0 AS MATERIALIZED (
  SELECT cid, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM (
    SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS cid FROM kept) WHERE cid < {k}
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, cid, dist FROM (
    SELECT vec_id, cid, sum((cells.v - c.v) * (cells.v - c.v))::BIGINT AS dist
    FROM cells JOIN c{r} c USING (d) GROUP BY vec_id, cid)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid) = 1
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  WITH sums AS (
    SELECT cid, d, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN cells USING (vec_id) GROUP BY cid, d)
  SELECT cid, coalesce((s - ((s % n) + n) % n) // n, v) AS v, d FROM c{r} LEFT JOIN sums USING (cid, d)
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, cid::INTEGER AS cluster, dist AS distance,
  (sum(dist) OVER (PARTITION BY cid))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN (
  SELECT cid, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cid) USING (cid)
"""


OP13 = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda a, b:
      CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS c
    FROM range(256) r(i))
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), runs AS (
  SELECT doc_id, {_LOWER_ASCII.format("run")} AS run, count(*) AS n FROM found GROUP BY ALL
), coded AS (
  SELECT run, n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs
), summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(x), 2), lambda i:
      ((position(x[i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(x[i + 2] IN '0123456789ABCDEF') - 1)::UBIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM coded, crc
), spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word, n FROM summed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS MATERIALIZED (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), forms AS MATERIALIZED (SELECT word, other AS form FROM best WHERE other_n >= 2 * n),
walk AS (
  SELECT word, word AS last FROM words
  UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.last
), roots AS (SELECT word, last AS root FROM walk WHERE last NOT IN (SELECT word FROM forms))
SELECT w.word, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, root, w.n,
  coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
FROM words w JOIN roots USING (word) LEFT JOIN best b USING (word)
"""

ORACLES: dict[str, str] = {"op11_line_dedup": OP11, "op12_centroids": op12(), "op13_variants": OP13}
