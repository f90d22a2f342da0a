"""The corpus queries that SQL can express, for an independent engine."""

from __future__ import annotations

_FINITE = (
    "list_bool_and(list_append(list_transform(embedding, "
    "lambda x: x IS NOT NULL AND isfinite(x)), true))"
)

HARD_NEGATIVES = f"""
WITH kept AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS alike,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM kept a JOIN kept r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER first AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW first AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER first <= 10
"""


def _round(n: int) -> str:
    """Distances to the centroids of a round, the nearest of each vector, and the next centroids."""
    return f"""
, near{n} AS (
    SELECT r, c, sum((x - y) * (x - y)) AS distance
    FROM comp JOIN (SELECT c, i, x AS y FROM centroid{n}) USING (i)
    GROUP BY r, c
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1
), centroid{n + 1} AS (
    SELECT c, i, coalesce(m.x, o.x) AS x
    FROM centroid{n} o LEFT JOIN (
        SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
        FROM near{n} JOIN comp USING (r) GROUP BY c, i
    ) m USING (c, i)
)"""


CLUSTERS = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS r, vec_id, embedding
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_FINITE}
), comp AS (
    SELECT r, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
    FROM kept, range(1, 65) AS t(i)
), centroid0 AS (
    SELECT r - 1 AS c, i, x FROM comp WHERE r <= 16
){_round(0)}{_round(1)}{_round(2)}{_round(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near3 JOIN kept USING (r) JOIN (
    SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
    FROM centroid3 GROUP BY c
) USING (c)
"""

# Texts as hexadecimal bytes, so that byte n stands at characters 2n and 2n + 1.
REPEATS = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS piece
    FROM texts, LATERAL (SELECT unnest(range(0, len(h) // 2 - 49)) AS i)
), covered AS (
    SELECT doc_id, i FROM starts JOIN (
        SELECT piece, min(doc_id) AS first_id FROM starts GROUP BY piece
    ) USING (piece) WHERE first_id < doc_id
), marked AS (
    SELECT doc_id, i,
           i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS opens
    FROM covered
), runs AS (
    SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM marked
), spans AS (
    SELECT doc_id, min(i) AS first_byte, max(i) + 50 AS end_byte FROM runs GROUP BY doc_id, run
), pieces AS (
    SELECT doc_id, first_byte, end_byte,
           coalesce(lag(end_byte) OVER (PARTITION BY doc_id ORDER BY first_byte), 0) AS kept_from
    FROM spans
), kept AS (
    SELECT doc_id, count(*) AS n_spans, sum(end_byte - first_byte) AS n_removed,
           string_agg(substr(h, 2 * kept_from + 1, 2 * (first_byte - kept_from)), '' ORDER BY first_byte)
               || substr(any_value(h), 2 * max(end_byte) + 1) AS rest
    FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

_COMPONENTS = """
reach(node, root) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT b, root FROM reach JOIN links ON a = node
), least AS (
    SELECT node AS id, min(root) AS component_id FROM reach GROUP BY node
)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), nodes AS (
    SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3),
            lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles
    FROM words
), each_one AS (
    SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM nodes
), links AS (
    SELECT x.id AS a, y.id AS b FROM each_one x JOIN each_one y USING (shingle)
    WHERE x.id <> y.id
    GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), {_COMPONENTS}
SELECT id AS doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id,
       id = component_id AS kept
FROM nodes JOIN least USING (id)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (
    SELECT vec_id AS id, embedding IS NOT NULL AND {_FINITE} AS usable,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings
), whole AS (
    SELECT id, v FROM nodes WHERE usable AND list_inner_product(v, v) > 0
), links AS (
    SELECT x.id AS a, y.id AS b FROM whole x JOIN whole y
      ON x.id <> y.id AND len(x.v) = len(y.v)
     AND list_inner_product(x.v, y.v)
         >= 0.95e0 * sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))
), {_COMPONENTS}
SELECT id AS vec_id, CAST((SELECT count(*) FROM links WHERE a = id) AS BIGINT) AS n_links,
       component_id, id = component_id AS kept
FROM nodes JOIN least USING (id)
"""

SQL = {
    "op1_suffix_dedup": REPEATS,
    "op4_minhash_bbit": NEAR_DUPLICATES,
    "op6_multi_index": NEAR_VECTORS,
    "op12_angular_negatives": HARD_NEGATIVES,
    "op13_va_file": CLUSTERS,
}
