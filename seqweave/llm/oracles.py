"""DuckDB statements of the text operators that SQL can express without their methods, by comparing all rows."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Smallest id of each row's component over the edges (a, b) of numbered rows, by walking them.
REACHED = """walk(rid, other) AS (SELECT rid, rid FROM d UNION
    SELECT walk.rid, e.b FROM walk JOIN (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) e ON e.a = walk.other)"""


def jaccard_sql(width: int = 5, percent: int = 80) -> str:
    """Components of documents linked by their word shingles."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (
        SELECT rid, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    edges AS MATERIALIZED (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y
        ON x.s = y.s AND x.rid < y.rid GROUP BY 1, 2) JOIN n p ON p.rid = a JOIN n q ON q.rid = b
        WHERE 100 * c >= {percent} * (p.n + q.n - c)),
    {REACHED}
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
    FROM d LEFT JOIN n ON n.rid = d.rid JOIN walk ON walk.rid = d.rid JOIN d o ON o.rid = walk.other GROUP BY d.rid, d.doc_id"""


def vectors_sql(cosine: float = 0.9) -> str:
    """Links and components of vectors by all cosines; for tables of vectors that all can link."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    edges AS MATERIALIZED (SELECT x.rid AS a, y.rid AS b FROM d x JOIN d y ON x.rid < y.rid
        AND list_cosine_similarity(x.v, y.v) >= {cosine}),
    k AS (SELECT rid, count(*) AS k FROM (SELECT a AS rid FROM edges UNION ALL SELECT b FROM edges) GROUP BY rid),
    {REACHED}
    SELECT d.vec_id, coalesce(any_value(k.k), 0)::BIGINT AS n_links, min(o.vec_id) AS component_id, d.vec_id = min(o.vec_id) AS kept
    FROM d LEFT JOIN k ON k.rid = d.rid JOIN walk ON walk.rid = d.rid JOIN d o ON o.rid = walk.other GROUP BY d.rid, d.vec_id"""


def revisits_sql(least: int = 1000) -> str:
    """Responses and revisits of pages by payload, without writing archives."""
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
        CASE WHEN strlen(h) >= {least} THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS original FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> original THEN original END AS refers_to FROM q"""
