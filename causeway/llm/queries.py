"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .crosstok import op11_crosstok
from .decontam import op2_decontam
from .html_cut import op9_html
from .knn_join import op4_knn_join
from .langid import op5_langid
from .secrets import op3_secret_scans
from .sharding import op10_sharding
from .simhash import op6_simhash
from .spelling import op12_spelling
from .toxicity import op7_toxicity
from .urlfilter import op13_urlfilter
from .warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontam": op2_decontam,
    "op3_secret_scans": op3_secret_scans,
    "op4_knn_join": op4_knn_join,
    "op5_langid": op5_langid,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_html": op9_html,
    "op10_sharding": op10_sharding,
    "op11_crosstok": op11_crosstok,
    "op12_spelling": op12_spelling,
    "op13_urlfilter": op13_urlfilter,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        d AS (SELECT *, sha256(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM d
    """,
    "op4_knn_join": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, o.vec_id, CAST(list_sum(list_transform(list_zip(q.v, o.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM e q JOIN e o ON q.vec_id % 50 = 0 AND o.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_spelling": r"""
        WITH RECURSIVE t AS (SELECT list(c ORDER BY b) AS crcs FROM (
            SELECT b, list_reduce(list_value(b, 0, 0, 0, 0, 0, 0, 0, 0), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b))),
        raw AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS k FROM raw GROUP BY ALL),
        hashed AS (SELECT run, k, doc_id, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(
                list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
                lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) END AS h FROM counted, t),
        read AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
        v AS (SELECT word, sum(k)::BIGINT AS n FROM read WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
        near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
                 UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
        w AS (SELECT v.word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS at FROM w UNION ALL SELECT walk.word, w.form FROM walk JOIN w ON walk.at = w.word WHERE w.form IS NOT NULL)
        SELECT w.word, w.form, walk.at AS root, w.n, w.n_near, w.form_n FROM w JOIN walk USING (word) JOIN w e ON e.word = walk.at WHERE e.form IS NULL
    """,
    "op13_urlfilter": """
        WITH r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
        n AS (SELECT *, row_number() OVER () AS i FROM s),
        f AS (SELECT i, first(h || p ORDER BY length(h || p) DESC, h || p) AS rule, first(r.verdict ORDER BY length(h || p) DESC, h || p) AS verdict
              FROM n JOIN r ON (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, p) GROUP BY i)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN f USING (i)
    """,
}
