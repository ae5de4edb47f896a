"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from skeinwork.llm.decontamination import ORACLE as OP12
from skeinwork.llm.decontamination import op12_decontamination
from skeinwork.llm.html_blocks import op4_html
from skeinwork.llm.line_dedup import op10_line_dedup
from skeinwork.llm.merkle import ORACLE as OP11
from skeinwork.llm.merkle import op11_merkle
from skeinwork.llm.mixing import op2_mixing
from skeinwork.llm.packing import op3_packing
from skeinwork.llm.quality import op5_quality
from skeinwork.llm.sharding import op6_sharding, oracle_key_law
from skeinwork.llm.simhash import op8_simhash
from skeinwork.llm.suffix_dedup import op7_suffix_dedup
from skeinwork.llm.topk import op9_topk
from skeinwork.llm.toxicity import op1_toxicity


def queries() -> dict:
    found = (op1_toxicity, op2_mixing, op3_packing, op4_html, op5_quality, op6_sharding, op7_suffix_dedup, op8_simhash, op9_topk, op10_line_dedup, op11_merkle, op12_decontamination)
    return {f.__name__: f for f in found}


#: The main text is what the article element holds: here, where pages are alike, a regular expression can say so.
OP4 = """WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
  t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM a)
  SELECT *, length(text) AS n_chars FROM t"""

#: All 100-byte strings of all texts; those that are there before go, and what isn't covered stays.
OP7 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT *, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
  f AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY s) AS first FROM w),
  g AS (SELECT doc_id, i, i > coalesce(lag(i) OVER p, -200) + 100 AS new FROM f WHERE (doc_id, i) <> first WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
  n AS (SELECT doc_id, a, b, coalesce(lag(b) OVER p, 0) AS before, lead(a) OVER p IS NULL AS last FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY a)),
  k AS (SELECT n.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM n JOIN d ON d.doc_id = n.doc_id GROUP BY n.doc_id)
  SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
  FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
  r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
  SELECT * FROM r WHERE rank <= 5"""

#: Every maximal repeated run of 50 words is the union of the shortest runs of 50 words that begin, or end, at its lines.
OP10 = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
  l AS (SELECT doc_id, text, p, string_split(text, chr(10))[p] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM d)),
  n AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
  c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id, text ORDER BY p) AS BIGINT) AS e FROM n WHERE n > 0),
  w AS (SELECT doc_id, text, min(p) OVER f AS a, max(p) OVER f AS b, list(line) OVER f AS run, max(e) OVER f - (e - n) AS words FROM c WINDOW f AS (PARTITION BY doc_id, text ORDER BY e - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION ALL SELECT doc_id, text, min(p) OVER f, max(p) OVER f, list(line) OVER f, e - min(e - n) OVER f FROM c WINDOW f AS (PARTITION BY doc_id, text ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
  k AS (SELECT *, min((doc_id, a)) OVER (PARTITION BY run) AS first FROM w WHERE words >= 50),
  g AS (SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS p FROM k WHERE (doc_id, a) <> first),
  x AS (SELECT n.doc_id, n.text, coalesce(string_agg(line, chr(10) ORDER BY n.p) FILTER (WHERE g.p IS NULL OR n.n = 0), '') AS kept, count(*) FILTER (WHERE g.p IS NOT NULL AND n.n > 0) AS gone
    FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.text = n.text AND g.p = n.p GROUP BY n.doc_id, n.text)
  SELECT d.doc_id, CASE WHEN gone > 0 THEN kept ELSE d.text END AS text, coalesce(gone, 0) AS n_lines_removed FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id AND x.text = d.text"""


def oracle_sql() -> dict[str, str]:
    return {"op4_html": OP4, "op6_sharding": oracle_key_law(), "op7_suffix_dedup": OP7, "op9_topk": OP9, "op10_line_dedup": OP10, "op11_merkle": OP11, "op12_decontamination": OP12}
