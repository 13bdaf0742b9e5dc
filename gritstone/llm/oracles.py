"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from gritstone.llm.url_filter import HOST_RULES, PATTERN_RULES

_SPACES = r"[\x20\x09-\x0D]+"

OP3 = rf"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g')) AS text_sha256 FROM documents),
 g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

OP1 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)) AS a FROM documents),
 p AS (SELECT doc_id, i, line, string_split(line, ' ') AS t FROM (SELECT doc_id, unnest(range(len(a)))::INT AS i, trim(unnest(a)) AS line FROM d) WHERE line <> ''),
 k AS (SELECT doc_id, i, len(t) AS n, CASE WHEN len(t) >= 4 THEN regexp_replace(line, '[0-9]+', '<*>', 'g') ELSE line END AS line FROM p),
 g AS (SELECT line, n, CASE WHEN n >= 4 THEN array_to_string(string_split(line, ' ')[1:3], ' ') END AS lead, count(DISTINCT doc_id) AS docs, min((doc_id, i)) AS first FROM k GROUP BY 1, 2),
 crowded AS (SELECT n, lead FROM g WHERE lead IS NOT NULL GROUP BY 1, 2 HAVING sum(docs) >= 3 AND count(*) > 1),
 w AS (SELECT line, n, lead, unnest(range(4, n + 1)) AS pos, unnest(string_split(line, ' ')[4:]) AS word FROM g JOIN crowded USING (n, lead)),
 h AS (SELECT *, count(*) OVER (PARTITION BY n, lead, pos, word) AS held FROM w),
 b AS (SELECT line, greatest(ceil(any_value(n)::DOUBLE * 0.7::DOUBLE)::INT - 3, 0) AS need, list_reverse_sort(list(held)) AS counts FROM h GROUP BY 1),
 s AS (SELECT h.line, any_value(n) AS n, any_value(lead) AS lead, list((pos, word) ORDER BY pos) FILTER (need > 0 AND held >= counts[need]) AS shape FROM h JOIN b USING (line) GROUP BY 1),
 m AS (SELECT doc_id, i, s.n, lead, shape FROM k JOIN s USING (line)),
 t AS (SELECT n, lead, shape, min((doc_id, i)) AS first FROM m GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) >= 3),
 x AS (SELECT doc_id, i FROM k JOIN g USING (line) WHERE docs >= CASE WHEN k.n > 50 THEN 2 ELSE 3 END AND (doc_id, i) <> first
  UNION SELECT doc_id, i FROM m JOIN t ON m.n = t.n AND m.lead = t.lead AND m.shape IS NOT DISTINCT FROM t.shape WHERE (doc_id, i) <> first),
 y AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY 1)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda v, p: NOT list_contains(gone, (p - 1)::INT)), chr(10)) END AS text, len(a)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped FROM d LEFT JOIN y ON d.doc_id = y.doc_id"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY 1),
 lv AS (SELECT 0 AS n, (SELECT sum(source_size) / sum(w) FROM s)::DOUBLE AS level UNION ALL
  SELECT n + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (w * level > 3 * source_size), 0)) / sum(w) FILTER (w * level <= 3 * source_size) FROM s)::DOUBLE FROM lv WHERE n < 60),
 t AS (SELECT *, least(w * (SELECT max(level) FROM lv), 3.0 * source_size) AS target FROM s),
 p AS (SELECT d.doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size + greatest(0, least(start + size, floor(target)::BIGINT % source_size) - start) END::BIGINT AS taken FROM p"""


def _op8() -> str:
    text = "'" + "'), ('".join("', '".join(r) for r in HOST_RULES) + "'"
    rules = f"(VALUES ({text})) AS r(name, verdict)"
    other = " ".join(f"WHEN regexp_matches(lower(key), '{p}') THEN ('{n}', '{v}')" for n, p, v, _ in sorted(PATTERN_RULES, key=lambda r: (-len(r[1]), r[0])))
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1)) AS rest FROM pages),
 h AS (SELECT page_id, arg_max((name, verdict), (length(name), name)) AS best FROM u, {rules} WHERE (host = split_part(name, '/', 1) OR ends_with(host, '.' || split_part(name, '/', 1))) AND starts_with(path, substr(name, strpos(name, '/'))) GROUP BY 1),
 k AS (SELECT page_id, host, path, host || path || rest AS key FROM u), m AS (SELECT *, CASE {other} END AS own FROM k)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], own[2], 'allow') AS verdict, coalesce(best[1], own[1]) AS matched_by FROM m LEFT JOIN h USING (page_id)"""


OP9 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
 s AS (SELECT DISTINCT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS x FROM w WHERE len(a) >= 3 UNION ALL SELECT doc_id, array_to_string(a, ' ') FROM w WHERE len(a) IN (1, 2))),
 n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1), p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * k >= 85 * (a.c + b.c - k)), f AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
 r AS (SELECT i AS doc_id, i AS c FROM f UNION SELECT f.j, r.c FROM r JOIN f ON r.doc_id = f.i WHERE r.c < f.j), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.doc_id = w.doc_id"""

OP10 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
 p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.x, b.x) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""

ORACLES = {"op1_line_dedup": OP1, "op3_exact_dedup": OP3, "op7_source_mix": OP7, "op8_url_filter": _op8(), "op9_near_dedup": OP9, "op10_nearest_neighbours": OP10}
