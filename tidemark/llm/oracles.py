"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
LETTER_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACE_WORDS}) AS w FROM documents),
 g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
 m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM g JOIN m USING (k) WHERE doc_id > least), range(0, 50) AS t(j)),
 words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACE_WORDS}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 x AS (SELECT doc_id, sh, n FROM s JOIN n USING (doc_id)),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

OP6 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {LETTER_WORDS}) AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, {LETTER_WORDS}) AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT size FROM bw),
 dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
 h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
 n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM h), range(0, 10) AS t(j) WHERE j < size GROUP BY doc_id),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: A text's bytes as pairs of hexadecimal digits.
OP10 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
 p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
 t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM p) WHERE c > 1),
 e AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS new FROM t),
 s AS (SELECT doc_id, i, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
 r AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS e FROM s GROUP BY doc_id, run),
 cut AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
 q AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)"""

SQL = {"op1_substring_dedup": OP1, "op2_near_dedup": OP2, "op6_decontamination": OP6, "op10_suffix_dedup": OP10}
