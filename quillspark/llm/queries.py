"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from . import centroids, divergence, fingerprints, line_dedup, mixing, near_dedup, packed_ids, pattern_packing, quality, substring_dedup, suffix_dedup, url_filter, warc


def _pipeline(spark, sf_dir):
    # the module stands at the repository's top, beside the entry module that asks for this query
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_pattern_packing": pattern_packing.op2,
    "op3_warc": warc.op3,
    "op4_fingerprints": fingerprints.op4,
    "op5_quality_rules": quality.op5,
    "op6_packed_ids": packed_ids.op6,
    "op7_near_dedup": near_dedup.op7,
    "op8_url_filter": url_filter.op8,
    "op9_mixing": mixing.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_centroids": centroids.op11,
    "op12_divergence": divergence.op12,
    "op13_line_dedup": line_dedup.op13,
    "pipeline": _pipeline,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _lloyd_sql(k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Vectors as (id, place, component), centroids likewise; one assignment and one mean a round."""
    steps = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}),
x AS (SELECT vec_id, unnest(range(1, {components + 1})) AS j, unnest(e) AS x FROM v),
c0 AS (SELECT k, unnest(range(1, {components + 1})) AS j, unnest(e) AS c FROM (SELECT e, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM v) WHERE k < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{i} ON x.j = c{i}.j GROUP BY vec_id, k),
a{i} AS (SELECT vec_id, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d{i}) WHERE r = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN x ON a{i}.vec_id = x.vec_id GROUP BY k, j),
c{i + 1} AS (SELECT c{i}.k, c{i}.j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k AND c{i}.j = m{i}.j)""")
    last = f"a{rounds}"
    return f"""
WITH {", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST({last}.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {last}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM {last} JOIN h ON {last}.k = h.k
"""


ORACLE = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 AS n, unnest(range(0, len(h) // 2)) AS j, h FROM d),
w AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS x, CASE WHEN j + 50 <= n THEN md5(substr(h, 2 * j + 1, 100)) END AS k FROM b),
f AS (SELECT *, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS again FROM w),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM c),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (opens) AS s, string_agg(x, '' ORDER BY j) FILTER (NOT gone) AS left_over FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(left_over, ''))) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id
""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS q FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(q, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> k) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM c
""",
    "op7_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS m FROM d UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.u WHERE r.m < e.v),
k AS (SELECT u, min(m) AS m FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.m AS component_id, d.doc_id = k.m AS kept FROM d JOIN k ON k.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op9_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17:' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s),
f AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS filled FROM w),
t AS (SELECT *, (1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY filled, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY filled, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
l AS (SELECT min_by(level, filled) AS level FROM t WHERE level <= filled),
g AS (SELECT t.source, t.source_size, greatest(CASE WHEN l.level IS NULL THEN cap ELSE least(cap, weight * l.level) END, 0) AS target FROM t, l),
r AS (SELECT d.doc_id, d.source, d.h, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS raw FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN abs(raw - round(raw)) < 1e-9 THEN round(raw) ELSE raw END AS rate FROM r),
c AS (SELECT *, CAST(floor(rate) AS INTEGER) + CASE WHEN CAST(('0x' || substr(h, 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, rate, copies FROM c
""",
    "op10_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
e AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM g),
x AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM e WHERE again)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
o AS (SELECT a.doc_id, count(x.j) AS n_removed, string_agg(CASE WHEN x.j IS NULL THEN a.word END, ' ' ORDER BY a.j) AS kept
  FROM a LEFT JOIN x ON a.doc_id = x.doc_id AND a.j = x.j GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
""",
    "op11_centroids": _lloyd_sql(),
    "op12_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
z AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
b AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, coalesce(s.n, 0) AS m, z.v, k.total, z.n AS lang_n
  FROM g JOIN k ON g.lang = k.lang JOIN z ON g.lang = z.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 2)) // (m + 2 * v) AS BIGINT) AS p, CAST(1 + (1000000000 * (CAST(total AS HUGEINT) + 2)) // (lang_n + 2 * v) AS BIGINT) AS q FROM b),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10
""",
    "op13_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, r, unnest(range(1, len(l) + 1)) AS j, unnest(l) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM e),
m AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
n AS (SELECT doc_id, r, j, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN m ON k.k = m.k),
a AS (SELECT doc_id, r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone) AS kept FROM n GROUP BY doc_id, r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM a
""",
}
