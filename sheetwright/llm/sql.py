"""DuckDB SQL for the queries that SQL can express."""

CHECKS: dict[str, str] = {}

CHECKS["op2_quality"] = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) i FROM d),
g AS (SELECT rid, i, list(w) OVER win g, count(*) OVER win n FROM w WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT rid, i, n = 8 AND count(*) OVER (PARTITION BY rid, n, g) > 1 AS twice FROM g),
c AS (SELECT rid, max(twice::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) c FROM r),
rep AS (SELECT rid, sum(c) n_repeat FROM c GROUP BY rid),
len AS (SELECT rid, count(*) n_words, sum(length(w)) word_chars FROM w GROUP BY rid),
l AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT rid, count(*) n_lines, count(*) - count(DISTINCT x) n_dup FROM l GROUP BY rid),
m AS (SELECT doc_id, source, coalesce(n_words, 0) n_words, coalesce(word_chars, 0) word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup, 0) n_dup, coalesce(n_repeat, 0) n_repeat, coalesce(n_lines, 0) n_lines
  FROM d LEFT JOIN len USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat > 30 * n_words b, 100 * n_symbols > 50 * n_words s, 100 * n_dup > 50 * n_lines x FROM m),
h AS (SELECT source, count(*) n, sum(b::INT) nb, sum(s::INT) ns, sum(x::INT) nx FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT round(avg(nb / n), 9) mb, round(var_pop(nb / n), 12) vb, round(avg(ns / n), 9) ms, round(var_pop(ns / n), 12) vs, round(avg(nx / n), 9) mx, round(var_pop(nx / n), 12) vx FROM h),
q AS (SELECT *, CASE WHEN vb > 0 AND round(mb * (1 - mb) / vb - 1, 6) > 0 THEN round(mb * (1 - mb) / vb - 1, 6) ELSE 20.0 END kb,
  CASE WHEN vs > 0 AND round(ms * (1 - ms) / vs - 1, 6) > 0 THEN round(ms * (1 - ms) / vs - 1, 6) ELSE 20.0 END ks,
  CASE WHEN vx > 0 AND round(mx * (1 - mx) / vx - 1, 6) > 0 THEN round(mx * (1 - mx) / vx - 1, 6) ELSE 20.0 END kx FROM p),
v AS (SELECT source, round((nb + mb * kb) / (n + kb), 6) rb, round((ns + ms * ks) / (n + ks), 6) rs, round((nx + mx * kx) / (n + kx), 6) rx FROM h, q)
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols, n_dup::BIGINT n_dup_lines, n_repeat::BIGINT n_repeat_words,
  b AS base_failed, coalesce(greatest(rb, rs, rx) <= 0.5, true) host_kept, rb AS host_rate, NOT b AND coalesce(greatest(rb, rs, rx) <= 0.5, true) kept
FROM f LEFT JOIN v USING (source)
"""

CHECKS["op7_hamming_search"] = """
WITH v AS (SELECT vec_id, [(x > 0)::INT FOR x IN embedding] c FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id query_id, v.vec_id, len(list_filter(list_zip(q.c, v.c), lambda x: x[1] <> x[2])) d FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) k FROM p)
SELECT query_id, k::INTEGER AS "rank", vec_id, d::INTEGER distance FROM r WHERE k <= 10
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHECKS["op11_phrases"] = rf"""
WITH p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p FROM (SELECT row_number() OVER () rid, coalesce(lang, 'und') lang, {LOWER} t FROM documents)),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase FROM w, (SELECT unnest(range(1, 6)) k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') s FROM f WHERE k > 1),
cuts AS (SELECT *, array_to_string(s[:cut], ' ') x, array_to_string(s[cut + 1:], ' ') y FROM (SELECT *, unnest(range(1, k)) cut FROM c)),
scored AS (SELECT cuts.*, x.a l, y.a r, n, (1000 * cuts.a::HUGEINT * n) // (x.a::HUGEINT * y.a) score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN n ON n.lang = cuts.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT DISTINCT p.lang, p.phrase FROM c p JOIN c q ON q.lang = p.lang AND q.k > p.k AND q.a >= p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) place FROM lowest ANTI JOIN held USING (lang, phrase))
SELECT lang, place::BIGINT AS "rank", phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n, score::BIGINT score FROM r WHERE place <= 2000
"""

CHECKS["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () rid, coalesce(lang, '') lang, coalesce(source, '') source, {LOWER} t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) c FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) v, sum(c) n FROM kept GROUP BY lang),
uses AS (SELECT lang, source, term, count(*) c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, sum(c) n FROM uses GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(u.c, 0) c, 1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * v) p,
  1 + (1000000000::HUGEINT * (kept.c + 2)) // (v.n + 2 * v) q
  FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN uses u USING (lang, source, term) LEFT JOIN sizes s USING (lang, source)),
pairs AS (SELECT x.lang, x.source, y.source item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS "value"
  FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
rows AS (SELECT x.lang, x.source, 'pair' part, y.source item, coalesce("value", 0) AS "value"
  FROM groups x JOIN groups y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, "value"::BIGINT AS "value", k::INTEGER AS "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item) k FROM rows) WHERE part = 'pair' OR k <= 10
"""

CHECKS["op13_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id::VARCHAR item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
t AS MATERIALIZED (SELECT DISTINCT item, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) s
  FROM (SELECT *, least(len(w), 10) size FROM b WHERE len(w) > 0)),
x AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) i FROM d, (SELECT DISTINCT size FROM t)),
h AS MATERIALIZED (SELECT rid, i, x.size, item FROM x JOIN t ON t.size = x.size AND t.s = array_to_string(w[i:i + x.size - 1], ' ')),
hit AS (SELECT rid, count(DISTINCT j) n FROM (SELECT rid, unnest(range(i, i + size)) j FROM h) GROUP BY rid),
items AS (SELECT rid, count(*) n, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(hit.n, 0)::BIGINT n_hit, coalesce(items.n, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
