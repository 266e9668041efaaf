"""DuckDB SQL for the training-data queries that SQL can express."""

# DuckDB has no CRC-32: a table of its 256 steps, then one step a byte of the UTF-8 text.
CRC_STEPS = r"""(SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps)"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ``text``, beside a column ``steps``."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda i: {byte})),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


ORACLE = {
    "op4_url_filter": r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(rule_host, rule_path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
""",
    "op3_source_mix": r"""
WITH weights(pool, weight) AS (
  VALUES ('src0', 0.20), ('src1', 0.08), ('src2', 0.08), ('src3', 0.08), ('src4', 0.08), ('src5', 0.06), ('src6', 0.06), ('src7', 0.06),
         ('src8', 0.06), ('src9', 0.06), ('src10', 0.04), ('src11', 0.04), ('rest', 0.10)),
d AS (
  SELECT documents.*, CASE WHEN source IN (SELECT pool FROM weights WHERE pool <> 'rest') THEN source ELSE 'rest' END AS pool,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sizes AS (SELECT pool, sum(coalesce(strlen(text), 0))::DOUBLE AS b FROM d GROUP BY pool),
rates AS (
  SELECT pool, CASE WHEN b = 0 THEN 1.0 ELSE weight::DOUBLE / (sum(weight::DOUBLE) FILTER (WHERE b > 0) OVER ()) * (sum(b) OVER ()) / b END AS rate
  FROM sizes JOIN weights USING (pool)),
terms AS (
  SELECT pool, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS t(k)),
cdf AS (SELECT pool, k, sum(p) OVER (PARTITION BY pool ORDER BY k) AS c FROM terms)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(cdf.k AS INTEGER) AS copy
FROM d JOIN cdf ON cdf.pool = d.pool AND cdf.c < d.u
""",
    "op5_decontamination": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS n
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM grams),
hits AS (
  SELECT r, i, lengths.n, g.item
  FROM docs, lengths, unnest(range(1, len(w) - lengths.n + 2)) AS t(i)
  JOIN grams g ON g.n = lengths.n AND g.gram = array_to_string(w[i : i + lengths.n - 1], ' ')),
spots AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN spots USING (r) LEFT JOIN found USING (r)
""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) AS copy FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
""",
    "op11_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 2) - 1], ' ') AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
sets AS (SELECT r, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS k FROM s GROUP BY r),
classes AS (SELECT k, min(r) AS c FROM sets GROUP BY k),
of_class AS (SELECT classes.c, s.shingle, n FROM classes JOIN s ON s.r = classes.c JOIN sizes ON sizes.r = classes.c),
shared AS (
  SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS common
  FROM of_class a JOIN of_class b ON a.shingle = b.shingle AND a.c < b.c
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
linked AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (an + bn - common)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
first_of AS (SELECT c, min(doc_id) AS id FROM classes JOIN sets USING (k) JOIN d ON d.r = sets.r GROUP BY c),
roots AS (SELECT reach.a AS c, min(id) AS id FROM reach JOIN first_of ON first_of.c = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE roots.id END AS component_id,
       doc_id IS NOT DISTINCT FROM (CASE WHEN n IS NULL THEN doc_id ELSE roots.id END) AS kept
FROM d LEFT JOIN sizes USING (r) LEFT JOIN sets USING (r) LEFT JOIN classes USING (k) LEFT JOIN roots USING (c)
""",
    "op12_periodic_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         """ + crc32("CAST(doc_id AS VARCHAR)") + r""" AS h
  FROM documents, """ + CRC_STEPS + r"""),
e AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w
  FROM f),
words AS (SELECT r, n, i, w[i + 1] AS word FROM t, unnest(range(n)) AS u(i)),
same AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
found AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM found GROUP BY r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY len * 10000000000 // q DESC, s, q) AS k FROM found),
gone AS (SELECT DISTINCT r, i FROM found, unnest(range(s + q, s + len)) AS u(i)),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS rest FROM words ANTI JOIN gone USING (r, i) GROUP BY words.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (r) LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (r) LEFT JOIN kept USING (r)
""",
    "op13_importance_resampling": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, true AS ours FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
d AS (
  SELECT r, doc_id, ours, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS (
  SELECT r, ours, array_to_string(w[i : i + n - 1], ' ') AS feature
  FROM d, unnest([1, 2, 3]) AS t(n), unnest(range(1, len(w) - n + 2)) AS u(i)),
names AS (SELECT feature, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM features GROUP BY feature),
coded AS (SELECT *, """ + crc32("feature") + r""" % 10000 AS bucket FROM names, """ + CRC_STEPS + r"""),
counts AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM coded GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts),
weights AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM features JOIN coded USING (feature) JOIN gains USING (bucket) WHERE ours GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         (('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d LEFT JOIN weights USING (r) WHERE ours),
final AS (SELECT *, weight + CAST(floor(-1000::DOUBLE * ln(-ln(u))) AS BIGINT) AS score FROM scored),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS k FROM final WHERE n >= 20),
few AS (SELECT 5 * count(*) // 100 AS k FROM final WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN drawn.k <= few.k THEN drawn.k END AS rank
FROM final CROSS JOIN few LEFT JOIN drawn USING (r)
""",
}
