"""The contracts of the pipeline operators as DuckDB SQL over the same tables."""

_WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingled(table: str, key: str, k: int) -> str:
    """(key, s): the distinct k-word shingles of each row, as text."""
    words = _WORDS.format(t=_LOW.format(t="text"))
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, {words} AS w FROM {table})"""


OP1 = f"""
WITH RECURSIVE s AS ({_shingled("documents", "doc_id", 3)}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

#: OP1 with the number of links of each document.
OP1_LINKS = OP1.replace("c.component_id\nFROM", "c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links\nFROM") + " LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) l USING (doc_id)"

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
r AS (SELECT h, max(page_id) AS top FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d JOIN r USING (h)"""

OP4 = f"""
WITH s AS ({_shingled("documents", "doc_id", 5)}), i AS ({_shingled("benchmark", "item_id", 5)}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN i USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, c::BIGINT AS shared, n::BIGINT AS item_shingles, c::DOUBLE / n AS containment FROM hit JOIN n USING (item_id) WHERE 10 * c >= 8 * n"""

OP9 = """
WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, line FROM l),
w AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM t WHERE x <> ''),
v AS (SELECT * FROM (SELECT doc_id, k, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY k)) WHERE c IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM v),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM f, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1),
cut AS (SELECT w.doc_id, w.i FROM w JOIN gone USING (doc_id, k)),
kept AS (SELECT t.doc_id, string_agg(line, chr(10) ORDER BY t.i) AS text FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id AND t.i = cut.i WHERE cut.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP5 = """
WITH d AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(doc_id::VARCHAR || 'mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
             / CASE WHEN size >= 10 AND length(text)::DOUBLE / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0 ELSE 0.25 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
c AS (SELECT *, 2.0 * source_size / weight AS cut_at, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS place FROM w),
v AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - 2.0 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM v WHERE level < cut_at),
a AS (SELECT source, source_size, CASE WHEN f.place IS NULL OR v.place < f.place THEN 2.0 * source_size ELSE weight * f.level END::DOUBLE AS target FROM v, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM a),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, e.source_size > 0 AS any_size,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN any_size AND upto - size / 2.0 <= rest THEN size ELSE 0 END)::BIGINT AS taken FROM r"""

OP10 = """
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS verdict
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id"""

#: crc32 of a document's id as text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""
_DISTANCE = """CASE WHEN any_value(sp) > 0 AND any_value(sq) > 0 THEN sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p / sp * log2(2 * (p / sp) / (p / sp + q / sq)) ELSE 0 END + CASE WHEN q > 0 THEN q / sq * log2(2 * (q / sq) / (p / sp + q / sq)) ELSE 0 END) / 2)) ELSE 0 END"""

#: Base rules, references of every language over all documents, and both Jensen-Shannon distances to the nearest of them.
OP3 = f"""
WITH d AS (SELECT doc_id, lang, text IS NOT NULL AS given, coalesce(text, '') AS text, {_WORDS.format(t="text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 5) t(j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
ch AS (SELECT doc_id, lang, given, unicode(c) AS u FROM (SELECT doc_id, lang, given, unnest(string_split(text, '')) AS c FROM d) WHERE c <> ''),
cc AS (SELECT doc_id, lang, given, CASE WHEN u >= 128 THEN 33 WHEN u BETWEEN 97 AND 122 THEN u - 97 WHEN u BETWEEN 65 AND 90 THEN 26 WHEN u BETWEEN 48 AND 57 THEN 27
              WHEN u = 32 OR u BETWEEN 9 AND 13 THEN 31 WHEN u < 32 OR u = 127 THEN 30 WHEN u IN (35, 42, 36, 37, 38, 124, 60, 62, 43) THEN 29 ELSE 28 END AS c, count(*) AS n FROM ch GROUP BY ALL),
wc AS (SELECT doc_id, lang, given, x, count(*) AS n FROM (SELECT doc_id, lang, given, unnest({_WORDS.format(t=_LOW.format(t="text"))}) AS x FROM d) GROUP BY ALL),
rw AS (SELECT lang, x, sum(n) AS n FROM wc WHERE given AND lang IS NOT NULL GROUP BY ALL),
langs AS (SELECT lang AS ref, sum(n) AS total FROM rw GROUP BY lang),
common AS (SELECT * FROM (SELECT lang AS ref, x, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(x)) AS place FROM rw) WHERE place <= 100),
judged AS (SELECT doc_id, n_words FROM base WHERE n_words >= 50 AND (lang IS NULL OR lang IN (SELECT ref FROM langs))),
rc AS (SELECT lang AS ref, c, sum(n) AS n FROM cc WHERE given AND lang IS NOT NULL GROUP BY ALL),
cv AS (SELECT j.doc_id, l.ref, k.c, coalesce(cc.n, 0)::DOUBLE AS p, coalesce(rc.n, 0)::DOUBLE AS q FROM judged j CROSS JOIN langs l CROSS JOIN (SELECT unnest([x FOR x IN range(0, 34) IF x NOT IN (31, 32)]) AS c) k
       LEFT JOIN cc ON cc.doc_id = j.doc_id AND cc.c = k.c LEFT JOIN rc ON rc.ref = l.ref AND rc.c = k.c),
wv AS (SELECT j.doc_id, k.ref, k.place, coalesce(wc.n, 0)::DOUBLE AS p, k.n::DOUBLE AS q FROM judged j CROSS JOIN common k LEFT JOIN wc ON wc.doc_id = j.doc_id AND wc.x = k.x),
we AS (SELECT * FROM wv UNION ALL SELECT doc_id, ref, 101, n_words - p, total - q FROM (SELECT doc_id, ref, sum(p) AS p, sum(q) AS q FROM wv GROUP BY ALL) JOIN judged USING (doc_id) JOIN langs USING (ref)),
dist AS (SELECT doc_id, min(char_distance) AS char_distance, min(word_distance) AS word_distance FROM
         (SELECT doc_id, ref, {_DISTANCE} AS char_distance FROM (SELECT *, sum(p) OVER v AS sp, sum(q) OVER v AS sq FROM cv WINDOW v AS (PARTITION BY doc_id, ref)) GROUP BY ALL)
         JOIN (SELECT doc_id, ref, {_DISTANCE} AS word_distance FROM (SELECT *, sum(p) OVER v AS sp, sum(q) OVER v AS sq FROM we WINDOW v AS (PARTITION BY doc_id, ref)) GROUP BY ALL) USING (doc_id, ref) GROUP BY doc_id),
told AS (SELECT base.* EXCLUDE (lang), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(char_distance, 0) AS cd, coalesce(word_distance, 0) AS wd FROM base LEFT JOIN dist USING (doc_id))
SELECT * EXCLUDE (cd, wd), NOT base_failed AND (n_words < 50 OR (cd <= 0.25 + 6.0::DOUBLE / n_words AND wd <= 0.45 + 0.4::DOUBLE / n_words)) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM told"""

#: Every string of 200 bytes of every text, as hex.
OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
piece AS (SELECT doc_id, a, substr(h, 2 * a + 1, 2398) AS h FROM (SELECT doc_id, h, unnest(range(0, n - 199, 1000)) AS a FROM d WHERE n >= 200)),
s AS (SELECT doc_id, a + p AS p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, a, h, unnest(range(0, least(1000, length(h) // 2 - 199))) AS p FROM piece)),
r AS (SELECT doc_id, p FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 200 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM f) GROUP BY doc_id, island),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM i),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS head, max(b) AS b FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN b IS NULL THEN h ELSE head || substr(h, (2 * b + 1)::BIGINT) END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: What op7_lm_score returns beside the interpolated score, whose weights are learnt.
OP7_BASE = f"""
WITH t AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, unnest(list_append({_WORDS.format(t=_LOW.format(t="text"))}, '')) AS x FROM documents),
c AS (SELECT x, count(*) AS n FROM t WHERE NOT held_out GROUP BY x),
s AS (SELECT sum(n)::BIGINT AS total, count(*) AS words FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(n) AS n_known, coalesce(any_value(total), 0) AS train_tokens, round(sum(log10((coalesce(n, 0) + 1) / (coalesce(total, 0) + words + 1))), 6) AS base_score
FROM t LEFT JOIN c USING (x), s GROUP BY doc_id, held_out"""
