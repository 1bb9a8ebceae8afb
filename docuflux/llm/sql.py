"""DuckDB SQL of the operators that SQL expresses."""

from __future__ import annotations

from .licenses import LEAST, TEMPLATES, leads
from .linededup import LEAST as LEAST_WORDS
from .linededup import MIN_WORDS
from .quality import DELTA, RISK, RULES
from .spelling import LETTERS, ONE_IN, RATIO, TIMES
from .warc import VOLUME

SPACE = r"[\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard() -> str:
    words = rf"list_filter(string_split_regex({LOWER.format('text')}, '{SPACE}'), lambda x: x <> '')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM met JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT n.doc_id, n.n AS n_shingles, min(reach.v) AS component_id FROM n JOIN reach ON reach.u = n.doc_id GROUP BY ALL"""


def decontamination() -> str:
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER.format("text"))
    return rf"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT doc_id, dw.i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM hit GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def license_scan() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    at = ", ".join(f"({quoted(w)}, {i}, {q})" for w, i, q in leads(LEAST))
    normal = "trim(regexp_replace(" + LOWER.format("{}") + ", '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT template, license, len(w) AS size, {grams} AS g FROM
  (SELECT template, license, string_split({normal.format("body")}, ' ') AS w FROM (VALUES {rows}) v(template, license, body))),
tg AS (SELECT template, license, len(g) AS n, unnest(g) AS gram FROM t),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
units AS (SELECT doc_id, unnest(range(len(l))) AS unit, unnest(l) AS line FROM lines
  UNION ALL SELECT doc_id, -1, text FROM lines WHERE len(l) > 1),
u AS (SELECT doc_id, unit, {grams} AS g FROM (SELECT doc_id, unit, string_split({normal.format("line")}, ' ') AS w FROM units)),
ug AS (SELECT doc_id, unit, len(g) AS m, unnest(g) AS gram FROM u WHERE len(g) <= (SELECT max(n) FROM tg) * 3),
met AS (SELECT doc_id, unit, template, license, 2 * count(*) / (m + n) AS dice FROM ug JOIN tg USING (gram)
  GROUP BY doc_id, unit, template, license, m, n HAVING 2 * count(*) / (m + n) >= {LEAST} - 1e-12),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) = 1),
ws AS (SELECT doc_id, string_split({normal.format("text")}, ' ') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM ws),
laid AS (SELECT DISTINCT doc_id, p0.template, greatest(i - q, 0) AS a, i - q + size AS b
  FROM p JOIN (VALUES {at}) p0(word, template, q) USING (word) JOIN t USING (template)),
cut AS (SELECT doc_id, template, a, b, {grams} AS g FROM (SELECT DISTINCT doc_id, template, a, least(b, len(w)) AS b, w[a + 1:least(b, len(w))] AS w FROM laid JOIN ws USING (doc_id))),
cg AS (SELECT doc_id, template, a, b, len(g) AS m, unnest(g) AS gram FROM cut),
slid AS (SELECT doc_id, -2 - a AS unit, template, license, 2 * count(*) / (m + n) AS dice FROM cg JOIN tg USING (gram, template)
  GROUP BY doc_id, a, b, template, license, m, n HAVING 2 * count(*) / (m + n) >= {LEAST} - 1e-12),
every AS (SELECT doc_id, unit, template, license, dice FROM best UNION ALL SELECT doc_id, unit, template, license, dice FROM slid),
by_doc AS (SELECT doc_id, count_if(unit >= -1) AS n_units, count_if(unit < -1) AS n_windows, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
  arg_min(license, (-dice, template)) AS best_license, max(dice) AS best_dice FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_windows, 0) AS n_windows, coalesce(licenses, '') AS licenses, best_license, round(best_dice, 6) AS best_dice
FROM documents d LEFT JOIN by_doc USING (doc_id)"""


def line_dedup(min_words: int = MIN_WORDS, least: int = LEAST_WORDS) -> str:
    """Units are cut at line ends, and after . ! ? , ; : before white space; see the operator."""
    cut = r"string_split(regexp_replace(regexp_replace(text, '([.!?,;:])([\x20\x09\x0B-\x0D])', '\1' || chr(1) || '\2', 'g'), '(\n)', '\1' || chr(1), 'g'), chr(1))"
    return rf"""
WITH p AS (SELECT doc_id, {cut} AS p FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece,
  unnest(list_transform(range(1, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0))) AS before FROM p),
v AS (SELECT doc_id, i, cast(before + length(piece) - length(regexp_replace(piece, '^{SPACE}', '')) AS bigint) AS s,
  cast(before + length(regexp_replace(piece, '{SPACE}$', '')) AS bigint) AS e,
  {LOWER.format(rf"trim(regexp_replace(piece, '{SPACE}', ' ', 'g'))")} AS unit FROM u),
k AS (SELECT doc_id, i, s, e, unit, len(string_split(unit, ' ')) AS n FROM v WHERE unit <> ''),
c AS MATERIALIZED (SELECT *, cast(sum(n) OVER w AS bigint) AS upto, cast(sum(n) OVER w - n AS bigint) AS pos, row_number() OVER w AS place FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l AS MATERIALIZED (SELECT doc_id, list(unit ORDER BY place) AS units FROM c GROUP BY 1),
r AS (SELECT x.doc_id, x.pos, x.place, y.place AS last, y.upto - x.pos AS words, array_to_string(units[x.place:y.place], ' ') AS run
  FROM (SELECT *, pos + {min_words} AS want FROM c) x ASOF JOIN c y ON x.doc_id = y.doc_id AND x.want <= y.upto JOIN l ON l.doc_id = x.doc_id),
f AS MATERIALIZED (SELECT *, first_value(doc_id) OVER o AS kept, first_value(pos) OVER o AS kept_pos, count(*) OVER (PARTITION BY run) > 1 AS again FROM r WINDOW o AS (PARTITION BY run ORDER BY doc_id, pos)),
g AS MATERIALIZED (SELECT *, doc_id = kept AND pos = kept_pos AS stays FROM f WHERE again AND (doc_id <> kept OR pos = kept_pos OR pos >= kept_pos + words)),
m AS (SELECT doc_id, place, bool_or(stays) AS held, bool_or(NOT stays) AS gone FROM (SELECT doc_id, stays, unnest(range(place, last + 1)) AS place FROM g) GROUP BY 1, 2),
q AS (SELECT c.*, coalesce(held, false) AS held, coalesce(gone AND NOT held, false) AS cut FROM c LEFT JOIN m USING (doc_id, place)),
h AS (SELECT *, sum((cut AND NOT coalesce(lag_cut, false))::int) OVER (PARTITION BY doc_id ORDER BY place) AS stretch FROM (SELECT *, lag(cut) OVER n AS lag_cut, CASE WHEN lag(held) OVER n THEN lag(e) OVER n ELSE s END AS cs, CASE WHEN lead(held) OVER n THEN lead(s) OVER n - 1 ELSE e END AS ce FROM q WINDOW n AS (PARTITION BY doc_id ORDER BY place)) WHERE cut),
t AS (SELECT doc_id, stretch, min(place) AS a, max(place) AS b, min(cs) AS s, max(ce) AS e, sum(n) AS words FROM h GROUP BY ALL HAVING sum(n) >= {least}),
k2 AS (SELECT t.doc_id, list_sort(list(DISTINCT kept)) AS kept FROM t JOIN g ON g.doc_id = t.doc_id AND g.place <= t.b AND g.last >= t.a AND NOT stays GROUP BY 1)
SELECT doc_id, count(*) AS n_removed, cast(sum(words) AS bigint) AS removed_words, string_agg(s || ':' || e, ',' ORDER BY s) AS spans, any_value(k2.kept) AS kept_doc_ids FROM t JOIN k2 USING (doc_id) GROUP BY 1"""


def quality() -> str:
    """Features, the order on one half of the labels, and the tests on the other; see the operator."""
    grid = ", ".join(f"({i}, '{rule}', {c})" for i, (rule, cs) in enumerate(RULES.items()) for c in cs)
    part = lambda a, b, m: f"CASE WHEN {b} > 0 THEN {a} * {m} // {b} ELSE 0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{SPACE}', '', 'g')) > 0) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
b AS (SELECT doc_id, stratum, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS bigint) AS n_symbols, cast(len(l) AS bigint) AS n_lines,
  cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  [{part("n_symbols", "word_chars", 1000)}, {part("n_dup_lines", "n_lines", 100)}, {part("n_repeat_words", "n_words", 100)}, {part("word_chars", "n_words", 10)}] AS v FROM b),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
x AS (SELECT stratum, v, quality = 1 AS fine, substr(md5(cast(doc_id AS varchar)), 1, 1) < '8' AS held FROM f JOIN m USING (doc_id) WHERE NOT base_failed),
grid(i, rule, cutoff) AS (VALUES {grid}),
n AS (SELECT stratum, i, rule, cutoff, count_if(fine) AS good, count_if(fine AND v[i + 1] >= cutoff) AS good_hit, count_if(NOT fine) AS bad,
  count_if(NOT fine AND v[i + 1] >= cutoff) AS bad_hit FROM x, grid WHERE NOT held GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY good_hit / greatest(good, 1), bad_hit DESC, i, cutoff DESC) AS step FROM n
  WHERE bad_hit > 0 AND bad_hit * greatest(good, 1) >= 3 * good_hit * greatest(bad, 1)),
h AS (SELECT row_number() OVER () AS id, stratum, v FROM x WHERE held AND fine AND stratum IN (SELECT stratum FROM o)),
s AS (SELECT id, h.stratum, min(step) AS step FROM h LEFT JOIN o ON o.stratum = h.stratum AND v[i + 1] >= cutoff GROUP BY 1, 2),
q AS (SELECT o.*, (SELECT count(*) FROM s WHERE s.stratum = o.stratum) AS n, (SELECT count(*) FROM s WHERE s.stratum = o.stratum AND s.step <= o.step) AS k FROM o),
p AS (SELECT *, CASE WHEN n = 0 OR k > n * {RISK} THEN 1.0 ELSE
  list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) END AS tail FROM q),
y AS (SELECT *, bool_and(tail <= {DELTA} / (SELECT count(DISTINCT stratum) FROM f)) OVER (PARTITION BY stratum ORDER BY step) AS sure FROM p),
z AS (SELECT stratum, i, rule, min(cutoff) AS cutoff FROM y WHERE sure GROUP BY ALL),
j AS (SELECT doc_id, string_agg(rule, ',' ORDER BY i) AS rejected_by FROM f JOIN z USING (stratum) WHERE v[i + 1] >= cutoff GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM f LEFT JOIN j USING (doc_id)"""


def fixity() -> str:
    """Records, their layout and the stated damage; a loss moves the records behind it."""
    line = "chr(13) || chr(10)"
    head = f"'WARC/1.1' || {line} || 'WARC-Type: response' || {line} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {line} || 'WARC-Target-URI: ' || url || {line}"
    record = f"{head} || 'Content-Type: text/html' || {line} || 'Content-Length: ' || octet_length(encode(html)) || {line} || {line} || html || {line} || {line}"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, page_id // {VOLUME} AS volume, {record} AS record, cast('0x' || substr(md5(cast(page_id AS varchar)), 1, 7) AS bigint) % 97 AS fate FROM p),
l AS (SELECT page_id, volume, fate, octet_length(encode(record)) AS length, sha256(record) AS record_sha256 FROM r)
SELECT page_id, volume, row_number() OVER w - 1 AS seq, cast(sum(length) OVER w - length AS bigint) AS "offset", length, record_sha256,
  CASE fate WHEN 0 THEN 'corrupt' WHEN 1 THEN 'missing' ELSE 'ok' END AS status,
  CASE WHEN fate <> 1 THEN cast(-coalesce(sum(length) FILTER (fate = 1) OVER w, 0) AS bigint) END AS shift
FROM l WINDOW w AS (PARTITION BY volume ORDER BY page_id)"""


#: CRC-32 goes byte by byte over a table made from its polynomial; `crc(h)` is that of hexadecimal bytes.
CRC_TABLE = "tbl AS (SELECT list(c ORDER BY n) AS tbl FROM (SELECT n, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS c FROM range(256) r(n)))"


def crc(h: str) -> str:
    return rf"""xor(list_reduce(list_transform(range(length({h}) // 2), lambda i: cast('0x' || substr({h}, 2 * i + 1, 2) AS bigint)),
  lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds: every part against every entry."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, q, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT p.r, q, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{t} c USING (q)) GROUP BY 1, 2)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT q, e, list(coalesce(n.x, o.x) ORDER BY j) AS v FROM (SELECT q, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM c{t}) o
  LEFT JOIN (SELECT q, e, j, cast((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS bigint) AS x FROM
    (SELECT q, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{t} JOIN p USING (r, q)) GROUP BY 1, 2, 3) n USING (q, e, j) GROUP BY 1, 2)""")
    return rf"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x AS double)) AS bigint)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, q, v[q * (len(v) // {parts}) + 1:(q + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(q)),
c0 AS (SELECT q, r - 1 AS e, v FROM p WHERE r <= {entries}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(x, ',' ORDER BY q, e, j)) AS codebooks_sha256 FROM (SELECT q, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM c{rounds})),
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY q) AS code, cast(sum(d) AS bigint) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM coded JOIN k USING (r), books"""


def spelling() -> str:
    """Near words share a pattern with one letter left open."""
    low = LOWER.format("text")
    return rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({low}, '[a-zA-ZÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {LETTERS} GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc("x")} AS h FROM (SELECT run, n, hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) AS x FROM runs), tbl),
w AS MATERIALIZED (SELECT word, sum(n) AS n FROM (SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LETTERS} GROUP BY 1 HAVING sum(n) >= {TIMES}),
r AS MATERIALIZED (SELECT word, left(word, i) || '*' || substr(word, i + 2) AS pattern FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
x AS MATERIALIZED (SELECT word, left(word, i) || '*' || substr(word, i + 1) AS pattern FROM (SELECT word, unnest(range(length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS near FROM r a JOIN r b USING (pattern) WHERE a.word <> b.word
  UNION SELECT a.word, b.word FROM x a JOIN r b USING (pattern) UNION SELECT b.word, a.word FROM x a JOIN r b USING (pattern)),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n FROM near JOIN w ON w.word = near.near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, form AS root, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY 1)
SELECT word, form, coalesce(root, word) AS root, cast(n AS bigint) AS n, n_near, cast(form_n AS bigint) AS form_n FROM f LEFT JOIN last USING (word)"""


def sharding(shards: int = 16) -> str:
    """Rendezvous hashing by the MD5 of the id and the shard, all weights 1; slots by the MD5 of the
    id."""
    unit = "(cast('0x' || substr(md5(name || ':' || s), 1, 13) AS bigint) + 0.5) / 4503599627370496.0"
    return rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, cast(doc_id AS varchar) AS name FROM documents),
z AS (SELECT h, {crc("h")} AS c FROM (SELECT DISTINCT h FROM d), tbl),
c AS (SELECT doc_id, s, -ln({unit}) AS score FROM d, range({shards + 1}) r(s)),
b AS (SELECT doc_id, cast(arg_min(s, score) FILTER (s < {shards}) AS int) AS shard, cast(arg_min(s, score) AS int) AS grown_shard FROM c GROUP BY 1)
SELECT doc_id, length(h) // 2 + 1 AS size, c AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(name), doc_id) - 1 AS slot, grown_shard FROM d JOIN z USING (h) JOIN b USING (doc_id)"""


ORACLES = {
    "op2_sharding": sharding(),
    "op8_warc_fixity": fixity(),
    "op7_quality_rules": quality(),
    "op1_jaccard_join": jaccard(),
    "op6_line_dedup": line_dedup(),
    "op9_decontamination": decontamination(),
    "op10_license_scan": license_scan(),
    "op11_vector_codes": vector_codes(),
    "op12_spelling_variants": spelling(),
}
