"""DuckDB SQL that gives the rows of the queries it can express."""

from __future__ import annotations

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = r"regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS run
       FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM i)),
dw AS (SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS run
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
             FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)),
hit AS (SELECT doc_id, p, size, item_id FROM dw JOIN iw USING (size, run)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SHARES = {
    "symbols": ("n_symbols", "n_words"), "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
}
_FALLING = [75, 50, 30, 20, 10]
_SETS = [{r: c} for r in _SHARES for c in _FALLING] + [{r: 10} | {x: c for x in _SHARES if x != r} for r in _SHARES for c in _FALLING]


def _rejects(rules: dict[str, int]) -> str:
    return " OR ".join(f"100 * {_SHARES[r][0]} > {c} * {_SHARES[r][1]}" for r, c in rules.items())


def _cutoffs(rules: dict[str, int]) -> str:
    return ", ".join(f"{r}: {rules.get(r, 'NULL::INT')}" for r in _SHARES)


_TESTS = " UNION ALL ".join(
    f"SELECT stratum, {i} AS place, {{{_cutoffs(rules)}}} AS c, "
    f"count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS n_bad, "
    f"count(*) FILTER (quality = 1 AND ({_rejects(rules)})) AS k, count(*) FILTER (quality = 0 AND ({_rejects(rules)})) AS k_bad "
    "FROM rated GROUP BY stratum"
    for i, rules in enumerate(_SETS)
)
_MILD = " UNION ALL ".join(
    f"SELECT b.stratum, '{r}' AS rule, max(x.c.{r}) AS cutoff FROM best b JOIN tests own ON own.stratum = b.stratum AND own.place // 5 = {j} AND own.c.{r} = b.c.{r} "
    f"JOIN tests x ON x.stratum = b.stratum AND x.place // 5 = {j} AND x.k = own.k AND x.k_bad = own.k_bad WHERE own.k + own.k_bad > 0 GROUP BY 1"
    for j, r in enumerate(_SHARES)
)
_FAILS = " OR ".join(
    f"EXISTS (SELECT 1 FROM chosen c WHERE c.stratum = f.stratum AND c.rule = '{rule}' AND 100 * {a} > c.cutoff * {b})"
    for rule, (a, b) in _SHARES.items()
)
QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS run
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, run FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
             FROM (SELECT doc_id, unnest(range(p, p + 8)) AS place FROM windows JOIN again USING (doc_id, run)) GROUP BY 1),
facts AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts),
rated AS MATERIALIZED (SELECT judged.*, quality FROM judged JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY 1) USING (doc_id)
          WHERE NOT base_failed
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals) = 1),
tests AS MATERIALIZED ({_TESTS}),
tried AS MATERIALIZED (SELECT *, (SELECT count(DISTINCT stratum) FROM tests WHERE n_bad > 0 AND n * ln(0.98) <= ln(0.05 / 4)) AS strata,
    (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))
     FROM (SELECT unnest(range(k + 1)) AS j)) AS p FROM tests WHERE n_bad > 0 AND n * ln(0.98) <= ln(0.05 / 4)),
best AS MATERIALIZED (SELECT stratum, arg_max(c, (k_bad * n - k * n_bad, -place)) AS c FROM tried
         WHERE p <= 0.05 / (4 * strata) AND k_bad * n > k * n_bad GROUP BY 1),
chosen AS ({_MILD})
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_FAILS}) AS kept
FROM judged f
"""

_ESCAPE = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_LOWER_WORDS = r"regexp_extract_all(" + ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER_WORDS} AS w FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) END) AS s FROM w),
sized AS (SELECT r, doc_id, len(s)::BIGINT AS n, hash(list_sort(s)) AS k, s FROM sets),
classes AS (SELECT k, any_value(n) AS n, any_value(s) AS s FROM sized WHERE n > 0 GROUP BY k),
grams AS (SELECT k, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.k AS a, b.k AS b, a.n AS m, b.n AS n, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k
          AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (m + n - common)),
reached(k, other) AS (SELECT k, k FROM classes UNION SELECT reached.k, b FROM reached JOIN links ON other = a),
least_of AS (SELECT reached.k, min(doc_id) AS component_id FROM reached JOIN sized ON sized.k = other GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sized LEFT JOIN least_of ON sized.k = least_of.k AND n > 0
"""

#: Unsigned crc32 of the text ``s`` of the rows ``id, s`` of a table, byte by byte, as CTEs that end with ``crc(id, h)``.
_CRC = """
crc_table AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) t(i)),
crc_step(id, h, pos, state) AS (
    SELECT id, hex(encode(s)), 0, 4294967295::BIGINT FROM {table}
    UNION ALL SELECT id, h, pos + 1, xor(state >> 8, v) FROM crc_step
    JOIN crc_table ON i = xor(state & 255, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) WHERE 2 * pos < length(h)),
crc AS (SELECT id, xor(state, 4294967295) AS h FROM crc_step WHERE 2 * pos = length(h))
"""
VARIANTS = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
          FROM documents),
counted AS (SELECT row_number() OVER () AS id, run, c, coalesce(doc_id::VARCHAR, '') || ':' || run AS s
            FROM (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL)), {_CRC.format(table='counted')},
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c
          FROM counted JOIN crc USING (id)),
words AS (SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT DISTINCT word, n, left(word, p - 1) || substr(word, p + 1) AS cut
         FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM words)),
holes AS (SELECT word, n, p, left(word, p - 1) AS a, substr(word, p + 1) AS z
          FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM words)),
one_way AS (SELECT cuts.word, cuts.n, w.word AS near, w.n AS near_n FROM cuts JOIN words w ON cut = w.word),
near AS (SELECT * FROM one_way UNION ALL SELECT near, near_n, word, n FROM one_way
         UNION ALL SELECT x.word, x.n, y.word, y.n FROM holes x JOIN holes y USING (p, a, z) WHERE x.word <> y.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY 1),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * words.n THEN near END AS form,
                  CASE WHEN near_n >= 5 * words.n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
followed(word, root, above) AS (SELECT word, word, form FROM formed
    UNION ALL SELECT followed.word, formed.word, formed.form FROM followed JOIN formed ON followed.above = formed.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM followed WHERE above IS NULL) USING (word)
"""

PREFIX_TRIE = f"""
WITH RECURSIVE t AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(r), encode(x)) AS place
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id AS id, conv_id::VARCHAR AS s FROM t), {_CRC.format(table='ids')},
heads AS (SELECT id AS c, h % 9 AS h, (SELECT count(*) FROM t WHERE conv_id = id - id % 5) AS base FROM crc),
turns AS (SELECT c, place AS d, r, x FROM heads JOIN t ON conv_id = c - c % 5 AND place <= h
          UNION ALL SELECT c, least(h, base) + place - h, r, x FROM heads JOIN t ON conv_id = c AND place > h),
path AS (SELECT c, 0::BIGINT AS d, '' AS node, 0::BIGINT AS size FROM heads UNION ALL
         SELECT c, d, array_to_string(list(sha256(r || chr(10) || x)) OVER (PARTITION BY c ORDER BY d), ','), strlen(x) FROM turns),
ends AS (SELECT c, max(d) AS d FROM path GROUP BY 1),
nodes AS (SELECT node, d, min(c) AS c, count(*) AS n, any_value(size) AS size,
          sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends.d IS NOT NULL), '')) AS ends_sha256
          FROM path LEFT JOIN ends USING (c, d) GROUP BY ALL),
up AS (SELECT a.node, b.node AS above FROM nodes a JOIN path b ON b.c = a.c AND b.d = a.d - 1),
children AS (SELECT above AS node, count(*) AS n_children FROM up GROUP BY 1),
trees AS (SELECT p.node, sum((v.n - 1) * v.size) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
          FROM nodes v LEFT JOIN children k ON k.node = v.node JOIN path p ON p.c = v.c AND p.d <= v.d GROUP BY 1)
SELECT nodes.c AS conv_id, nodes.d AS depth, parent.c AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN trees USING (node) LEFT JOIN children USING (node) LEFT JOIN up USING (node) LEFT JOIN nodes parent ON parent.node = up.above
"""
