"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .decontamination import ANSWER, B, K1, LEAST_WORDS, NGRAM, QUESTION, SEGMENT, SLACK, THRESHOLD
from .licences import ALONE, FIRST_NOTICE, KNOWN, LICENCES, NAMES, NOTICE, PART_OF, RULES, TAG
from .line_dedup import LONG_LINE, UNIT
from .quality_rules import RULES as RULES_OF_QUALITY

ORACLES: dict[str, str] = {}

_WS = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _score(shard: int) -> str:
    return f"-1.0 / ln((('0x' || substr(md5(k || '#{shard}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


# crc32 by its public definition: reflected polynomial EDB88320, one table entry per byte value.
ORACLES["op4_rendezvous_shards"] = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n))
), docs AS (
  SELECT doc_id, coalesce(cast(doc_id AS varchar), '<null>') AS k, encode(coalesce(text, '')) AS b FROM documents
), summed AS (
  SELECT doc_id, k, octet_length(b) + 1 AS size,
    xor(list_reduce(list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc
  FROM docs, crc_table
), scored AS (
  SELECT *, [{", ".join(_score(s) for s in range(8))}] AS w, {_score(8)} AS more FROM summed
), placed AS (
  SELECT *, list_position(w, list_max(w)) - 1 AS shard,
    ('0x' || substr(md5(k || '@' || crc || CASE WHEN part > 0 THEN '#' || part ELSE '' END), 1, 8))::BIGINT % greatest(1, (SELECT ceil(count(*) / 65536.0)::BIGINT FROM documents)) AS g
  FROM (SELECT *, (row_number() OVER (PARTITION BY k, size, crc) - 1) // 65536 AS part FROM scored)
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST, size, crc, part) - 1)::BIGINT AS slot,
  (CASE WHEN more > list_max(w) THEN 8 ELSE shard END)::INTEGER AS grown_shard
FROM placed
"""

_LEDGER = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs
),
words AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM cut),
windows AS (
  SELECT rid, p, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY rid ORDER BY p)
),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
measured AS (
  SELECT cut.rid, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM cut LEFT JOIN covered ON cut.rid = covered.rid
),
ledger AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines AND n_lines >= 4 THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_exclamations > 40 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM measured
)
"""

_alnum = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format

# Every passage against every segment, by joins. For items of LEAST_WORDS words or more and scripts with spaces, as in the tables.
ORACLES["op1_decontamination"] = rf"""
WITH items AS (SELECT row_number() OVER () AS k, item_id, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
cut AS (SELECT *, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS p, string_split_regex(t, '\s+') AS w FROM items),
asked AS (
  SELECT k, item_id, CASE WHEN len(p) > 1 THEN left(t, length(t) - length(p[-1])) ELSE array_to_string(w[1:len(w) - greatest(1, len(w) // 3)], ' ') END AS q,
    CASE WHEN len(p) > 1 THEN p[-1] ELSE array_to_string(w[len(w) - greatest(1, len(w) // 3) + 1:], ' ') END AS a FROM cut
),
worded AS (SELECT k, item_id, {_alnum("q")} AS qw, {_alnum("a")} AS aw, list_concat({_alnum("q")}, {_alnum("a")}) AS w FROM asked),
counted AS (SELECT *, ((len(w) + {SEGMENT - 1}) // {SEGMENT}) AS n FROM worded WHERE len(w) >= {LEAST_WORDS}),
segments AS (SELECT k, i, w[i * (len(w) // n) + least(i, len(w) % n) + 1:(i + 1) * (len(w) // n) + least(i + 1, len(w) % n)] AS w FROM (SELECT *, unnest(range(n)) AS i FROM counted)),
whole AS (SELECT count(*) AS n, greatest(1, avg(len(w))) AS average FROM segments),
tf AS (SELECT k, i, len, t, count(*) AS tf FROM (SELECT k, i, len(w) AS len, unnest(w) AS t FROM segments) GROUP BY k, i, len, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weighed AS (SELECT k, i, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / average)) AS x FROM tf JOIN df USING (t), whole),
impacts AS (SELECT k, i, t, x / sum(x) OVER (PARTITION BY k, i) AS x FROM weighed),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_alnum("text")} AS w FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT DISTINCT rid, (place - 1) // {SEGMENT} AS c, t FROM (SELECT rid, unnest(w) AS t, generate_subscripts(w, 1) AS place FROM docs) WHERE t IN (SELECT t FROM df)),
passages AS (SELECT rid, c, t FROM chunks UNION SELECT rid, c - 1, t FROM chunks WHERE c > 0),
hits AS (SELECT rid, c, k, sum(x) AS score FROM passages JOIN impacts USING (t) GROUP BY rid, c, k, i HAVING sum(x) >= {THRESHOLD - SLACK}),
spans AS (SELECT rid, k, c, max(score) AS score FROM hits GROUP BY rid, k, c),
parts AS (SELECT k, 'q' AS part, qw AS w FROM counted UNION ALL SELECT k, 'a', aw FROM counted),
grams AS (
  SELECT DISTINCT k, part, size, array_to_string(w[p:p + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM (SELECT *, least({NGRAM}, len(w)) AS size FROM parts) WHERE size > 0)
),
sizes AS (SELECT k, count(*) FILTER (part = 'q') AS q, count(*) FILTER (part = 'a') AS a FROM grams GROUP BY k),
held AS (
  SELECT rid, size, p - 1 AS p, array_to_string(w[p:p + size - 1], ' ') AS g
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM grams) WHERE rid IN (SELECT rid FROM spans))
),
met AS (
  SELECT rid, k, part, count(DISTINCT g) AS n FROM spans JOIN grams USING (k) JOIN held USING (rid, size, g)
  WHERE p >= c * {SEGMENT} - {SEGMENT} AND p + size <= c * {SEGMENT} + {3 * SEGMENT} GROUP BY rid, k, part
),
shares AS (
  SELECT rid, k, CASE WHEN q = 0 THEN 1.0 ELSE coalesce(max(n) FILTER (part = 'q'), 0)::DOUBLE / q END AS qs, CASE WHEN a = 0 THEN 1.0 ELSE coalesce(max(n) FILTER (part = 'a'), 0)::DOUBLE / a END AS answers
  FROM (SELECT DISTINCT rid, k FROM spans) LEFT JOIN met USING (rid, k) JOIN sizes USING (k) GROUP BY rid, k, q, a
)
SELECT doc_id, item_id, count(*) AS n_passages, round(max(score), 6) AS score, round(any_value(qs), 6) AS question_overlap, round(any_value(answers), 6) AS answer_overlap
FROM spans JOIN shares USING (rid, k) JOIN docs USING (rid) JOIN items USING (k) WHERE qs >= {QUESTION} AND answers >= {ANSWER} GROUP BY rid, k, doc_id, item_id
"""

ORACLES["op5_rule_ledger"] = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM ledger
"""

ORACLES["rule_ablations"] = f"""{_LEDGER},
bits(rule, bit) AS (VALUES {", ".join(f"('{rule.name}', {1 << i})" for i, rule in enumerate(RULES_OF_QUALITY))})
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_fail, count(*) FILTER (fail_bits = bit) AS n_only, count(*) FILTER (fail_bits & ~bit = 0) AS n_kept_without FROM bits, ledger GROUP BY rule
"""

#: Removes later occurrences of repeated three-unit windows; reads a relation ``docs0`` (doc_id, text, ...).
LINE_DEDUP = rf"""
lines0 AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS raw, unnest(string_split(text, chr(10))) AS line
  FROM (SELECT DISTINCT doc_id, text FROM docs0 WHERE doc_id IS NOT NULL AND text IS NOT NULL)
),
cut0 AS (SELECT *, CASE WHEN regexp_matches(line, '{LONG_LINE}') THEN regexp_extract_all(line, '{UNIT}') ELSE [line] END AS u FROM lines0),
units0 AS (SELECT doc_id, text, raw, generate_subscripts(u, 1) AS piece, unnest(u) AS unit FROM cut0),
solid0 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY raw, piece) AS pos FROM (
    SELECT doc_id, text, raw, piece, trim(unit, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS line FROM units0) WHERE line <> ''
),
windows0 AS (
  SELECT doc_id, text, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM solid0 WINDOW o AS (PARTITION BY doc_id, text ORDER BY pos)
),
later0 AS (
  SELECT doc_id, text, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, substr(md5(text), 1, 15), pos) AS nth FROM windows0 WHERE c IS NOT NULL) WHERE nth > 1
),
gone0 AS (
  SELECT DISTINCT s.doc_id, s.text, s.raw, s.piece FROM solid0 s JOIN later0 l ON s.doc_id = l.doc_id AND s.text = l.text AND s.pos BETWEEN l.pos AND l.pos + 2
),
rest0 AS (
  SELECT u.doc_id, u.text, u.raw, string_agg(u.unit, '' ORDER BY u.piece) FILTER (g.raw IS NULL) AS line, count(g.raw) AS n
  FROM units0 u LEFT JOIN gone0 g ON u.doc_id = g.doc_id AND u.text = g.text AND u.raw = g.raw AND u.piece = g.piece GROUP BY u.doc_id, u.text, u.raw
),
left0 AS (
  SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY raw) FILTER (line IS NOT NULL), '') AS new_text, sum(n)::BIGINT AS n FROM rest0 GROUP BY doc_id, text
),
deduped0 AS (
  SELECT d.* REPLACE (coalesce(l.new_text, d.text) AS text), coalesce(l.n, 0)::BIGINT AS n_units_removed
  FROM docs0 d LEFT JOIN left0 l ON d.doc_id = l.doc_id AND d.text = l.text
)
"""

ORACLES["op9_window_line_dedup"] = f"""
WITH docs0 AS (SELECT doc_id, text FROM documents),
{LINE_DEDUP}
SELECT doc_id, n_units_removed, md5(coalesce(text, '')) AS text_md5 FROM deduped0
"""

ORACLES["op8_ngram_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs
), sized AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2
),
one_way AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (n - c)),
links AS (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way),
reached(node, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT doc_id, n AS n_shingles, m AS component_id FROM sized JOIN (SELECT node, min(other) AS m FROM reached GROUP BY node) ON node = doc_id
"""


def _licenses() -> str:
    """Another way to the same sentences: texts are cut at all ends that a sentence may have, and runs of pieces are looked up."""
    pairs = lambda values: ", ".join(f"('{a}', {b!r})" for a, b in values)
    rules = ", ".join(f"('{name}', '%{'%'.join(f',{i},' for i in seq)}%')" for name, seq in RULES)
    longest = max(len(x) for x in KNOWN) // 10
    return rf"""
WITH known(sentence, id) AS (VALUES {pairs(KNOWN.items())}), names(name, id) AS (VALUES {pairs(NAMES.items())}), rules(name, pattern) AS (VALUES {rules}), parts(part, whole) AS (VALUES {pairs(PART_OF)}),
licences(id, name) AS (VALUES {", ".join(f"({FIRST_NOTICE + i}, '{x}')" for i, x in enumerate(LICENCES))}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
stopped AS (SELECT rid, regexp_replace(regexp_replace(t, '[.!?][\x20\x09-\x0D]+', chr(1), 'g'), '([;:])([\x20\x09-\x0D])', '\1' || chr(2) || '\2', 'g') AS t FROM docs),
bare AS (SELECT rid, regexp_replace(regexp_replace(t, '[^a-z0-9\n\x01\x02]+', ' ', 'g'), ' ?([\n\x01\x02]) ?', '\1', 'g') AS t FROM stopped),
segments AS (SELECT rid, generate_subscripts(s, 1) AS seg, unnest(s) AS t FROM (SELECT rid, string_split(regexp_replace(t, '\x02?\n\x02?', chr(2), 'g'), chr(1)) AS s FROM bare)),
pieces AS (SELECT rid, seg, generate_subscripts(p, 1) AS place, unnest(p) AS piece FROM (SELECT rid, seg, string_split(t, chr(2)) AS p FROM segments)),
solid AS (SELECT rid, seg, place, trim(piece) AS piece, place - row_number() OVER (PARTITION BY rid, seg ORDER BY place) AS island FROM pieces WHERE trim(piece) <> ''),
runs AS (
  SELECT a.rid, a.seg, a.place AS s, b.place AS e, b.piece AS last,
    string_agg(c.piece, ' ' ORDER BY c.place) AS sentence, coalesce(string_agg(c.piece, ' ' ORDER BY c.place) FILTER (c.place < b.place), '') AS head
  FROM solid a JOIN solid b ON a.rid = b.rid AND a.seg = b.seg AND a.island = b.island AND b.place BETWEEN a.place AND a.place + {longest}
  JOIN solid c ON c.rid = a.rid AND c.seg = a.seg AND c.place BETWEEN a.place AND b.place
  GROUP BY a.rid, a.seg, a.place, b.place, b.piece
),
found AS (
  SELECT rid, seg, s, e, 0 AS how, [id] AS ids FROM runs JOIN known USING (sentence)
  UNION ALL
  SELECT rid, seg, s, e, 1, (SELECT list(n.id ORDER BY k) FROM (SELECT replace(unnest(x), ' +', ' or later') AS name, generate_subscripts(x, 1) AS k FROM (SELECT string_split_regex(replace(substr(sentence, {len(TAG) + 1}), ' or later', ' +'), ' (?:or|and|with) ') AS x)) u JOIN names n USING (name))
  FROM runs WHERE starts_with(sentence, '{TAG}') AND starts_with('{TAG}', CASE WHEN head = '' THEN '' ELSE head || ' ' END)
  UNION ALL
  SELECT rid, seg, s, e, 2, [n.id] FROM runs JOIN names n ON regexp_matches(sentence, '^{NOTICE}') AND n.name = regexp_replace(sentence, '^{NOTICE}', '')
),
kept AS (
  SELECT DISTINCT ON (rid, seg, s, e) * FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.rid = f.rid AND g.seg = f.seg AND ((g.s < f.s AND g.e >= f.s) OR (g.s = f.s AND g.e > f.e))) ORDER BY rid, seg, s, e, how
),
best AS (SELECT rid, flatten(list(coalesce(ids, []) ORDER BY seg, s)) AS ids FROM kept GROUP BY rid),
named AS (
  SELECT rid, name FROM (SELECT rid, ',' || array_to_string(ids, ',,') || ',' AS line FROM best) JOIN rules ON line LIKE pattern
  UNION SELECT rid, name FROM (SELECT rid, unnest(ids) AS id FROM best) JOIN licences USING (id)
),
final AS (
  SELECT rid, string_agg(name, ',' ORDER BY name) AS names FROM named n
  WHERE NOT EXISTS (SELECT 1 FROM named m JOIN parts ON m.name = whole WHERE m.rid = n.rid AND part = n.name) AND (name <> '{ALONE}' OR (SELECT count(*) FROM named m WHERE m.rid = n.rid) = 1) GROUP BY rid
)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_license_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(names, '') AS licenses
FROM docs LEFT JOIN best USING (rid) LEFT JOIN final USING (rid)
"""


ORACLES["op10_license_rules"] = _licenses()

#: Levels written out in SQL: trees of up to 8^7 leaves a group, and 8^3 groups.
_DEEP, _WIDE = 7, 3
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n)))"""


def _crc(text: str) -> str:
    """crc32 of a text of ASCII characters, with ``t`` from crc_table."""
    return f"xor(list_reduce(list_transform(range(length({text})), lambda i: ascii(substr({text}, i + 1, 1))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    part = lambda null, x: f"CASE WHEN {null} IS NULL THEN '-' ELSE concat(octet_length(encode({x})), ':', {x}) END"
    return "sha256(concat(" + ", ".join([*(part(c, f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")), part("text", text)]) + "))"


def _levels(name: str, key: str, count: int) -> str:
    """Levels ``name``1, 2 ... over ``name``0 (key, i, n, h) with their runs' digests, and the nodes that groups end in."""
    ups = [f"{name}{k + 1} AS (SELECT {key}, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS kids FROM {name}{k} WHERE n > 1 GROUP BY {key}, i // 8, (n + 7) // 8)" for k in range(count)]
    ends = " UNION ALL ".join(f"SELECT {key}, h FROM {name}{k} WHERE n = 1" for k in range(count + 1))
    return ",\n".join((*ups, f"{name}_end AS ({ends})"))


def _step(kids: str, i: str, k: int) -> str:
    place = f"({i} // {8**k} % 8)"
    return f"CASE WHEN {kids} IS NOT NULL THEN concat(array_to_string({kids}[1:{place}], ''), '|', array_to_string({kids}[{place} + 2:], '')) END"


_STEPS = ", ".join([*(_step(f"l{k + 1}.kids", "d.i", k) for k in range(_DEEP)), *(_step(f"t{k + 1}.kids", "g.i", k) for k in range(_WIDE))])
ORACLES["op12_merkle_manifest"] = f"""
WITH {_CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce(concat('=', lang), '-') AS lang, {_leaf("text")} AS h,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, crc_table),
l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{_levels("l", "lang", _DEEP)},
t0 AS (SELECT 1 AS one, lang, h, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM l_end),
{_levels("t", "one", _WIDE)},
steps AS (
  SELECT d.doc_id, d.h AS leaf, d.changed, g.h AS subroot, list_filter([{_STEPS}], lambda s: s IS NOT NULL) AS s
  FROM l0 d JOIN t0 g ON g.lang = d.lang {" ".join(f"LEFT JOIN l{k + 1} ON l{k + 1}.lang = d.lang AND l{k + 1}.i = d.i // {8 ** (k + 1)}" for k in range(_DEEP))}
  {" ".join(f"LEFT JOIN t{k + 1} ON t{k + 1}.i = g.i // {8 ** (k + 1)}" for k in range(_WIDE))})
SELECT *, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, (SELECT h FROM t_end) AS root, sha256(replace(array_to_string(s, ''), '|', '')) AS proof_sha256,
    list_reduce(s, lambda h, x: sha256(concat(split_part(x, '|', 1), h, split_part(x, '|', 2))), coalesce(changed, leaf)) AS folded_root FROM steps)
"""

ORACLES["op11_hard_negatives"] = """
WITH moved AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS k FROM moved) WHERE k = 1),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM rows0 a JOIN rows0 b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM scored WHERE same) WHERE k <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
