"""DuckDB SQL with the results of this subpackage's queries, by other means than theirs: whole lines, windows and sets in place of hashes."""

from __future__ import annotations

from . import mixing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[0-9a-z\x{80}-\x{10ffff}]+"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


#: Texts with one sequence of words are one node; nodes that share a shingle are compared, and components are closed by reachability.
OP1 = rf"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
nodes AS MATERIALIZED (SELECT array_to_string(w, ' ') AS words, any_value(w) AS w, min(doc_id) AS least, row_number() OVER () AS node FROM docs WHERE len(w) > 0 GROUP BY ALL),
named AS MATERIALIZED (SELECT words, min(node) AS node, min(least) AS least, any_value(w) AS w FROM nodes GROUP BY words),
shingles AS MATERIALIZED (
    SELECT DISTINCT node, unnest(CASE WHEN len(w) < 3 THEN [words] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM named
),
sizes AS MATERIALIZED (SELECT node, count(*) AS n FROM shingles GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node),
links AS MATERIALIZED (SELECT c.a, c.b FROM common c JOIN sizes x ON x.node = c.a JOIN sizes y ON y.node = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT node, node FROM named UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT r.node, min(n.least) AS component_id FROM reach r JOIN named n ON n.node = r.other GROUP BY r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN named n ON n.words = array_to_string(d.w, ' ') LEFT JOIN sizes s ON s.node = n.node LEFT JOIN roots c ON c.node = n.node
"""

#: Windows by their words; rows without a doc_id neither lose nor remove words.
OP2 = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
windows AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT key, min(doc_id) AS least FROM windows GROUP BY key),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (key) WHERE least < doc_id),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS left_over FROM words w ANTI JOIN gone g ON g.r = w.r AND g.i = w.i GROUP BY w.r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""

#: The payloads are grouped whole; rows without a page_id are never referred to.
OP4 = """
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
    CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to
FROM (
    SELECT page_id, payload, CASE WHEN octet_length(encode(payload)) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload) THEN max(page_id) OVER (PARTITION BY payload) END AS refers
    FROM (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS payload FROM pages)
)
"""


def _number(*parts: str) -> str:
    """A pseudorandom number from SQL texts."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


_SEED, _BLOCK, _SHARD = f"'{mixing.SEED}'", mixing.BLOCK_WORDS, mixing.SHARD_SLOTS


def _network(slots: str) -> str:
    """One pass of slots (k, shard, turn, n_blocks, rows, cols, x) through the Feistel network."""
    moved = lambda k, value: _number(_SEED, "CAST(k AS VARCHAR)", "CAST(turn AS VARCHAR)", f"'{k}'", f"CAST({value} AS VARCHAR)")
    one = f"SELECT k, shard, turn, n_blocks, rows, cols, x % cols AS r0, (x // cols + {moved(0, 'x % cols')}) % rows AS l1 FROM ({slots})"
    two = f"SELECT *, (r0 + {moved(1, 'l1')}) % cols AS r1 FROM ({one})"
    three = f"SELECT *, (l1 + {moved(2, 'r1')}) % rows AS l2 FROM ({two})"
    return f"SELECT k, shard, turn, n_blocks, rows, cols, l2 * cols + (r1 + {moved(3, 'l2')}) % cols AS x FROM ({three})"


#: Every slot by itself: a hash deals it to a shard, its number counts the slots of its source before it, and a permutation gives its block.
OP5 = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size, {_number("'text'", "coalesce(text, 'null')")} AS h FROM documents
),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
listed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sources),
weighed AS (SELECT *, CAST([{", ".join(map(str, mixing.WEIGHTS))}][k % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight, source_size * CAST({mixing.CAP} AS DOUBLE) AS cap FROM listed),
levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
),
targets AS (SELECT source, source_size, k, least(cap, weight * max(level) OVER ()) AS target FROM levels),
sized AS (SELECT *, CAST(ceil(source_size / {_BLOCK}) AS BIGINT) AS n_blocks, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets),
plan AS MATERIALIZED (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(passes * n_blocks + round((target - passes * source_size) * n_blocks / source_size) AS BIGINT) ELSE 0 END AS n_slots FROM sized
),
shards AS (SELECT greatest(1, CAST(ceil(sum(n_slots) / {_SHARD}) AS BIGINT)) AS n FROM plan),
dealt AS (SELECT k, n_blocks, {_number(_SEED, "'shard'", "CAST(k AS VARCHAR)", "CAST(j AS VARCHAR)")} % shards.n AS shard FROM (SELECT k, n_blocks, unnest(range(n_slots)) AS j FROM plan), shards),
slots AS (SELECT k, n_blocks, shard, row_number() OVER (PARTITION BY k ORDER BY shard) - 1 AS n FROM dealt),
formed AS (SELECT k, shard, n // n_blocks AS turn, n_blocks, rows, (n_blocks + rows - 1) // rows AS cols, n % n_blocks AS x FROM (SELECT *, CAST(ceil(sqrt(n_blocks)) AS BIGINT) AS rows FROM slots)),
walk AS ({_network("SELECT * FROM formed")} UNION ALL {_network("SELECT k, shard, turn, n_blocks, rows, cols, x FROM walk WHERE x >= n_blocks")}),
blocks AS MATERIALIZED (SELECT k, shard, x AS block FROM walk WHERE x < n_blocks),
placed AS MATERIALIZED (
    SELECT d.*, p.k, p.source_size, p.target, CAST(coalesce(sum(size) OVER (
        PARTITION BY p.k ORDER BY {_number("'bucket'", "coalesce(CAST(doc_id AS VARCHAR), 'null')", "CAST(h AS VARCHAR)")} % {mixing.BUCKETS}, doc_id NULLS FIRST, h, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM docs d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
),
spread AS (
    SELECT r, k, block, least((block + 1) * {_BLOCK}, start + size) - greatest(block * {_BLOCK}, start) AS words
    FROM (SELECT r, k, start, size, unnest(range(start // {_BLOCK}, (start + size - 1) // {_BLOCK} + 1)) AS block FROM placed WHERE size > 0)
),
taken AS (SELECT r, CAST(sum(words) AS BIGINT) AS taken, count(DISTINCT shard) AS n_shards FROM spread JOIN blocks USING (k, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_shards, 0) AS n_shards FROM placed LEFT JOIN taken USING (r)
"""

#: What of op6 is the same in any container.
AVI_PAYLOAD = """
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + fill AS BIGINT) AS payload_bytes, sha256(raw || repeat('\\xFF'::BLOB, fill)) AS payload_sha256
FROM (SELECT doc_id, raw, octet_length(raw) AS n, greatest(1, (octet_length(raw) + 575) // 576) * 576 - octet_length(raw) AS fill FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents))
"""

#: Lines by whole keys in place of hashes; a row without a doc_id counts as a document of its own.
OP7 = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM docs),
keyed AS MATERIALIZED (SELECT *, {lowered("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
shared AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT coalesce('id ' || doc_id, 'row ' || r)) >= 5
),
marked AS (SELECT r, k.doc_id, i, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

#: Windows joined by their words.
OP8 = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{LETTERS}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{LETTERS}') AS w FROM benchmark),
wanted AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
windows AS (
    SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM wanted))
),
hits AS MATERIALIZED (SELECT r, windows.size, i, item_id FROM windows JOIN wanted ON windows.size = wanted.size AND windows.key = wanted.key),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", 0, _ASSIGN, "length(regexp_extract(m, pattern, 2)) >= 12"), ("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"), ("hex", 2, "[0-9a-f]+", "length(m) >= 16")]


def _spans(kind: str, k: int, pattern: str, keeps: str) -> str:
    """Matches of a pattern with their places: what lies between them and what they are, added up."""
    keeps = keeps.replace("pattern", f"'{pattern}'")
    return f"""SELECT r, '{kind}' AS kind, {k} AS k, s, s + length(m) AS e FROM (
    SELECT r, m, CAST(sum(length(between_)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT r, unnest(found) AS m, unnest(regexp_split_to_array(text, '{pattern}')[:len(found)]) AS between_, generate_subscripts(found, 1) AS i FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS found FROM docs) WHERE len(found) > 0)
) WHERE {keeps}"""


#: What of op10 its patterns alone decide.
SECRET_BASE_SPANS = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans(*x) for x in _KINDS)}),
told AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS list, {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for kind, k, _, _ in _KINDS)} FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _KINDS)}, sha256(coalesce(list, '')) AS base_sha256 FROM docs LEFT JOIN told USING (r)
"""

#: CRC-32 of a text, byte by byte through a table of 256 steps.
CRC_STEPS = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_steps"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text in UTF-8, beside a row of CRC_STEPS."""
    data = f"list_transform(range(1, CAST(octet_length(encode({text})) AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc_steps[(xor(c, b) & 255) + 1])), 4294967295)"


#: Nodes by the turns of their members, ancestors by members that two nodes share.
OP11 = f"""
WITH crc AS MATERIALIZED ({CRC_STEPS}),
own AS MATERIALIZED (
    SELECT CAST(conv_id AS BIGINT) AS c, list({{'code': code, 'size': size}} ORDER BY turn NULLS FIRST, code) AS turns
    FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
),
numbered AS (SELECT c, turns, CAST({crc32("CAST(c AS VARCHAR)")} % 6 AS INT) AS h FROM own, crc),
rebuilt AS MATERIALIZED (SELECT n.c, list_concat(coalesce(b.turns, [])[:n.h], n.turns[n.h + 1:]) AS turns FROM numbered n LEFT JOIN own b ON b.c = n.c - n.c % 100),
members AS MATERIALIZED (
    SELECT c, d, len(turns) = d AS ends, CASE WHEN d > 0 THEN turns[d].size ELSE 0 END AS size, array_to_string(list_transform(turns[:d], lambda t: t.code), '') AS key
    FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS MATERIALIZED (
    SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY key
),
children AS MATERIALIZED (SELECT left(key, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (SELECT left(n.key, CAST(32 * k AS INT)) AS key, sum(n.saved) AS saved, count(*) FILTER (WHERE ch.n IS NULL) AS leaves FROM (SELECT key, saved, unnest(range(depth + 1)) AS k FROM nodes) n LEFT JOIN children ch ON ch.key = n.key GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (key) LEFT JOIN children ch USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, length(n.key) - 32)
"""

#: Near words by their heads and tails around each place, forms by counting, roots by following forms.
OP13 = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_STEPS}),
runs AS MATERIALIZED (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS times
    FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL
),
hashed AS (SELECT run, times, {crc32("named")} AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
places AS MATERIALIZED (SELECT word, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM words)),
shorter AS MATERIALIZED (SELECT DISTINCT p.word AS a, w.word AS b FROM places p JOIN words w ON w.word = p.head || p.tail),
pairs AS MATERIALIZED (SELECT a, b FROM shorter UNION SELECT b, a FROM shorter UNION SELECT p.word, q.word FROM places p JOIN places q ON p.head = q.head AND p.tail = q.tail AND p.word <> q.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS best, max(w.n) AS best_n FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)),
climb(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN climb c ON c.word = f.word JOIN forms r ON r.word = c.root WHERE r.form IS NULL
"""

SQL = {
    "op1_minhash": OP1,
    "op2_substring_dedup": OP2,
    "op4_warc": OP4,
    "op5_mixing": OP5,
    "op7_line_dedup": OP7,
    "op8_decontaminate": OP8,
    "op11_prefix_trie": OP11,
    "op13_spelling": OP13,
    "avi_payload": AVI_PAYLOAD,
    "secret_base_spans": SECRET_BASE_SPANS,
}
