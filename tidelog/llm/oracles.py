"""SQL for the operators that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from tidelog.llm import mixing as m
from tidelog.llm import quality_rules as q

_WS = "[\\x20\\x09-\\x0D]+"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 4),
p AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM p WHERE five IS NOT NULL),
g AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS span FROM k WHERE c > 1),
r AS (SELECT rid, sum(span) AS n_repeat FROM g GROUP BY rid),
raw AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM d),
nl AS (SELECT rid, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(lower(regexp_replace(regexp_replace(x, '{_WS}', ' ', 'g'), '[0-9]', '0', 'g')))), lambda x: x <> '') AS ls FROM d),
li AS (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM nl WHERE len(ls) > 0),
l AS (SELECT li.rid, d.host, d.t, ls[i] AS x, len(string_split(ls[i], ' ')) AS n FROM li JOIN d ON li.rid = d.rid),
h AS (SELECT source AS host, count(DISTINCT text) + max(CAST(text IS NULL AS INT)) AS host_docs FROM documents GROUP BY source),
c AS (SELECT host, x, count(DISTINCT t) AS n_docs FROM l GROUP BY host, x),
bad AS (SELECT c.host, c.x FROM c JOIN h ON c.host IS NOT DISTINCT FROM h.host WHERE n_docs > {q.LINE_DOCS} AND n_docs > least({q.MOST_LINE_DOCS}, {q.LINE_SHARE} * host_docs)),
gone AS (SELECT l.rid, sum(l.n) AS lost FROM l JOIN bad ON l.x = bad.x AND l.host IS NOT DISTINCT FROM bad.host GROUP BY l.rid),
f AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS removed_words
  FROM d JOIN w ON d.rid = w.rid JOIN raw ON d.rid = raw.rid LEFT JOIN r ON d.rid = r.rid LEFT JOIN gone ON d.rid = gone.rid)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND removed_words <= {q.DEPLETED} * n_words AS kept FROM f
"""


def _key(k: int | str) -> str:
    return f"((((rank * 7919 + turn * 104729 + {k} * 1299709 + 17) % {m.PRIME}) + 1) * {m.FACTOR} % {m.PRIME})"


def _rounds() -> str:
    """The rounds of the permutation, one subquery each."""
    steps = []
    for k in range(m.ROUNDS):
        steps.append(f"a{k} AS (SELECT *, (({_key(k)} - x) % n_blocks + n_blocks) % n_blocks AS y FROM b{k})")
        steps.append(f"c{k} AS (SELECT *, (greatest(x, y) % {m.PRIME} + 1) * {_key(k + m.ROUNDS)} % {m.PRIME} AS h FROM a{k})")
        steps.append(f"b{k + 1} AS (SELECT rank, turn, n_blocks, CASE WHEN (h * h % {m.PRIME}) // 1024 % 2 = 1 THEN y ELSE x END AS x FROM c{k})")
    return ",\n".join(steps)


MIXING = f"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN {m.WEIGHTS[0]} WHEN 1 THEN {m.WEIGHTS[1]} ELSE {m.WEIGHTS[2]} END AS weight FROM s1),
s3 AS (SELECT *, source_size * {m.MOST_PASSES} / weight AS fill FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () AS every, coalesce(sum(source_size) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM s3),
s5 AS (SELECT *, (every - filled * {m.MOST_PASSES}) / weight_left AS lv FROM s4),
s6 AS (SELECT *, max(CASE WHEN lv <= fill THEN lv END) OVER () AS level FROM s5),
s7 AS (SELECT rank, source, source_size, CAST(least(source_size * {m.MOST_PASSES}, coalesce(level * weight, source_size * {m.MOST_PASSES})) AS DOUBLE) AS target, CAST(ceil(source_size / {m.BLOCK_WORDS}) AS BIGINT) AS n_blocks FROM s6),
s AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(round(target * n_blocks / source_size) AS BIGINT), n_blocks * {m.MOST_PASSES}) ELSE 0 END AS n_slots FROM s7),
q AS (SELECT doc_id, size, s.rank, (((doc_id % {m.PRIME} + {m.PRIME}) % {m.PRIME} + size * 7919 % {m.PRIME} + 1) * {m.FACTOR} % {m.PRIME}) % (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) FROM z) AS chunk FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY chunk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, row_number() OVER () AS rid FROM q),
e AS (SELECT *, unnest(range(CAST(start // {m.BLOCK_WORDS} AS BIGINT), CAST((start + size - 1) // {m.BLOCK_WORDS} + 1 AS BIGINT))) AS block FROM o WHERE size > 0),
slot AS (SELECT rank, n_blocks, unnest(range(0, n_slots)) AS k FROM s WHERE n_slots > 0),
b0 AS (SELECT rank, k // n_blocks AS turn, n_blocks, k % n_blocks AS x FROM slot),
{_rounds()},
t AS (SELECT rank, x AS block, count(*) AS times FROM b{m.ROUNDS} GROUP BY rank, x),
y AS (SELECT e.rid, sum(times * (least((e.block + 1) * {m.BLOCK_WORDS} - start, size) - greatest(e.block * {m.BLOCK_WORDS} - start, 0))) AS taken FROM e JOIN t ON e.rank = t.rank AND e.block = t.block GROUP BY e.rid)
SELECT o.doc_id, o.size, s.source_size, s.target, CAST(coalesce(y.taken, 0) AS BIGINT) AS taken FROM o JOIN s ON o.rank = s.rank LEFT JOIN y ON o.rid = y.rid
"""


def _normal(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '{_WS}', ' ', 'g')))"


_MARKS = "^(?:[ \\t]*>)+[ \\t]?"

QUOTES = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id AS conv, turn, role, text FROM conversations),
ls AS (SELECT rid, conv, turn, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS ls FROM m),
ln AS (SELECT rid, conv, turn, unnest(ls) AS x, unnest(range(0, len(ls))) AS pos FROM ls),
lv AS (SELECT rid, conv, turn, pos, length(regexp_replace(regexp_extract(x, '{_MARKS}'), '[^>]', '', 'g')) AS level, regexp_replace(x, '{_MARKS}', '') AS body FROM ln),
own AS (SELECT rid, conv, turn, trim(string_agg(body, chr(10) ORDER BY pos), {_BLANK}) AS t FROM lv WHERE level = 0 GROUP BY rid, conv, turn),
said AS (SELECT conv, turn, {_normal('t')} AS h FROM own UNION SELECT conv, turn, {_normal('body')} FROM lv WHERE level = 0),
nb AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos) - row_number() OVER (PARTITION BY rid, level ORDER BY pos) AS island FROM lv WHERE trim(body, chr(32) || chr(9) || chr(13)) <> ''),
pas AS (SELECT conv, turn, level, string_agg(body, ' ' ORDER BY pos) AS t FROM nb WHERE level > 0 GROUP BY rid, conv, turn, level, island),
q AS (SELECT conv, turn, level, {_normal('t')} AS h FROM pas UNION SELECT conv, turn, level, {_normal('body')} FROM nb WHERE level > 0),
f AS (SELECT q.conv, q.turn, q.level, q.h, max(s.turn) AS origin FROM q JOIN said s ON q.conv IS NOT DISTINCT FROM s.conv AND q.h = s.h AND s.turn < q.turn WHERE q.h <> '' GROUP BY q.conv, q.turn, q.level, q.h),
v AS (SELECT conv, turn, level, origin, sum(len(string_split(h, ' '))) AS words FROM f GROUP BY conv, turn, level, origin),
r AS (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY level, words DESC, origin DESC) AS n FROM v),
b AS (SELECT conv, turn, origin, words FROM r WHERE n = 1),
d AS (SELECT DISTINCT conv, turn FROM m WHERE turn IS NOT NULL),
pr AS (SELECT conv, turn, lag(turn) OVER (PARTITION BY conv ORDER BY turn) AS before FROM d),
rp AS (SELECT pr.conv, pr.turn, pr.before, coalesce(b.origin, pr.before) AS parent, b.words FROM pr LEFT JOIN b ON pr.conv IS NOT DISTINCT FROM b.conv AND pr.turn = b.turn),
walk AS (SELECT conv, turn, [turn] AS way, turn AS branch FROM rp WHERE parent IS NULL
  UNION ALL SELECT rp.conv, rp.turn, list_append(walk.way, rp.turn), CASE WHEN rp.parent = rp.before THEN walk.branch ELSE rp.turn END FROM walk JOIN rp ON walk.conv IS NOT DISTINCT FROM rp.conv AND rp.parent = walk.turn),
th AS (SELECT conv, turn, way[1] AS thread, branch, row_number() OVER (PARTITION BY conv ORDER BY way) AS position FROM walk),
c AS (SELECT rid, max(level) AS deep, count(*) FILTER (WHERE level > 0) AS n_quoted FROM lv GROUP BY rid)
SELECT m.conv AS conv_id, m.turn, m.role, CAST(c.deep AS BIGINT) AS quote_levels, CAST(c.n_quoted AS BIGINT) AS quoted_lines, rp.parent AS reply_to,
  CAST(coalesce(rp.words, 0) AS BIGINT) AS linked_words, th.thread, th.branch, CAST(coalesce(th.position, 0) AS BIGINT) AS position, coalesce(own.t, '') AS text,
  '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || coalesce(own.t, '') || chr(10) AS formatted
FROM m JOIN c ON m.rid = c.rid LEFT JOIN own ON m.rid = own.rid
  LEFT JOIN rp ON m.conv IS NOT DISTINCT FROM rp.conv AND m.turn = rp.turn LEFT JOIN th ON m.conv IS NOT DISTINCT FROM th.conv AND m.turn = th.turn
"""
