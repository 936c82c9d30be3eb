"""The SQL of those queries that SQL can express."""

from __future__ import annotations

from docloom.llm import mixing as mx
from docloom.llm import sharding as sh
from docloom.llm import url_filter as uf

#: CRC-32 byte by byte: the table follows from the reversed polynomial.
CRC_SQL = """bits AS (SELECT list(list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
sums AS (SELECT key, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM texts, bits)"""

OP1_SQL = f"""WITH texts AS (SELECT DISTINCT md5(coalesce(text, '')) AS key, coalesce(text, '') AS text FROM documents), {CRC_SQL},
records AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + {sh.OVERHEAD} AS size, md5(coalesce(text, '')) AS key, coalesce(md5(text), '{sh.NO_TEXT}') AS k, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS h FROM documents),
totals AS (SELECT sum(size) AS total, greatest(sum(size) // {sh.SHARDS * sh.GROUP_PART}, max(size)) AS most FROM records),
ordered AS (SELECT *, sum(size) OVER w - size AS pos, row_number() OVER w AS nth FROM records WINDOW w AS (ORDER BY k, h, doc_id, size ROWS UNBOUNDED PRECEDING)),
grouped AS (SELECT *, min(pos) OVER (PARTITION BY k) AS group_at, sum(size) OVER (PARTITION BY k) AS group_size FROM ordered),
placed AS (SELECT *, least((CASE WHEN group_size > most THEN 2 * pos + size ELSE 2 * group_at + group_size END) * {sh.SHARDS} // (2 * total), {sh.SHARDS - 1})::INTEGER AS shard FROM grouped, totals)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed JOIN sums USING (key)"""

P = mx.PRIME
KEY = f"(((sid * 1000003 + epoch * 7919 + r * 104729 + {mx.SEED}) % {P}) * 48271 % {P})"
OTHER = f"(((({KEY} * 16807 % {P}) * 69621 - x) % full_blocks + full_blocks) % full_blocks)"
ONCE = f"((greatest(x, {OTHER}) % {P} * 40014 + {KEY}) % {P})"
#: Where the permutation of a source's full blocks puts i.
PERMUTED = f"list_reduce([i] || range(1, {mx.ROUNDS + 1}), lambda x, r: CASE WHEN ((({ONCE} * {ONCE} + {KEY}) % {P}) >> 9) % 2 = 1 THEN {OTHER} ELSE x END)"
DRAWN = f"((sid * 1000003 + slot * 7919 + {mx.SEED}) % {P})"
DRAWN_ONCE = f"(({DRAWN} * 40014 + {mx.SEED}) % {P})"

OP2_SQL = f"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mx.WORD}'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, {list(mx.WEIGHTS)}[(sid - 1) % {len(mx.WEIGHTS)} + 1]::BIGINT AS weight, source_size * {mx.MOST} AS cap FROM sources),
rated AS (SELECT *, (sum(source_size) OVER ()::BIGINT * {mx.SHARE_PERCENT} - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 100) / (sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT * 100) AS rate FROM weighed),
goals AS (SELECT sid, source, source_size, cap, least(cap::DOUBLE, max(rate) OVER () * weight) AS target FROM rated),
owing AS (SELECT *, least(floor(target + 0.5)::BIGINT, cap) AS owed FROM goals),
plans AS (SELECT *, source_size // {mx.BLOCK} AS full_blocks, source_size % {mx.BLOCK} AS rest, owed // source_size AS epochs FROM owing WHERE owed > 0),
counted AS (SELECT *, full_blocks + (rest > 0)::BIGINT AS each, least((owed % source_size) // {mx.BLOCK}, full_blocks) AS last_full FROM plans),
tailed AS (SELECT *, owed % source_size - last_full * {mx.BLOCK} AS tail FROM counted),
numbered AS (SELECT *, unnest(range(epochs * each + last_full + (tail > 0)::BIGINT)) AS slot FROM tailed),
placed_slots AS (SELECT *, slot // each AS epoch, slot % each AS i FROM numbered),
slots AS (SELECT sid, epoch, CASE WHEN i < full_blocks THEN {PERMUTED} ELSE full_blocks END AS block, CASE WHEN epoch = epochs AND i = last_full THEN tail WHEN i < full_blocks THEN {mx.BLOCK} ELSE rest END AS words, (((({DRAWN_ONCE} * {DRAWN_ONCE} + {DRAWN}) % {P}) >> 9) % {mx.SHARDS})::INTEGER AS shard FROM placed_slots),
streams AS (SELECT s.doc_id, s.size, g.sid, g.source_size, g.target, sum(s.size) OVER w - s.size AS pos, row_number() OVER w AS nth FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source WINDOW w AS (PARTITION BY g.sid ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING)),
pieces AS (SELECT *, unnest(range((pos // {mx.BLOCK})::BIGINT, ((pos + size - 1) // {mx.BLOCK})::BIGINT + 1)) AS block FROM streams WHERE size > 0),
uses AS (SELECT p.sid, p.nth, s.shard, greatest(0, least(pos + size - p.block * {mx.BLOCK}, {mx.BLOCK}, s.words) - greatest(pos - p.block * {mx.BLOCK}, 0))::BIGINT AS words FROM pieces p JOIN slots s ON s.sid = p.sid AND s.block = p.block),
sums AS (SELECT sid, nth, shard, sum(words)::BIGINT AS words FROM uses WHERE words > 0 GROUP BY ALL),
taken AS (SELECT sid, nth, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards FROM sums GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, '') AS shards FROM streams LEFT JOIN taken USING (sid, nth)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share an element, which suits tables of a few thousand documents.
OP10_SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{mx.WORD}') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS elements FROM words),
members AS (SELECT doc_id, unnest(elements) AS e FROM sets),
sizes AS (SELECT doc_id, len(elements)::BIGINT AS n FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM members a JOIN members b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT a, b FROM ends UNION SELECT r.doc_id, l.b FROM reached r JOIN ends l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(m.other, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m.other, s.doc_id)) AS kept FROM sizes s LEFT JOIN least_of m ON m.doc_id = s.doc_id"""



def rule_case(part: int) -> str:
    """What the longest rule that fits says: its verdict (part 0) or itself (part 1)."""
    out = []
    for rule in sorted(uf.RULES, key=lambda r: (len(r[1]), r[1]), reverse=True):
        name, _, path = rule[1].partition("/")
        out.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{path}') THEN '{rule[part]}'")
    return f"CASE {' '.join(out)} END"


ALIKE = "(bad * all_labelled - all_bad * labelled)::DOUBLE ** 2 <= 4 * all_bad::DOUBLE * (all_labelled - all_bad) * labelled"
BOUND = f"sqrt(0.5 * ln(2 / {uf.LEVEL}::DOUBLE))"

#: The tree is rewritten as a whole at each place of the paths; branches are compared child by child.
OP9_SQL = f"""WITH RECURSIVE rests AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '\\A([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '\\A[^/?#]*([^?#]*)', 1) AS path FROM rests),
judged AS (SELECT *, {rule_case(1)} AS rule, {rule_case(0)} AS ruled, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END), '/') AS form FROM parsed),
tree(host, form, bad, labelled, pages, branch, place) AS (SELECT host, form, count(*) FILTER (ruled = 'block')::BIGINT, count(ruled)::BIGINT, count(*)::BIGINT, string_split(form, '/'), 0 FROM judged GROUP BY host, form
 UNION ALL (WITH cur AS (SELECT *, branch[:place] AS parent, branch[place + 1] AS raw, coalesce(branch[place + 2], '{uf.END}') AS child FROM tree WHERE place < (SELECT max(len(branch)) FROM tree)),
 fans AS (SELECT host, parent, count(DISTINCT raw) AS k FROM cur GROUP BY ALL),
 seg AS (SELECT cur.*, CASE WHEN raw IS NOT NULL AND k > {uf.FAN_OUT} THEN '*' ELSE raw END AS segment FROM cur JOIN fans USING (host, parent)),
 each AS (SELECT host, parent, segment, sum(bad)::BIGINT AS bad, sum(labelled)::BIGINT AS labelled, sum(pages)::BIGINT AS n FROM seg WHERE segment IS NOT NULL GROUP BY ALL),
 pool AS (SELECT host, parent, sum(bad)::BIGINT AS all_bad, sum(labelled)::BIGINT AS all_labelled, sum(n)::BIGINT AS all_n, count(*) AS k FROM each GROUP BY ALL),
 kids AS (SELECT host, parent, segment, child, sum(pages)::BIGINT AS c FROM seg WHERE segment IS NOT NULL GROUP BY ALL),
 kinds AS (SELECT host, parent, child, sum(c)::BIGINT AS all_c FROM kids GROUP BY ALL),
 unlike AS (SELECT DISTINCT e.host, e.parent, e.segment FROM each e JOIN kinds t USING (host, parent) JOIN pool p USING (host, parent) LEFT JOIN kids d ON d.host = e.host AND d.parent = e.parent AND d.segment = e.segment AND d.child = t.child WHERE abs(coalesce(d.c, 0) / e.n - t.all_c / p.all_n) > {BOUND} * (1 / sqrt(e.n) + 1 / sqrt(p.all_n))),
 same AS (SELECT e.host, e.parent, e.segment FROM each e JOIN pool p USING (host, parent) ANTI JOIN unlike u ON u.host = e.host AND u.parent = e.parent AND u.segment = e.segment WHERE k >= 2 AND {ALIKE})
 SELECT g.host, g.form, g.bad, g.labelled, g.pages, CASE WHEN g.segment IS NULL THEN g.branch ELSE g.branch[:g.place] || [CASE WHEN s.segment IS NULL THEN g.segment ELSE '{uf.MERGED}' END] || g.branch[g.place + 2:] END, g.place + 1 FROM seg g LEFT JOIN same s ON s.host = g.host AND s.parent = g.parent AND s.segment = g.segment)),
leaves AS (SELECT * FROM tree WHERE place = (SELECT max(place) FROM tree)),
pooled AS (SELECT *, {ALIKE} AS near FROM (SELECT *, sum(bad) OVER w AS all_bad, sum(labelled) OVER w AS all_labelled FROM leaves WINDOW w AS (PARTITION BY host, branch))),
merged AS (SELECT *, CASE WHEN near THEN sum(bad) FILTER (near) OVER w ELSE bad END AS b, CASE WHEN near THEN sum(labelled) FILTER (near) OVER w ELSE labelled END AS m FROM pooled WINDOW w AS (PARTITION BY host, branch)),
verdicts AS (SELECT host, form, array_to_string(list_transform(branch, lambda s: CASE WHEN s = '{uf.MERGED}' THEN '**' ELSE s END), '/') AS template, CASE WHEN (b + {uf.PRIOR * uf.STRENGTH}) / (m + {uf.STRENGTH}) >= {uf.REJECT} THEN 'block' ELSE 'allow' END AS by_template FROM merged)
SELECT page_id, j.host, path, rule, coalesce(ruled, by_template) AS verdict, template FROM judged j JOIN verdicts v ON v.host = j.host AND v.form = j.form"""

SQL = {"op1_shards": OP1_SQL, "op2_mix": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_near_dedup": OP10_SQL}
