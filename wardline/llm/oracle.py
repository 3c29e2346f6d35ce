"""DuckDB statements of the queries that SQL can say."""
from __future__ import annotations

from .urls import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM item a JOIN item b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * shared >= 80 * (na + nb - shared)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {_VALID}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(
    range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE {_VALID}),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(range(1, least(len(a.e), len(b.e)) + 1), lambda i: a.e[i] * b.e[i])) / (a.size * b.size) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
found AS (
  SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
    least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""


def _rules(column: int) -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE {cases} END"


URLS = f"""
WITH RECURSIVE page AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
seg AS (
  SELECT *, {_rules(0)} AS rule, {_rules(1)} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
    CASE WHEN regexp_matches(x, '^[0-9a-f]{{8,}}([.][A-Za-z0-9]+)?$|^[^.]*[0-9][^.]*([.][A-Za-z0-9]+)?$') THEN '*' ELSE x END) AS parts FROM page),
tree AS (
  SELECT host, parts, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, 0 AS k, '' AS b,
    CAST(NULL AS DOUBLE) AS purity, len(parts) > 0 AS split
  FROM seg GROUP BY host, parts
  UNION ALL (
  WITH kid AS (
    SELECT host, b, parts[k + 1] AS s, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, sum(sum(n)) OVER (PARTITION BY host, b) AS total
    FROM tree WHERE split GROUP BY 1, 2, 3),
  kept AS (
    SELECT *, CASE WHEN s = '*' OR n >= greatest(5, total * 0.02) THEN s WHEN labelled = 0 THEN '*'
      WHEN 2 * blocked >= labelled THEN '*blocked' ELSE '*allowed' END AS kept FROM kid),
  branch AS (
    SELECT host, b, kept, sum(labelled) AS labelled, sum(blocked) AS blocked, (sum(blocked) + 1) / (sum(labelled) + 2) AS rate FROM kept GROUP BY 1, 2, 3),
  last AS (
    SELECT *, lag(rate) OVER o AS rate0, lag(labelled) OVER o AS n0 FROM branch
    WINDOW o AS (PARTITION BY host, b, labelled > 0 ORDER BY rate, kept)),
  new AS (
    SELECT *, CASE WHEN rate0 IS NULL OR labelled = 0 THEN 1 WHEN rate - rate0 > 1.96 * sqrt(
      (rate * labelled + rate0 * n0) / (labelled + n0) * (1 - (rate * labelled + rate0 * n0) / (labelled + n0)) * (1 / labelled + 1 / n0))
      THEN 1 ELSE 0 END AS new FROM last),
  class AS (SELECT *, sum(new) OVER (PARTITION BY host, b, labelled > 0 ORDER BY rate, kept) AS class FROM new),
  named AS (
    SELECT host, b, kept, b || '/' || min(kept) OVER c AS next, sum(labelled) OVER c AS labels, sum(blocked) OVER c AS bad FROM class
    WINDOW c AS (PARTITION BY host, b, labelled > 0, class))
  SELECT t.host, t.parts, t.n, t.labelled, t.blocked, t.k + 1, m.next,
    CASE WHEN m.labels > 0 THEN (m.bad + 1) / (m.labels + 2) ELSE t.purity END, m.bad > 0 AND m.bad < m.labels AND len(t.parts) > t.k + 1
  FROM tree t JOIN (SELECT host, b, s, next, labels, bad FROM kept JOIN named USING (host, b, kept)) m
    ON t.host = m.host AND t.b = m.b AND t.parts[t.k + 1] = m.s
  WHERE t.split))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(purity, 0) >= 0.7 THEN 'block' ELSE 'allow' END) AS verdict
FROM seg JOIN (SELECT host, parts, purity FROM tree WHERE NOT split) USING (host, parts)
"""

FIM = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _conversations() -> str:
    """The repair as a recursion from each conversation's last row to its first: per role state
    (0 nothing yet, 1 after s, 2 after u, 3 after a) the least (cost, audit, repaired text) of what follows."""
    goes, role = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def plus(cost: str, letter: str, row: str, rest: str) -> str:
        return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {row} || {rest}.r}}"

    def keep(s: int) -> str:
        to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s]
        return " ".join(f"WHEN i0 = '{i}' THEN " + plus("late", "K", "chr(10) || role || ':' || t", f"s{k}") for i, k in to.items())

    def edited(s: int) -> str:
        gone = plus("4", "D", "''", f"s{s}")
        reroled = plus("late + 3", "R", f"chr(10) || '{role[s]}:' || t", f"s{goes[s]}")
        return f"least({gone}, CASE WHEN fault < 2 THEN {reroled} END, CASE WHEN fault >= 2 THEN NULL {keep(s)} END) AS s{s}"

    def inserted(s: int) -> str:
        return f"least(s{s}, " + plus("3", "I", f"chr(10) || '{role[s]}:'", f"s{goes[s]}") + f") AS s{s}"

    edit, insert = (", ".join(map(f, range(4))) for f in (edited, inserted))
    return f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS draw
  FROM conversations, tab),
bad AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS time FROM raw),
seen AS (
  SELECT *, row_number() OVER o AS i, row_number() OVER (PARTITION BY conv_id, role, t ORDER BY turn NULLS FIRST) AS nth,
    left(role, 1) AS i0, lag(left(role, 1)) OVER o AS before FROM bad WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(t))),
row AS (
  SELECT *, CASE WHEN rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 2 WHEN nth > 1 THEN 3
    WHEN right(rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault FROM seen),
late AS (SELECT *, CASE fault WHEN 1 THEN 3 ELSE 0 END AS late FROM row),
cheap(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, max(i), {{'c': 0, 'a': '', 'r': ''}}, {{'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': 3, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'r': ''}} FROM row GROUP BY 1 UNION ALL
  SELECT conv_id, i, {insert} FROM (SELECT conv_id, i, {insert} FROM (
    SELECT l.conv_id, l.i - 1 AS i, {edit} FROM cheap c JOIN late l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.i))),
count AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
    count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (i > 1 AND before || i0 NOT IN ('su', 'ua', 'au')) AS illegal FROM row GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN count n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN cheap c ON c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.i = 0
"""


CONVERSATIONS = _conversations()
