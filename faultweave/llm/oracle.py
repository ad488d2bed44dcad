"""DuckDB SQL for the queries that SQL can express; written out, sharing only the licence texts with them."""

from __future__ import annotations

from collections.abc import Iterable

from faultweave.llm.licences import LICENCES

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, pattern) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]+'),
  (2, 'hex', '[0-9a-f]+'),
  (3, 'login', '(?i)(?:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id|key_?id)["'']?\x20*[:=]\x20*["'']?[a-z0-9@._-]{4,}'),
  (4, 'opaque', '[A-Za-z0-9+/_=-]+'),
  (5, 'endpoint', '(?i)(?:(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"''<>]+|(?:host|endpoint|server)["'']?\x20*[:=]\x20*["'']?(?:(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\x20\x09-\x0D"''<>]+|[a-z0-9._-]+))'),
  (6, 'scope', '\n[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*')
),
cut AS (
  SELECT row, rank, kind, pattern, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps
  FROM d, kinds WHERE regexp_matches(t, pattern)
),
parts AS (
  SELECT row, rank, kind, pattern, generate_subscripts(found, 1) AS i, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap FROM cut
),
placed AS (
  SELECT row, rank, kind, pattern, m, sum(length(gap) + length(m)) OVER (PARTITION BY row, rank ORDER BY i) AS stop FROM parts
),
spans AS MATERIALIZED (
  SELECT row, rank, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, pattern, 2)) >= 6
    WHEN 'access' THEN length(m) >= 20 WHEN 'hex' THEN length(m) >= 24
    WHEN 'opaque' THEN length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')
    ELSE TRUE END
),
scoped AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, count(*) FILTER (WHERE rank = 6) OVER (PARTITION BY row ORDER BY start, rank = 6 DESC ROWS UNBOUNDED PRECEDING) AS scope FROM spans
  ) s
  WHERE rank <> 6 AND (row, rank, start) NOT IN (
    SELECT (o.row, o.rank, o.start) FROM spans o JOIN spans c ON o.row = c.row WHERE o.rank = 4 AND c.rank NOT IN (4, 6) AND c.start < o.stop AND o.start < c.stop)
),
taken AS MATERIALIZED (SELECT row, p, row_number() OVER (PARTITION BY row ORDER BY p) AS n FROM (SELECT DISTINCT row, unnest(range(start, stop)) AS p FROM scoped)),
free AS MATERIALIZED (
  SELECT row, rank, start, stop, scope, start - min(n) + 1 AS free_start, stop - max(n) AS free_stop
  FROM (SELECT row, rank, start, stop, scope, unnest([start, stop - 1]) AS p FROM scoped) s JOIN taken USING (row, p)
  GROUP BY row, rank, start, stop, scope
),
tags(rank, g) AS (VALUES (0, 'secret'), (2, 'secret'), (1, 'access'), (3, 'login'), (4, 'opaque'), (5, 'endpoint')),
tagged AS (SELECT * FROM free JOIN tags USING (rank)),
wanted AS (SELECT free.*, k.g FROM free, (SELECT DISTINCT g FROM tags) k),
pairs AS (
  SELECT a.row, a.rank, a.start, a.stop, a.g FROM wanted a ASOF JOIN tagged b
    ON a.row = b.row AND a.scope = b.scope AND a.g = b.g AND a.start >= b.stop WHERE a.free_start - b.free_stop <= 300
  UNION ALL
  SELECT a.row, a.rank, a.start, a.stop, a.g FROM wanted a ASOF JOIN tagged b
    ON a.row = b.row AND a.scope = b.scope AND a.g = b.g AND a.stop <= b.start WHERE b.free_start - a.free_stop <= 300
),
near AS (
  SELECT row, rank, start, stop, bool_or(g = 'secret') AS secret, bool_or(g = 'access') AS access, bool_or(g = 'login') AS login,
    bool_or(g = 'opaque') AS opaque, bool_or(g = 'endpoint') AS endpoint
  FROM pairs GROUP BY row, rank, start, stop
),
judged AS (SELECT * FROM scoped LEFT JOIN near USING (row, rank, start, stop)),
kept AS (
  SELECT *, kind || ':' || start || ':' || stop AS said FROM judged
  WHERE rank <= 2 OR (rank = 3 AND (secret OR (opaque AND endpoint))) OR (rank = 4 AND (access OR (login AND endpoint)))
    OR (rank = 5 AND (access OR login) AND (secret OR opaque))
),
told AS (
  SELECT row, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
    count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE rank > 2) AS n_weak,
    string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank <= 2) AS base,
    string_agg(said, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
FROM d LEFT JOIN told USING (row)
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT row, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT row, string_split(t, chr(10)) AS parts FROM d)),
w AS (SELECT row, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
judged AS (
  SELECT row, i, line, ws, len(ws) AS n,
    list_sum(list_transform(ws, lambda x: length(x))) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
    len(ws) > 0 AND (
      (len(ws) < 12 AND NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$'))
      OR 5 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(ws)
      OR (len(ws) < 20 AND regexp_matches(line, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|click here|sign (up|in) |log ?in |subscribe|share this|read more|skip to content|powered by)'))
      OR 5 * len(list_filter(ws, lambda x: regexp_full_match(x, '[|»›>•·/~=_*–—-]+'))) >= len(ws)
      OR (len(ws) >= 5 AND (
        length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^a-z]', '', 'g'))
        OR 2 * (len(regexp_extract_all(line, '!!')) + len(regexp_extract_all(line, '\?\?'))) > len(ws)))
      OR (len(ws) >= 8 AND 2 * len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) > len(ws))
    ) AS fails
  FROM w
),
dup AS (SELECT row, count(*) AS n FROM (SELECT row, row_number() OVER (PARTITION BY row, line ORDER BY i) AS k FROM judged WHERE n > 0) WHERE k > 1 GROUP BY row),
words AS (SELECT row, row_number() OVER (PARTITION BY row ORDER BY i, k) AS pos, x FROM (SELECT row, i, generate_subscripts(ws, 1) AS k, unnest(ws) AS x FROM judged)),
windows AS (
  SELECT row, pos, string_agg(x, ' ') OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win,
    count(*) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n
  FROM words
),
repeated AS (SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY row, win) AS times FROM windows WHERE n = 8) WHERE times > 1),
covered AS (SELECT row, count(DISTINCT pos + k) AS n FROM repeated, range(0, 8) r(k) GROUP BY row),
total AS (
  SELECT row, sum(n)::BIGINT AS n_words, sum(coalesce(chars, 0))::BIGINT AS word_chars, sum(symbols)::BIGINT AS n_symbols,
    count(*)::BIGINT AS n_lines, sum(fails::INT)::BIGINT AS n_lines_removed, sum(CASE WHEN fails THEN chars ELSE 0 END)::BIGINT AS chars_removed
  FROM judged GROUP BY row
),
base AS (
  SELECT d.doc_id, total.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN total USING (row) LEFT JOIN dup USING (row) LEFT JOIN covered USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * chars_removed <= word_chars AS kept,
  n_lines, n_lines_removed, chars_removed
FROM base
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(l.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN lowest l ON l.a = e.vec_id
"""


def _moved(state: str, cost: str, edit: str, line: str = "''") -> str:
    return (
        f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {state}.o || {line}}} END"
    )


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _said(role: str, text: str = "''") -> str:
    return f"chr(10) || {role} || ':' || {text}"


# the states: n nothing kept, s, u, a; w marks them after insertions; each has cost c, audit a, lines o
OP11 = f"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations
),
bits(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
),
crc(conv_id, turn, said, k, v) AS (
  SELECT conv_id, turn, said, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT c.conv_id, c.turn, c.said, c.k + 1, xor(c.v >> 8, b.v) FROM crc c
  JOIN (SELECT i, v FROM bits WHERE k = 8) b ON b.i = xor(c.v, ascii(substr(c.said, c.k + 1, 1))) & 255
  WHERE c.k < length(c.said)
),
drawn AS (SELECT conv_id, turn, xor(v, 4294967295) % 20 AS draw FROM crc WHERE k = length(said)),
hurt AS (
  SELECT c.conv_id, c.turn, CASE WHEN draw = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN draw = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM conversations c JOIN drawn d ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.turn IS NOT DISTINCT FROM d.turn WHERE draw <> 0
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, left(role, 1) AS i,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt
),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY g ORDER BY k) || i AS pair
  FROM placed
),
dp(g, k, n, s, u, a) AS (
  SELECT DISTINCT g, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'o': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR),
    NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) FROM placed
  UNION ALL
  SELECT g, k,
    {_moved("n", "4", "D")},
    {_least(_moved("s", "4", "D"), "CASE WHEN stays AND i = 's' THEN " + _moved("n", "more", "K", _said("role", "text")) + " END")},
    {_least(_moved("u", "4", "D"), *[
        f"CASE WHEN stays{test} THEN " + _moved(state, cost, edit, line) + " END"
        for state in ("n", "s", "wa")
        for test, cost, edit, line in ((" AND i = 'u'", "more", "K", _said("role", "text")), ("", "more + 3", "R", _said("'user'", "text")))
    ])},
    {_least(_moved("a", "4", "D"), *[
        f"CASE WHEN stays{test} THEN " + _moved("wu", cost, edit, line) + " END"
        for test, cost, edit, line in ((" AND i = 'a'", "more", "K", _said("role", "text")), ("", "more + 3", "R", _said("'assistant'", "text")))
    ])}
  FROM (
    SELECT *, {_least("wu1", _moved("wa", "3", "I", _said("'user'")))} AS wu FROM (
      SELECT *, {_least("a", _moved("wu1", "3", "I", _said("'assistant'")))} AS wa FROM (
        SELECT d.g, j.k, n, s, u, a, i, role, text, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more,
          {_least("u", _moved("n", "3", "I", _said("'user'")), _moved("s", "3", "I", _said("'user'")))} AS wu1
        FROM dp d JOIN judged j ON d.g = j.g AND j.k = d.k + 1
      )
    )
  )
),
last AS (SELECT g, max(k) AS k FROM placed GROUP BY g),
ended AS (
  SELECT g, {_least("n", "a", _moved("u", "3", "I", _said("'assistant'")), _moved("s", "6", "II", _said("'user'") + " || " + _said("'assistant'")))} AS e
  FROM dp JOIN last USING (g, k)
),
counts AS (
  SELECT any_value(conv_id) AS conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(substr(e.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended USING (g)
"""


def _values(rows: Iterable[tuple]) -> str:
    def said(value: object) -> str:
        if isinstance(value, (list, tuple)):
            return f"[{', '.join(map(said, value))}]"
        return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

    return ", ".join(f"({', '.join(map(said, row))})" for row in rows)


# the licence texts are data that both sides read; how they are matched is written anew
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
w AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
base(label, phrase) AS (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])),
named AS (
  SELECT row, label, w.i FROM w, base
  WHERE word = phrase[1] AND (SELECT ws[w.i + 1:w.i + len(phrase)] FROM d WHERE d.row = w.row) = phrase
),
licence(id, label, said, phrases) AS (VALUES {_values((i, x.label, x.text.split(), x.phrases) for i, x in enumerate(LICENCES))}),
lw AS (SELECT id, unnest(said) AS word, generate_subscripts(said, 1) - 1 AS place FROM licence),
held AS (SELECT DISTINCT row, word FROM w WHERE word IN (SELECT word FROM lw)),
rarity AS (SELECT word, count(*) AS n FROM held GROUP BY word),
need AS (SELECT DISTINCT id, unnest(string_split(p, ' ')) AS word FROM (SELECT id, unnest(phrases) AS p FROM licence)),
may AS (
  SELECT row, id FROM held JOIN need USING (word) GROUP BY row, id
  HAVING count(*) = (SELECT count(*) FROM need m WHERE m.id = need.id)
),
rare AS (
  SELECT row, id, word FROM may JOIN (SELECT DISTINCT id, word FROM lw) USING (id) JOIN held USING (row, word) JOIN rarity USING (word)
  QUALIFY row_number() OVER (PARTITION BY row, id ORDER BY n, word) <= 12
),
begins AS (SELECT row, id, word, w.i - lw.place AS b FROM rare JOIN w USING (row, word) JOIN lw USING (id, word)),
bands AS (
  SELECT row, id, word, (floor(b / 16) * 16)::BIGINT AS low FROM begins
  UNION ALL SELECT row, id, word, (floor((b + 8) / 16) * 16 - 8)::BIGINT FROM begins
),
best AS (
  SELECT row, id, low, count(DISTINCT word) AS agree FROM bands GROUP BY row, id, low
  QUALIFY row_number() OVER (PARTITION BY row, id ORDER BY agree DESC, CASE WHEN low % 16 = 0 THEN low / 16 * 2 ELSE (low + 8) / 16 * 2 + 1 END) = 1
),
found AS (
  SELECT row, label, agree / least(12, len(list_distinct(said))) AS share, phrases,
    ' ' || array_to_string(ws[greatest(low, 0) + 1:low + 16 + len(said)], ' ') || ' ' AS stretch
  FROM best JOIN licence USING (id) JOIN d USING (row)
),
kept AS (
  SELECT row, label, share FROM found
  WHERE share >= 0.5 AND len(list_filter(phrases, lambda p: NOT contains(stretch, ' ' || p || ' '))) = 0
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n_base, 0) AS n_base, n.first_word, n.last_word,
  coalesce(n.labels, '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT row, label FROM named UNION ALL SELECT row, label FROM kept) x WHERE x.row = d.row), '') AS labels,
  CASE WHEN n.row IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM kept k WHERE k.row = d.row), 0)::DOUBLE END AS score
FROM d LEFT JOIN (
  SELECT row, count(*) AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM named GROUP BY row
) n USING (row)
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
drawn AS (
  SELECT doc_id, t, us, len(us)::BIGINT AS n,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k::INT, 8))::BIGINT) AS hs FROM d
),
cut AS (
  SELECT doc_id, t, n, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS c, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS e, us,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain'
      WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:c], '') AS p, array_to_string(us[c + 1:e], '') AS m, array_to_string(us[e + 1:], '') AS s FROM cut
),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN regexp_replace(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2')
    ELSE regexp_replace(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1') END) AS restored_sha256
FROM made
"""

ORACLE: dict[str, str] = {
    "op1_secret_scan": OP1,
    "op2_quality_rules": OP2,
    "op10_near_vectors": OP10,
    "op11_conversation_repair": OP11,
    "op12_licence_scan": OP12,
    "op13_fill_in_middle": OP13,
}
