"""DuckDB SQL of the conversation, vector code and secret queries."""

from __future__ import annotations

from starling.llm import blob_ledger, vector_codes
from starling.llm.conversations import CUT_OFF, DELETE, INSERT, REROLE

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# ------------------------------------------------------------ op11
def _better(*paths: str) -> str:
    """The cheapest (cost, audit), ties by audit; null where there is none."""
    return "least(" + ", ".join(paths) + ")"


def _step(path: str, cost: str, letter: str, only: str = "true") -> str:
    return f"CASE WHEN {path} IS NOT NULL AND ({only}) THEN {{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}'}} END"


def conversation_repair() -> str:
    to_user = ", ".join([_step("w.u", f"{DELETE}", "D"), *(x for s in "nsb" for x in (
        _step(f"w.{s}", "t.extra", "K", "NOT t.gone AND t.initial = 'u'"), _step(f"w.{s}", f"{REROLE} + t.extra", "R", "NOT t.gone")))])
    to_reply = ", ".join([_step("w.b", f"{DELETE}", "D"), _step("w.u", "t.extra", "K", "NOT t.gone AND t.initial = 'a'"),
                          _step("w.u", f"{REROLE} + t.extra", "R", "NOT t.gone")])
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tbl
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT * EXCLUDE (key), xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda acc, b: xor(acc >> 8, tbl[(xor(acc, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, said, copy) AS nth
  FROM (SELECT *, md5(CAST(length(role) AS VARCHAR) || ':' || role || text) AS said, substr(role, 1, 1) AS initial, rtrim(text, {_SPACES}) AS body FROM damaged)
), turns AS (
  SELECT conv_id, turn, i, role, text, initial, body = '' AS blank, body <> '' AND nth > 1 AS duplicate,
         body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), costed AS (
  SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN {CUT_OFF} ELSE 0 END AS extra FROM turns
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': ''}} AS n, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS s,
         {{'c': {INSERT}, 'a': 'I'}} AS u, {{'c': {2 * INSERT}, 'a': 'II'}} AS b
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, n, s, u, {_better("b", _step("u", str(INSERT), "I"))} AS b
  FROM (SELECT conv_id, i, n, s, {_better("u", *(_step(x, str(INSERT), "I") for x in "nsb"))} AS u, b
        FROM (SELECT w.conv_id, t.i, {_step("w.n", str(DELETE), "D")} AS n,
                     {_better(_step("w.s", str(DELETE), "D"), _step("w.n", "t.extra", "K", "NOT t.gone AND t.initial = 's'"))} AS s,
                     least({to_user}) AS u, least({to_reply}) AS b
              FROM walk w JOIN costed t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1))
), ended AS (
  SELECT conv_id, arg_max({_better("n", "b")}, i) AS best FROM walk GROUP BY conv_id
), letters AS (
  SELECT conv_id, k, substr(best.a, CAST(k AS BIGINT), 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS k FROM ended)
), numbered AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS p
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), kept AS (
  SELECT l.conv_id, l.k, l.p, l.letter, t.role, t.text, t.initial FROM numbered l
  LEFT JOIN costed t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.i = t.i AND l.letter <> 'I' WHERE l.letter <> 'D'
), opened AS (
  SELECT conv_id, max(CASE WHEN p = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) AS shift FROM kept GROUP BY conv_id
), repaired AS (
  SELECT k.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS said
  FROM kept k JOIN opened o ON k.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY k.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM costed GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(e.best.c AS BIGINT) AS cost,
       e.best.a AS audit, sha256(coalesce(r.said, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON e.conv_id IS NOT DISTINCT FROM r.conv_id
"""


# ------------------------------------------------------------ op12
def vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    def assigned(book: str) -> str:
        """A part's squared distance to its nearest entry, times the number of entries, plus the entry."""
        return f"""SELECT p.rid, p.pos, min(CAST(p.xx - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * {entries} + b.entry) AS best
  FROM part p JOIN {book} b ON p.pos = b.pos GROUP BY p.rid, p.pos"""

    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED (
  {assigned(f'book{k}')}
), book{k + 1} AS MATERIALIZED (
  SELECT o.pos, o.entry, coalesce(m.x, o.x) AS x FROM book{k} o LEFT JOIN (
    SELECT pos, entry, list(floor(total / n) ORDER BY j) AS x FROM (
      SELECT a.pos, a.best % {entries} AS entry, j, sum(p.x[j]) AS total, count(*) AS n
      FROM a{k} a JOIN part p ON a.rid = p.rid AND a.pos = p.pos, unnest(range(1, len(p.x) + 1)) AS t(j) GROUP BY ALL) GROUP BY pos, entry) m
  ON o.pos = m.pos AND o.entry = m.entry
)""")
    hexed = " || ".join(f"max(CASE WHEN pos = {p} THEN lpad(lower(to_hex(best % {entries})), 2, '0') END)" for p in range(parts))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, label) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS MATERIALIZED (
  SELECT rid, pos, x, list_dot_product(x, x) AS xx FROM (
    SELECT rid, pos, q[pos * len(q) // {parts} + 1 : (pos + 1) * len(q) // {parts}] AS x FROM kept, unnest(range({parts})) AS t(pos))
), book0 AS MATERIALIZED (
  SELECT pos, entry, x FROM part JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, q) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (rid)
), {', '.join(steps)}, last AS MATERIALIZED (
  {assigned(f'book{rounds}')}
), coded AS (
  SELECT rid, {hexed} AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM last GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, j)) AS codebooks_sha256
  FROM (SELECT pos, entry, unnest(x) AS v, unnest(range(len(x))) AS j FROM book{rounds})
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN coded c ON k.rid = c.rid, digest d
"""


# ------------------------------------------------------------ op13
def secret_scan() -> str:
    rules = [rule for version in sorted(blob_ledger.RULES) for rule in blob_ledger.RULES[version]]
    finds = []
    for k, rule in enumerate(rules):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        finds.append(f"""SELECT rid, {k} AS kind, i, length(gaps[i]) + length(found[i]) AS step, length(found[i]) AS size, length(vals[i]) AS val
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT rid, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}, 0) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS vals
    FROM d WHERE regexp_matches(t, '{rule.hint.replace("'", "''")}')))""")
    least = " ".join(f"WHEN {k} THEN {rule.least}" for k, rule in enumerate(rules))
    names = " ".join(f"WHEN {k} THEN '{rule.kind}'" for k, rule in enumerate(rules))
    base = len(blob_ledger.BASE)
    said = f"string_agg((CASE kind {names} END) || ':' || CAST(e - size AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY e - size, kind)"
    counts = ", ".join(f"CAST(coalesce(s.n_{rule.kind}, 0) AS BIGINT) AS n_{rule.kind}" for rule in blob_ledger.BASE)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{rule.kind}" for k, rule in enumerate(blob_ledger.BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(finds)}),
spans AS (
  SELECT * FROM (SELECT rid, kind, size, val, sum(step) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM hits) WHERE val >= CASE kind {least} END
), s AS (
  SELECT rid, {sums}, {said} FILTER (WHERE kind < {base}) AS base, {said} AS spans, count(*) FILTER (WHERE kind >= {base}) AS n_added FROM spans GROUP BY rid
)
SELECT d.doc_id, {counts}, sha256(coalesce(s.base, '')) AS base_sha256, coalesce(s.spans, '') AS spans,
       CAST(coalesce(s.n_added, 0) AS BIGINT) AS n_added, sha256(d.t) AS blob
FROM d LEFT JOIN s ON d.rid = s.rid
"""


ORACLE_SQL = {"op11_conversation_repair": conversation_repair(), "op12_vector_codes": vector_codes_sql(), "op13_secret_scan": secret_scan()}
