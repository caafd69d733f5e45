"""Common table expressions that build the canonical tables in plain SQL.

They state the binding rules independently of the Spark code, so a query and its oracle
meet only in their results.
"""

from __future__ import annotations

from memlake.functions.text import FOLD_FROM, FOLD_TO

AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"
TOKEN_RE = r"[\p{L}\p{N}\p{Co}]+"

#: digest of a set whose members have the distinct SHA-256 ``h``: count and sums of eight 32-bit numbers
SET_DIGEST = "sha256(concat_ws(':', count(*), " + ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))" for i in range(8)) + "))"


def tokens_sql(col: str) -> str:
    folded = f"regexp_replace(translate(lower({col}), '{FOLD_FROM}', '{FOLD_TO}'), '[\\x{{0300}}-\\x{{0331}}]', '', 'g')"
    return f"regexp_extract_all({folded}, '{TOKEN_RE}')"


def pad(prefix: str, number: str, width: int) -> str:
    return f"'{prefix}' || lpad(CAST({number} AS VARCHAR), {width}, '0')"


_GOV = (
    "sensitivity, egress_policy, retention_mode, retention_expires_at, retention_policy_id, "
    "deletion_state, policy_basis"
)

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


cte("src0", [], f"""
SELECT d.doc_id, {pad('src-', 'd.doc_id', 8)} AS source_id, 'ns-' || d.lang AS namespace_id,
  'lin-' || d.lang || '-' || d.source || '-' || CAST(d.doc_id // 200 AS VARCHAR) AS lineage_id,
  CASE WHEN d.doc_id % 2 = 1 THEN 'markdown' ELSE 'text' END AS source_kind,
  CASE WHEN d.doc_id % 2 = 1 THEN 'text/markdown' ELSE 'text/plain' END AS media_type,
  d.text AS content, strlen(d.text) AS content_length, sha256(d.text) AS content_digest,
  'Document ' || CAST(d.doc_id AS VARCHAR) AS title, 'explicit_user_input' AS origin_kind,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS captured_at,
  CASE WHEN l.toxic = 1 THEN 'restricted' WHEN l.quality = 0 THEN 'sensitive' ELSE 'personal' END AS sensitivity,
  'local_only' AS egress_policy,
  CASE WHEN d.doc_id % 7 = 6 THEN 'until_time' ELSE 'until_deleted' END AS retention_mode,
  CASE WHEN d.doc_id % 7 = 6 THEN TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE + INTERVAL 10 DAY END AS retention_expires_at,
  CAST(NULL AS VARCHAR) AS retention_policy_id,
  CASE WHEN d.doc_id % 17 = 16 THEN 'deleted' WHEN d.doc_id % 13 = 12 THEN 'pending' ELSE 'active' END AS deletion_state,
  'user-consent' AS policy_basis
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")

cte("src", ["src0"], """
SELECT *, row_number() OVER (PARTITION BY namespace_id, lineage_id ORDER BY doc_id) AS version,
  lag(source_id) OVER (PARTITION BY namespace_id, lineage_id ORDER BY doc_id) AS prev_source_id,
  'origin-binding-' || lineage_id AS origin_ref
FROM src0""")

cte("tips", ["src"], """
SELECT namespace_id, lineage_id, source_id, version FROM src s
WHERE deletion_state = 'active' AND NOT EXISTS (
  SELECT 1 FROM src n WHERE n.namespace_id = s.namespace_id AND n.lineage_id = s.lineage_id AND n.version > s.version)""")

cte("pieces", ["src"], """
SELECT source_id, unnest(string_split(content, chr(10))) AS piece,
  generate_subscripts(string_split(content, chr(10)), 1) AS k,
  len(string_split(content, chr(10))) AS n FROM src""")

cte("frag", ["src", "pieces"], f"""
SELECT f.source_id || '-f' || lpad(CAST(k - 1 AS VARCHAR), 5, '0') AS fragment_id, s.namespace_id, f.source_id,
  k - 1 AS ordinal, byte_end - strlen(txt) AS byte_start, byte_end, txt AS content, sha256(txt) AS content_digest,
  {', '.join('s.' + c.strip() for c in _GOV.split(','))}, s.captured_at, s.lineage_id, s.version, s.title, s.content_length
FROM (SELECT *, CAST(sum(strlen(txt)) OVER (PARTITION BY source_id ORDER BY k) AS BIGINT) AS byte_end
      FROM (SELECT source_id, k, CASE WHEN k < n THEN piece || chr(10) ELSE piece END AS txt FROM pieces
            WHERE k < n OR piece <> '')) f
JOIN src s ON s.source_id = f.source_id""")

cte("mem0", ["src"], f"""
SELECT e.event_id, e.event_type, e.ts, e.user_id, e.value,
  e.event_type || ' ' || CAST(CAST(e.value AS DECIMAL(18,2)) AS VARCHAR) AS content,
  s.source_id || '-f00000' AS fragment_ref, s.namespace_id, {', '.join('s.' + c.strip() for c in _GOV.split(','))},
  (e.event_id % 101) / 100.0::DOUBLE AS confidence, (e.event_id % 11) / 10.0::DOUBLE AS importance,
  {pad('mem-', 'e.event_id', 10)} AS memory_id,
  'mlin-' || CAST(e.user_id AS VARCHAR) || '-' || e.event_type AS mem_lineage,
  {pad('prop-', 'e.event_id', 10)} AS proposal_id,
  e.event_type IN ('click', 'purchase', 'signup') AS recorded,
  CASE e.event_type WHEN 'click' THEN 'observation' WHEN 'purchase' THEN 'episode' WHEN 'signup' THEN 'preference' ELSE 'claim' END AS memory_type,
  CASE WHEN e.event_type = 'signup' THEN 2 ELSE 1 END AS step
FROM events e JOIN src s ON s.doc_id = e.user_id""")

cte("rec0", ["mem0"], f"""
SELECT *, row_number() OVER w AS version, lag(memory_id) OVER w AS prev_memory_id,
  lead(memory_id) OVER w AS next_memory_id, lead(ts) OVER w AS next_ts
FROM mem0 WHERE recorded WINDOW w AS (PARTITION BY mem_lineage ORDER BY ts, event_id)""")

cte("prop", ["mem0", "rec0"], f"""
SELECT m.proposal_id, m.namespace_id, CASE WHEN r.prev_memory_id IS NULL THEN 'create' ELSE 'supersede' END AS operation,
  m.memory_type, CAST(m.user_id AS VARCHAR) AS subject_ref, m.content, sha256(m.content) AS content_digest,
  m.fragment_ref, r.prev_memory_id AS target_memory_id, m.ts AS proposed_at, m.confidence, m.importance,
  {', '.join('m.' + c.strip() for c in _GOV.split(','))}, m.event_type, m.event_id
FROM mem0 m LEFT JOIN rec0 r ON r.event_id = m.event_id""")

cte("dec", ["mem0"], f"""
SELECT {pad('dec-', 'event_id', 10)} || '-1' AS decision_id, namespace_id, proposal_id,
  CAST(NULL AS VARCHAR) AS previous_decision_id,
  CASE WHEN event_type = 'error' THEN 'reject' WHEN event_type IN ('signup', 'view') THEN 'defer' ELSE 'accept' END AS decision,
  CASE WHEN event_type IN ('click', 'purchase') THEN memory_id END AS result_memory_id, ts + INTERVAL 1 MINUTE AS decided_at, event_id
FROM mem0
UNION ALL
SELECT {pad('dec-', 'event_id', 10)} || '-2', namespace_id, proposal_id, {pad('dec-', 'event_id', 10)} || '-1',
  'accept', memory_id, ts + INTERVAL 2 MINUTE, event_id
FROM mem0 WHERE event_type = 'signup'""")

cte("rec", ["rec0"], f"""
SELECT memory_id, mem_lineage AS lineage_id, version, namespace_id, memory_type, CAST(user_id AS VARCHAR) AS subject_ref,
  content, sha256(content) AS content_digest, fragment_ref, proposal_id AS origin_proposal_id,
  {pad('dec-', 'event_id', 10)} || '-' || CAST(step AS VARCHAR) AS accepted_by_decision_id,
  ts AS observed_at, 'open_ended' AS valid_mode, ts AS valid_start, CAST(NULL AS TIMESTAMP) AS valid_end,
  confidence, importance, {_GOV},
  CASE WHEN next_memory_id IS NULL THEN 'confirmed' ELSE 'superseded' END AS current_state,
  {pad('evt-', 'event_id', 10)} || CASE WHEN next_memory_id IS NULL THEN '-1' ELSE '-2' END AS last_state_event_id,
  prev_memory_id, next_memory_id, next_ts,
  CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN prev_memory_id END AS contradicts_memory_id,
  ts + step * INTERVAL 1 MINUTE AS created_at, event_type, event_id, value, user_id, step, ts
FROM rec0""")

cte("evt", ["rec"], f"""
SELECT {pad('evt-', 'event_id', 10)} || '-1' AS event_id, namespace_id, memory_id, CAST(NULL AS VARCHAR) AS previous_event_id,
  'confirmed' AS event_type, CAST(NULL AS VARCHAR) AS from_state, 'memory_decision' AS cause_type,
  accepted_by_decision_id AS cause_id, CAST(NULL AS VARCHAR) AS related_memory_id,
  CAST(NULL AS TIMESTAMP) AS effective_at, ts + step * INTERVAL 1 MINUTE AS occurred_at, event_id AS n
FROM rec
UNION ALL
SELECT {pad('evt-', 'event_id', 10)} || '-2', namespace_id, memory_id, {pad('evt-', 'event_id', 10)} || '-1',
  'superseded', 'confirmed', 'memory_record', next_memory_id, next_memory_id,
  next_ts, next_ts + step * INTERVAL 1 MINUTE, event_id
FROM rec WHERE next_memory_id IS NOT NULL""")

cte("rows_", ["frag", "tips", "rec"], f"""
SELECT 'source_fragment' AS object_kind, f.fragment_id AS object_id, f.namespace_id, f.sensitivity, f.content,
  f.captured_at AS available_at, f.retention_mode, f.retention_expires_at, CAST(NULL AS TIMESTAMP) AS valid_start,
  {tokens_sql('f.content')} AS toks
FROM frag f JOIN tips t ON t.source_id = f.source_id WHERE f.deletion_state = 'active'
UNION ALL
SELECT 'memory_record', memory_id, namespace_id, sensitivity, content, created_at, retention_mode, retention_expires_at,
  valid_start, {tokens_sql('content')}
FROM rec WHERE deletion_state = 'active' AND current_state = 'confirmed'""")

ELIGIBLE = f"""sensitivity = 'personal' AND available_at <= {AS_OF}
  AND NOT (retention_mode = 'until_time' AND (retention_expires_at IS NULL OR retention_expires_at <= {AS_OF}))
  AND (object_kind = 'source_fragment' OR valid_start <= {AS_OF})"""

cte("qs", ["src", "tips", "frag"], """
SELECT query_id, namespace_id, query FROM (
  SELECT conv_id, turn, text, role, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS number,
    ['ns-de', 'ns-en', 'ns-es', 'ns-fr'][CAST(conv_id % 4 AS INTEGER) + 1] AS namespace_id FROM conversations) c,
  LATERAL (SELECT 'turn-' || number AS query_id, text AS query
    UNION ALL SELECT 'conv-' || number, array_to_string(string_split(text, ' ')[1:2], ' ') WHERE role = 'user') q
UNION ALL
SELECT 'body-' || s.source_id, s.namespace_id, s.content FROM src s JOIN tips t ON t.source_id = s.source_id WHERE s.content <> ''
UNION ALL
SELECT 'doc-' || s.source_id, s.namespace_id, array_to_string(regexp_split_to_array(s.content, '\\s+')[1:3], ' ')
FROM src s JOIN tips t ON t.source_id = s.source_id WHERE s.content <> ''
UNION ALL
SELECT 'line-' || f.fragment_id, f.namespace_id, f.content FROM frag f JOIN tips t ON t.source_id = f.source_id"""
)

cte("phr", ["qs"], f"""
SELECT query_id, namespace_id, row_number() OVER () AS phrase_no, toks, array_to_string(toks, ' ') AS phrase FROM (
  SELECT query_id, namespace_id, {tokens_sql('term')} AS toks
  FROM (SELECT query_id, namespace_id, unnest(regexp_split_to_array(query, '\\s+')) AS term FROM qs) x) y
WHERE len(toks) > 0""")

cte("occ", ["rows_"], """
SELECT object_kind, object_id, len(toks) AS dl, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM rows_""")

cte("post", ["occ", "phr"], """
SELECT object_kind, object_id, dl, phrase, count(*) AS tf FROM (
  SELECT o.object_kind, o.object_id, o.dl, p.phrase, o.pos - p.off AS start_, p.n, count(*) AS m
  FROM occ o JOIN (SELECT phrase, any_value(n) AS n, term, off FROM (
      SELECT phrase, len(toks) AS n, unnest(toks) AS term, generate_subscripts(toks, 1) AS off
      FROM (SELECT DISTINCT phrase, toks FROM phr) u) v GROUP BY phrase, term, off) p ON p.term = o.term
  GROUP BY ALL HAVING count(*) = p.n) w
GROUP BY ALL""")

cte("asked", ["post", "phr"], """
SELECT p.query_id, p.namespace_id, count(*) AS n_phr, arg_min(p.phrase, coalesce(d.df, 0)) AS rarest
FROM phr p LEFT JOIN (SELECT phrase, count(*) AS df FROM post GROUP BY phrase) d ON d.phrase = p.phrase
GROUP BY p.query_id, p.namespace_id""")

cte("hits", ["post", "phr", "rows_", "asked"], f"""
SELECT query_id, object_kind, object_id, score, rank FROM (
  SELECT query_id, object_kind, object_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_kind, object_id) AS rank
  FROM (
    SELECT p.query_id, t.object_kind, t.object_id, a.n_phr, count(*) AS m,
      round(sum(CASE WHEN ln((c.n - d.df + 0.5) / (d.df + 0.5)) <= 0 THEN 0.000001 ELSE ln((c.n - d.df + 0.5) / (d.df + 0.5)) END
        * (t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / c.avg_dl)))), 6) AS score
    FROM asked a
    JOIN post f ON f.phrase = a.rarest
    JOIN (SELECT object_kind, object_id, namespace_id FROM rows_ WHERE {ELIGIBLE}) r
      ON r.object_kind = f.object_kind AND r.object_id = f.object_id AND r.namespace_id = a.namespace_id
    JOIN phr p ON p.query_id = a.query_id
    JOIN post t ON t.phrase = p.phrase AND t.object_kind = f.object_kind AND t.object_id = f.object_id
    JOIN (SELECT phrase, count(*) AS df FROM post GROUP BY phrase) d ON d.phrase = p.phrase
    CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avg_dl FROM rows_) c
    GROUP BY p.query_id, t.object_kind, t.object_id, a.n_phr
  ) s WHERE m = n_phr
) WHERE rank <= 10""")


def with_ctes(names: list[str], select: str, **extra: str) -> str:
    """A full statement: the named expressions with all they need, then the select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    parts += [f"{n} AS ({body.strip()})" for n, body in extra.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + select.strip()
