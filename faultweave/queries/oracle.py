"""The queries of ``catalog.py`` in SQL, for DuckDB over the same tables."""

from __future__ import annotations

import re

from faultweave.queries import views as v
from faultweave.queries.catalog import AS_OF, CALC_DATE, SYNC_FROM, SYNC_TO


def _list(values) -> str:
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def _any(text: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words.split("|")) + ")"


# Stated here anew, so that a wrong word in the operators shows.
_NO_START = "not submitted|not trigger|hold state"
_STALLED = "predecessor|hold state|awsbhv026e"
_RULES = {
    "oom": "outofmemory|java heap|oom|executor lost|gc overhead|heap space|fetchfailedexception",
    "permission_error": "permission denied|rc=126|rc=127|exit code 126|exit code 127|abend rc=126",
    "python_version": "syntaxerror|invalid syntax|modulenotfounderror|importerror|syntax error|/usr/bin/python ",
    "cpu_high": "cpu",
    "long_running": "exceeded|long-running|breach|wallclock",
    "upstream_dependency": "predecessor|upstream|did not complete|awsbhv026e",
}
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" + _SPACES
_GAP = "[:\\t\\n\\x0B\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_NAMES = ((f"job{_GAP}([A-Z_]+)", 1), (f"Job{_GAP}([A-Z_]+)", 1), ("DBS_[A-Z_]+", 0))


def _label(text: str) -> str:
    waiting = f"CASE WHEN {_any(text, _STALLED)} THEN 'upstream_dependency' ELSE 'job_not_trigger' END"
    rules = " ".join(f"WHEN {_any(text, words)} THEN '{name}'" for name, words in _RULES.items())
    return f"CASE WHEN {_any(text, _NO_START)} THEN {waiting} {rules} ELSE 'unknown' END"


def _trim(text: str, blanks: str = _BLANKS) -> str:
    return f"trim({text}, '{blanks}')"


def _job_name(text: str, mode: str) -> str:
    hits = []
    for pattern, group in _NAMES:
        if mode == "name":
            hits.append(f"nullif(regexp_extract({text}, '{pattern}', {group}), '')")
        else:
            whole = f"regexp_extract({text}, '{pattern}', 0)"
            hits.append(f"nullif({_trim(f'string_split({whole}, chr(58))[-1]')}, '')")
    return f"coalesce({', '.join(hits)})"


def _digit(text: str, at: str) -> str:
    return f"(instr('0123456789abcdef', substr({text}, {at}, 1)) - 1)"


def _hash_vector(digest: str, n: int) -> str:
    byte = f"({_digit(digest, '2*i+1')} * 16 + {_digit(digest, '2*i+2')})"
    return f"list_transform(range(0, {n}), lambda i: CAST({byte} AS DOUBLE) / CAST(255 AS DOUBLE))"


def _place_sum(vector: str) -> str:
    return f"round(list_sum(list_transform({vector}, lambda x, i: x * i)), 6)"


def _l2(a: str, b: str, n: int) -> str:
    return f"power(array_distance(CAST({a} AS DOUBLE[{n}]), CAST({b} AS DOUBLE[{n}])), 2)"


_LOGS = _list(t[0] for t in v.TEMPLATES)
_DESCRIPTIONS = _list(t[1] for t in v.TEMPLATES)

VIEWS: dict[str, str] = {
    "job_names": "SELECT r_regionkey AS job_no, 'DBS_' || replace(r_name, ' ', '_') AS job FROM region",
    "inc": f"""
        SELECT event_id AS request_id, 'INC-' || event_id AS ticket_id,
          CASE WHEN event_id % 7 = 0 THEN '' ELSE job END AS job_name,
          CASE WHEN event_id % 4 = 0 THEN 'S' || (event_id // 4 % 20) || '.py' END AS script_name,
          CASE WHEN event_id % 3 = 0 THEN '' ELSE 'run --id ' || event_id END AS command,
          replace({_LOGS}[event_id % 12 + 1], '{{job}}', job) || ' ' || props AS tws_log,
          {_DESCRIPTIONS}[event_id % 12 + 1] AS description
        FROM events JOIN job_names ON user_id % 5 = job_no""",
    "asked": f"""
        SELECT request_id, ticket_id, script_name, tws_log, description,
          {_label("lower(tws_log || ' ' || description)")} AS failure_type,
          coalesce(nullif(job_name, ''), {_job_name("(tws_log || ' ' || description)", "compat")}, 'UNKNOWN')
            AS job_name,
          description || ' ' || tws_log AS question
        FROM inc""",
    "asked_vec": """
        SELECT request_id, job_name, script_name, embedding
        FROM inc JOIN embeddings ON vec_id = request_id % (SELECT count(*) FROM embeddings)""",
    "past_vec": """
        SELECT vec_id, 'H-' || vec_id AS id, job AS job_name, 'S' || (vec_id % 20) || '.py' AS script_name, embedding
        FROM embeddings JOIN job_names ON label % 5 = job_no""",
    "export": f"""
        SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'PI-' || doc_id END AS INCIDENT_ID, job AS JOB_NAME,
          'S' || (doc_id % 20) || '.py' AS SCRIPT_NAME, 'python3 /jobs/S' || (doc_id % 20) || '.py' AS COMMAND,
          CASE WHEN doc_id % 9 <> 0 THEN source END AS SUMMARY, text AS INCIDENT_DETAILS,
          ' rerun ' || lang || ' ' AS RESOLUTION, 'cause ' || n_chars AS ROOT_CAUSE,
          {_list(v.FAILURES)}[doc_id % 8 + 1] AS FAILURE_TYPE, 'user' || (doc_id % 9) AS RESOLVED_BY,
          CAST(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS VARCHAR) AS RESOLVED_DATE,
          CAST(doc_id % 30 AS INTEGER) AS MTTD, CAST(doc_id % 90 AS INTEGER) AS MTTR
        FROM documents JOIN job_names ON doc_id % 5 = job_no""",
    "store_docs": f"""
        SELECT INCIDENT_ID AS id, {_trim("coalesce(SUMMARY, '') || ' ' || INCIDENT_DETAILS || ' ' || RESOLUTION")} AS document,
          JOB_NAME AS job_name, SCRIPT_NAME AS script_name, RESOLVED_BY AS resolved_by,
          RESOLVED_DATE AS resolved_at, FAILURE_TYPE AS failure_type, RESOLUTION AS resolution, doc_id
        FROM export WHERE INCIDENT_ID <> ''""",
    "store": f"SELECT *, {_hash_vector('md5(document)', 8)} AS embedding FROM store_docs",
    "tix": """
        SELECT doc_id AS seq, CASE WHEN doc_id % 4 <> 0 THEN 'OPS-' || doc_id END AS key,
          CASE WHEN doc_id % 13 <> 0 THEN 'TK-' || doc_id END AS ticket_key,
          CASE WHEN doc_id % 3 = 0 THEN lower(job) || ' failed' ELSE '' END AS summary,
          text AS description, text AS root_cause, source, lang,
          CASE WHEN doc_id % 2 = 0 THEN 'fix ' || source END AS fix_details,
          CASE WHEN doc_id % 5 = 0 THEN 'batch ' || job ELSE lang END AS labels
        FROM documents JOIN job_names ON doc_id % 5 = job_no""",
    "scripts": """
        SELECT CASE WHEN doc_id < 20 THEN 'S' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.sh' ELSE '.py' END
            WHEN doc_id = 20 THEN 'DBS_ASIA.py' WHEN doc_id = 21 THEN 'DBS_EUROPE.sh'
            ELSE 'doc' || doc_id || '.py' END AS name,
          text AS content, CASE WHEN doc_id % 2 = 0 THEN '755' ELSE '644' END AS permissions
        FROM documents""",
    "nodes": """
        SELECT s_suppkey + 1 AS rank, s_name AS name, 'host' || s_suppkey AS host, s_suppkey + 5000 AS port,
          '/opt/jobs//' AS scripts_path FROM supplier""",
    "calls": """
        SELECT conv_id AS run_id, turn AS seq,
          ['list_files', 'get_repo_file_content', 'v2.get_repo_file_content'][turn % 3 + 1] AS name,
          coalesce(CASE WHEN turn % 2 = 1 THEN f END, CASE WHEN turn % 4 = 2 THEN 'alt/' || f END,
            CASE WHEN turn % 5 = 0 THEN 'old-' || turn END) AS path
        FROM (SELECT *, 'jobs/' || role || '/f' || (conv_id % 7) || '.py' AS f FROM conversations) c""",
    "run_events": """
        SELECT conv_id AS run_id, turn AS seq, 'tool' || turn AS name, text AS input,
          CASE WHEN turn % 5 = 4 THEN 'on_tool_end' WHEN role = 'user' THEN 'on_tool_start'
            ELSE 'on_chat_model_end' END AS kind,
          CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS content
        FROM conversations""",
    "trade_schedule": """
        SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS sched_date,
          CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'DONE' END AS status FROM orders""",
    "trades": """
        SELECT l_orderkey * 10 + l_linenumber AS trade_id, o_custkey AS account_id,
          CAST(o_orderdate AS DATE) AS trade_date, l_extendedprice AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "positions": """
        SELECT l_orderkey * 10 + l_linenumber AS position_id, l_partkey AS instrument_id,
          l_suppkey % 10 AS portfolio_id, l_returnflag AS currency_code,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS notional_value FROM lineitem""",
    "risk_factors": """
        SELECT p_partkey AS instrument_id, CAST(p_size * 2 AS DECIMAL(18,2)) AS risk_weight FROM part WHERE p_size < 40
        UNION ALL SELECT p_partkey, CAST(p_size * 2 + 1 AS DECIMAL(18,2)) FROM part WHERE p_size < 5""",
    "customers": """
        SELECT c_custkey AS customer_id, c_acctbal, c_nationkey, CAST(max(o_orderdate) AS DATE) AS last_score_date
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
          AND o_orderpriority = '1-URGENT'
        GROUP BY c_custkey, c_acctbal, c_nationkey""",
    "netting": """
        SELECT o_orderkey AS record_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS run_date,
          CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS date, o_orderpriority AS currency,
          CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount,
          CASE WHEN o_orderstatus <> 'F'
            THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.9 AS DECIMAL(3,1)) AS DECIMAL(18,3)) END AS net_amount
        FROM orders""",
    "statuses": """
        SELECT job, CASE event_type WHEN 'view' THEN ' incomplete ' WHEN 'signup' THEN 'job on Hold'
          WHEN 'error' THEN 'ABEND rc=1' WHEN 'click' THEN 'running' END AS status_text
        FROM (SELECT user_id AS job, event_type,
          row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) g
        WHERE rn = 1""",
    "states": """
        SELECT job, CASE WHEN status_text IS NULL THEN 'UNKNOWN'
          WHEN contains(upper(status_text), 'COMPLETE') THEN 'COMPLETE'
          WHEN contains(upper(status_text), 'HOLD') THEN 'HOLD'
          WHEN contains(upper(status_text), 'ABEND') THEN 'ABEND'
          WHEN contains(upper(status_text), 'RUNNING') THEN 'RUNNING' ELSE 'NOTFOUND' END AS status FROM statuses""",
    "waiting_jobs": "SELECT event_id AS job_id, user_id + event_id % 40 AS predecessor FROM events",
    "playbook": """
        SELECT ['job_not_trigger', 'cpu_high', 'long_running', 'upstream_dependency', 'oom', 'permission_error',
            'python_version', 'unknown'][n.n_nationkey + 1] AS failure_type, 'Runbook of ' || n.n_name AS root_cause,
          string_agg(m.n_name, '; ' ORDER BY m.n_name) AS actions
        FROM nation n JOIN nation m ON m.n_regionkey = n.n_regionkey WHERE n.n_nationkey < 8
        GROUP BY n.n_nationkey, n.n_name""",
    "job_parts": f"""
        SELECT 'P-' || p_partkey AS id, 'J' || (p_partkey % 6007) AS job_name,
          {_hash_vector('md5(p_name || p_partkey)', 8)} AS embedding FROM part""",
    "job_customers": f"""
        SELECT c_custkey AS request_id, 'J' || (c_custkey % 6007) AS job_name,
          {_hash_vector('md5(c_name)', 8)} AS embedding FROM customer""",
    # The whole investigation, step by step.
    "questions": f"""
        SELECT job, script, question, {_hash_vector('md5(question)', 8)} AS vec
        FROM (SELECT DISTINCT job_name AS job, coalesce(script_name, '') AS script, question FROM asked) q""",
    "hits": f"""
        SELECT * FROM (
          SELECT job, script, question, id, document, resolution, distance,
            row_number() OVER (PARTITION BY job, script, question ORDER BY round(distance, 9), id) AS rank
          FROM (
            SELECT q.*, s.id, s.document, s.resolution, {_l2("q.vec", "s.embedding", 8)} AS distance
            FROM questions q JOIN store s ON s.job_name = q.job
            UNION ALL
            SELECT q.*, s.id, s.document, s.resolution, {_l2("q.vec", "s.embedding", 8)} AS distance
            FROM questions q JOIN store s ON s.script_name = q.script AND s.job_name <> q.job) c) r
        WHERE rank <= 5""",
    "history": """
        SELECT job, script, question, count(*) AS past, string_agg(id, ',' ORDER BY rank) AS ids,
          string_agg(resolution, '|' ORDER BY rank) AS resolutions,
          string_agg('* ' || id || ' | ' || left(document, 120) || ' | ' || left(resolution, 160), chr(10) ORDER BY rank)
            FILTER (WHERE rank <= 3) AS lines
        FROM hits GROUP BY ALL""",
    "ticket_pairs": """
        SELECT name, seq, key, ticket_key, summary, fix_details, root_cause,
          row_number() OVER (PARTITION BY name ORDER BY seq) AS rank, count(*) OVER (PARTITION BY name) AS total
        FROM (SELECT DISTINCT lower(job_name) AS name FROM asked) n
        JOIN tix ON contains(lower(summary), name) OR contains(lower(description), name)
          OR contains(lower(labels), name)""",
    "ticket_lists": """
        SELECT name, max(total) AS total, count(*) AS tickets,
          string_agg(coalesce(key, ticket_key), ',' ORDER BY rank) AS keys,
          string_agg('* ' || coalesce(key, ticket_key, '?') || ' | ' || left(summary, 120) || ' | '
            || coalesce(fix_details, left(root_cause, 160)), chr(10) ORDER BY rank) AS lines
        FROM ticket_pairs WHERE rank <= 3 GROUP BY name""",
    "lookups": """
        SELECT r.job_name, r.script_name, r.request AS config_script,
          coalesce(a.content, b.content, 'No script named ' || r.request || ' on the node.') AS config_content,
          a.content AS node_content, a.permissions, a.name IS NOT NULL AS on_node
        FROM (
          SELECT *, CASE WHEN ends_with(request, '.py') OR ends_with(request, '.sh') THEN request
            ELSE request || '.py' END AS target
          FROM (SELECT DISTINCT job_name, script_name, coalesce(nullif(script_name, ''), job_name || '.py') AS request
            FROM asked) d) r
        LEFT JOIN scripts a ON a.name = r.target
        LEFT JOIN scripts b ON ends_with(r.request, '.py') AND b.name = replace(r.request, '.py', '.sh')""",
    "found": """
        SELECT a.*, coalesce(h.past, 0) AS past, coalesce(h.ids, '') AS ids, coalesce(h.resolutions, '') AS resolutions,
          h.lines AS past_lines, coalesce(t.tickets, 0) AS tickets, coalesce(t.total, 0) AS ticket_total,
          coalesce(t.keys, '') AS keys, t.lines AS ticket_lines, l.config_script, l.config_content, l.node_content,
          l.on_node
        FROM asked a
        LEFT JOIN history h ON h.job = a.job_name AND h.script = coalesce(a.script_name, '') AND h.question = a.question
        LEFT JOIN ticket_lists t ON t.name = lower(a.job_name)
        LEFT JOIN lookups l ON l.job_name = a.job_name AND l.script_name IS NOT DISTINCT FROM a.script_name""",
    "judged": """
        SELECT *, CASE
          WHEN failure_type IN ('job_not_trigger', 'upstream_dependency')
            THEN CASE WHEN past > 0 OR tickets > 0 THEN 'high' ELSE 'moderate' END
          WHEN failure_type IN ('cpu_high', 'oom', 'python_version')
            THEN CASE WHEN past > 0 THEN 'high' ELSE 'moderate' END
          WHEN failure_type = 'long_running' THEN CASE WHEN on_node THEN 'high' ELSE 'moderate' END
          WHEN failure_type = 'permission_error' THEN 'high' ELSE 'low' END AS confidence
        FROM found LEFT JOIN playbook USING (failure_type)""",
}


def _with(sql: str) -> str:
    """Put the views a query needs, and those they need, in front of it."""
    needed: set[str] = set()
    queue = [sql]
    while queue:
        body = queue.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
                needed.add(name)
                queue.append(VIEWS[name])
    # Views are listed so that each one comes after those it reads.
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in needed)
    return f"WITH {head}\n{sql}" if head else sql


_EXPORT = """
    SELECT INCIDENT_ID AS incident_id, JOB_NAME, SCRIPT_NAME, COMMAND, coalesce(SUMMARY, '-') AS summary,
      md5(INCIDENT_DETAILS) AS details, RESOLUTION, ROOT_CAUSE, FAILURE_TYPE, RESOLVED_BY, RESOLVED_DATE, MTTD, MTTR
    FROM export"""


def _flat_store(resolver: str) -> str:
    return f"""
    SELECT id, md5(document) AS document, round(list_sum(embedding), 6) AS embedding_sum,
      CAST(len(embedding) AS INTEGER) AS dim, id AS ticket_id, job_name, script_name, {resolver} AS resolved_by,
      resolved_at, failure_type, resolution FROM store"""


_INVESTIGATION = """
    SELECT request_id, ticket_id, job_name, failure_type, root_cause, actions, confidence, CAST(past AS INTEGER) AS historical_tickets,
      CAST(tickets AS INTEGER) AS jira_tickets, ticket_total, on_node AS edge_node_available, TRUE AS bitbucket_config,
      ids AS historical_ticket_ids, keys AS jira_ticket_keys, confidence = 'low' AS escalation_needed
    FROM judged"""

_STAGES = """
    SELECT request_id, 'historical_search' AS stage, 'completed' AS status, 'results_count' AS metric,
      CAST(past AS VARCHAR) AS value FROM found
    UNION ALL SELECT request_id, 'bitbucket_context', 'completed', 'config_found', 'true' FROM found
    UNION ALL SELECT request_id, 'edge_node_script', 'completed', 'script_retrieved', CAST(on_node AS VARCHAR) FROM found
    UNION ALL SELECT request_id, 'jira_intelligence', 'completed', 'tickets_found', CAST(tickets AS VARCHAR) FROM found
    UNION ALL SELECT request_id, 'log_analysis', CASE WHEN {done} THEN 'completed' ELSE 'skipped' END, 'status',
      CASE WHEN {done} THEN 'completed' ELSE 'unavailable' END FROM found
    UNION ALL SELECT request_id, 'resolution_synthesis', 'completed', '', '' FROM found"""

_GATE = """
    SELECT job_id, predecessor, coalesce(status, 'NOTFOUND') AS predecessor_status, {go} AS go,
      CASE WHEN {go} THEN 0 ELSE {code} END AS exit_code, coalesce(status, 'NOTFOUND') IN ('COMPLETE', 'UNKNOWN') AS logged
    FROM waiting_jobs LEFT JOIN states ON job = predecessor"""

_RECON = """
    SELECT trade_id, account_id, CAST(trade_date AS VARCHAR) AS recon_date, round(amount, 2) AS amount,
      'RECONCILED' AS recon_status
    FROM trades t WHERE EXISTS (SELECT 1 FROM trade_schedule s
      WHERE s.account_id = t.account_id AND s.sched_date = t.trade_date AND s.status = 'PENDING')"""

_PARTITION = """
    SELECT record_id, date, currency, round(CAST(gross_amount AS DOUBLE), 2) AS gross_amount
    FROM netting WHERE date = '{date}'"""

# A letter outside A-Z stands for any letter, digit or underscore that keeps a key from starting or ending.
_WORD_TEXT = "regexp_replace(body, '[\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]', 'x', 'g')"
_TAILS = _list(("", " AB-12", "xAB-12", " see OPS-7, OPS-7.", " A-1 ABCDEFGHIJK-2", "éZZ-3 ZZ-3"))

_TICKETS = """
    SELECT {seq} AS seq, coalesce(key, '-') AS key, coalesce(ticket_key, '-') AS ticket_key, summary, 'Resolved' AS status,
      'High' AS priority, md5(description) AS description, md5(root_cause) AS root_cause, '-' AS workaround,
      coalesce(fix_details, '-') AS fix_details, labels, '1|' || source || '|2024|' || lang AS comments FROM tix"""

_SYNC = f"""
    SELECT CASE WHEN count(*) > 0 THEN 'synced' ELSE 'no tickets found' END AS status, count(*) AS tickets_added,
      count(*) FILTER (WHERE failure_type <> 'oom') AS rows_added
    FROM store_docs WHERE resolved_at BETWEEN '{SYNC_FROM}' AND '{SYNC_TO}'"""

_BODIES: dict[str, str] = {
    "read_export_csv": _EXPORT,
    "read_export_csv_reordered": _EXPORT,
    "read_export_json": _EXPORT,
    "read_export_parquet": _EXPORT,
    "read_tickets": _TICKETS.format(seq="seq"),
    "read_tickets_array": _TICKETS.format(seq="row_number() OVER (ORDER BY lang, seq) - 1"),
    "read_logs": """
        SELECT strftime(ts, '%Y-%m-%d') AS log_name,
          row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS line_no,
          'INFO: ' || event_type || ' ' || event_id || ' ' || props AS line FROM events""",
    "read_scripts": """
        SELECT 'S' || item_id || CASE WHEN item_id % 3 = 0 THEN '.sh' ELSE '.py' END AS name,
          md5(text || chr(10)) AS content, strlen(text) + 1 AS size, TRUE AS dated,
          CASE WHEN item_id % 2 = 0 THEN '755' ELSE '644' END AS permissions FROM benchmark""",
    "read_partition": _PARTITION.format(date=CALC_DATE) + " AND currency = '2-HIGH'",
    "read_partition_day": _PARTITION.format(date=CALC_DATE),
    "append_new": _flat_store("CASE WHEN failure_type = 'oom' THEN 'first' ELSE 'second' END"),
    "not_yet_stored": "SELECT id, failure_type FROM store_docs WHERE failure_type = 'oom'",
    "recreate_store": "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM store_docs",
    "sync_range": _SYNC,
    "sync_range_times": _SYNC,
    "sync_report": """
        SELECT 'synced' AS status, count(*) AS tickets_added,
          count(*) FILTER (WHERE failure_type <> 'oom') AS rows_added FROM store_docs""",
    "write_result": f"""
        SELECT date, currency, CASE WHEN date = '{CALC_DATE}' THEN CAST(1 AS DOUBLE)
          ELSE round(CAST(sum(gross_amount) AS DOUBLE), 2) END AS gross, count(*) AS records
        FROM netting GROUP BY date, currency""",
    "upsert_scores": f"""
        SELECT customer_id, round(score, 6) AS score, CASE WHEN score >= 0 AND score < 0.30 THEN 'low'
          WHEN score >= 0.30 AND score < 0.65 THEN 'medium' ELSE 'high' END AS risk_band, calc_date
        FROM (
          SELECT customer_id, c_acctbal / CAST(10000 AS DOUBLE) AS score, '1996-01-02' AS calc_date FROM customers
          UNION ALL
          SELECT customer_id, CAST(0.5 AS DOUBLE) + c_nationkey / CAST(100 AS DOUBLE), '{CALC_DATE}' FROM customers
          WHERE last_score_date < DATE '{CALC_DATE}' OR last_score_date IS NULL
          UNION ALL
          SELECT customer_id, c_acctbal / CAST(10000 AS DOUBLE), '{CALC_DATE}' FROM customers
          WHERE c_nationkey < 12 AND last_score_date >= DATE '{CALC_DATE}') s""",
    "archive_partition": f"""
        SELECT '{CALC_DATE}' AS date, 'archived' AS status, count(*) AS rows, TRUE AS has_files,
          count(*) AS archived_rows, round(CAST(sum(gross_amount) AS DOUBLE), 2) AS archived_gross
        FROM netting WHERE date = '{CALC_DATE}'
        UNION ALL SELECT '1901-01-01', 'missing', 0, FALSE, 0, CAST(0 AS DOUBLE)""",
    "normalise_input": """
        SELECT request_id, ticket_id, job_name, coalesce(script_name, '-') AS script_name,
          coalesce(nullif(command, ''), '-') AS command FROM inc""",
    "resolve_headers": """
        SELECT INCIDENT_ID AS ticket_id, JOB_NAME AS job_name, '' AS script_name, '' AS command,
          coalesce(SUMMARY, '') AS summary, md5(INCIDENT_DETAILS) AS incident_details,
          coalesce(SUMMARY, '') AS description, '' AS resolution, 'unknown' AS failure_type,
          CAST(MTTD AS VARCHAR) AS resolved_by, RESOLVED_DATE AS resolved_at FROM export""",
    "drop_blank_ids": "SELECT id AS ticket_id, job_name, failure_type FROM store_docs",
    "document_text": f"""
        SELECT doc_id, md5(body) AS document, CAST(length(body) AS INTEGER) AS n FROM (
          SELECT doc_id, CASE WHEN body = '' THEN 'Job: J Description: ' || description ELSE body END AS body FROM (
            SELECT *, {_trim("coalesce(summary, description) || ' ' || details || ' ' || resolution")} AS body FROM (
              SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN ' ' || source END AS summary,
                CASE WHEN doc_id % 6 <> 0 THEN text ELSE '' END AS details,
                CASE WHEN doc_id % 4 = 1 THEN lang ELSE ' ' END AS resolution,
                CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(10) ELSE lang END AS description FROM documents) a) b) c""",
    "classify_failure": "SELECT request_id, failure_type FROM asked",
    "classify_failure_texts": f"""
        SELECT doc_id, {_label("body")} AS failure_type FROM (
          SELECT doc_id, lower(text || ['', ' GC Overhead', ' wallclock', ' Upstream', ' rc=127', ' Breach',
            ' HOLD STATE'][doc_id % 7 + 1] || ' ') AS body FROM documents) d""",
    "extract_job_name": f"""
        SELECT request_id, coalesce({_job_name("body", "compat")}, '-') AS compat,
          coalesce({_job_name("body", "name")}, '-') AS name,
          coalesce(nullif(job_name, ''), {_job_name("body", "compat")}, 'UNKNOWN') AS resolved
        FROM (SELECT *, tws_log || ' ' || description AS body FROM inc) i""",
    "matching_store_rows": """
        SELECT request_id, count(*) FILTER (WHERE coalesce(s.job_name = i.job_name AND i.job_name <> '', FALSE)
          OR coalesce(s.script_name = i.script_name, FALSE)
          OR (i.job_name = '' AND i.script_name IS NULL)) AS candidates
        FROM inc i CROSS JOIN past_vec s GROUP BY request_id""",
    "coerce_enum": """
        SELECT FAILURE_TYPE, CASE WHEN FAILURE_TYPE IN ('oom', 'cpu_high', 'long_running', 'python_version',
          'job_not_trigger') THEN FAILURE_TYPE ELSE 'unknown' END AS coerced, count(*) AS n FROM export GROUP BY ALL""",
    "script_target": """
        SELECT request_id, request, CASE WHEN request LIKE '%.py' OR request LIKE '%.sh' THEN request
          ELSE request || '.py' END AS target, job_name || '.log' AS log
        FROM (SELECT request_id, job_name, coalesce(CASE request_id % 3 WHEN 1 THEN regexp_replace(script_name, '\\.py$', '')
          WHEN 2 THEN regexp_replace(script_name, '\\.py$', '.sh') ELSE script_name END, job_name || '.py') AS request
          FROM inc) i""",
    "env_allow_list": """
        SELECT c_custkey AS node, 'PATH' AS name, c_name AS value FROM customer WHERE c_name <> ''
        UNION ALL SELECT c_custkey, 'JAVA_HOME', '/opt/java' FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT c_custkey, 'TWS_ENV', c_mktsegment FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment <> ''""",
    "ticket_keys": f"""
        SELECT doc_id, CAST(generate_subscripts(keys, 1) - 1 AS BIGINT) AS place, unnest(keys) AS key,
          md5('Ticket ' || unnest(keys)) AS summary
        FROM (SELECT doc_id, regexp_extract_all({_WORD_TEXT}, '\\b[A-Z]{{2,10}}-\\d+\\b') AS keys FROM (
          SELECT doc_id, text || {_TAILS}[doc_id % 6 + 1] AS body FROM documents) b) k WHERE len(keys) > 0
        UNION ALL
        SELECT doc_id, 0, '-', md5(body) FROM (SELECT doc_id, text || {_TAILS}[doc_id % 6 + 1] AS body FROM documents) b
        WHERE len(regexp_extract_all({_WORD_TEXT}, '\\b[A-Z]{{2,10}}-\\d+\\b')) = 0""",
    "job_status": "SELECT job, status FROM states",
    "risk_band": """
        SELECT c_custkey, CASE WHEN s >= 0 AND s < 0.30 THEN 'low' WHEN s >= 0.30 AND s < 0.65 THEN 'medium'
          ELSE 'high' END AS band FROM (SELECT c_custkey, c_acctbal / CAST(10000 AS DOUBLE) AS s FROM customer) c""",
    "due_for_scoring": f"""
        SELECT customer_id, coalesce(CAST(last_score_date AS VARCHAR), '-') AS last_score_date FROM customers
        WHERE last_score_date < DATE '{CALC_DATE}' OR last_score_date IS NULL""",
    "volume_period": """
        SELECT o_orderkey, day(o_orderdate) >= 28 AS month_end,
          day(o_orderdate) >= 28 AND month(o_orderdate) IN (3, 6, 9, 12) AS quarter_end,
          day(o_orderdate) >= 28 AS high_volume FROM orders""",
    "expired_files": f"""
        SELECT file_id, l_linenumber, age_days FROM (
          SELECT l_orderkey AS file_id, l_linenumber,
            CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(l_shipdate)) / 86400) AS BIGINT) AS age_days
          FROM lineitem) f WHERE l_linenumber % 2 = 0 AND age_days > 30""",
    "truncate_text": """
        SELECT doc_id, md5(left(text, 3000) || CASE WHEN length(text) > 3000 THEN '…' ELSE '' END) AS long,
          left(text, 120) AS short FROM documents""",
    "history_search": f"""
        SELECT request_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance,
          round(1 - distance, 6) AS similarity_score
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(distance, 9), id) AS rank FROM (
          SELECT a.request_id, p.id, {_l2("a.embedding", "p.embedding", 64)} AS distance
          FROM asked_vec a JOIN past_vec p ON p.job_name = a.job_name
          UNION ALL
          SELECT a.request_id, p.id, {_l2("a.embedding", "p.embedding", 64)} AS distance
          FROM asked_vec a JOIN past_vec p ON p.script_name = a.script_name AND p.job_name <> a.job_name
          UNION ALL
          SELECT a.request_id, p.id, {_l2("a.embedding", "p.embedding", 64)} AS distance
          FROM asked_vec a CROSS JOIN past_vec p WHERE a.job_name = '' AND a.script_name IS NULL) c) r
        WHERE rank <= 5""",
    "history_search_many_jobs": f"""
        SELECT request_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(distance, 9), id) AS rank FROM (
            SELECT c.request_id, p.id, {_l2("c.embedding", "p.embedding", 8)} AS distance
            FROM job_customers c JOIN job_parts p ON p.job_name = c.job_name) d) r
        WHERE rank <= 5""",
    "history_search_texts": """
        SELECT request_id, CAST(rank AS INTEGER) AS rank, id, round(1 - distance, 6) AS similarity_score
        FROM asked a JOIN hits h ON h.job = a.job_name AND h.script = coalesce(a.script_name, '')
          AND h.question = a.question""",
    "ticket_match": """
        SELECT request_id, name, CAST(rank AS INTEGER) AS rank, seq, coalesce(key, '-') AS key, total
        FROM asked JOIN ticket_pairs ON name = lower(job_name) WHERE rank <= 3""",
    "ticket_match_words": """
        SELECT name, CAST(rank AS INTEGER) AS rank, seq, total FROM (
          SELECT name, seq, row_number() OVER (PARTITION BY name ORDER BY seq) AS rank,
            count(*) OVER (PARTITION BY name) AS total
          FROM (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part
            UNION ALL SELECT unnest(string_split(text, ' ')) FROM benchmark UNION ALL SELECT n_name FROM nation) u
            WHERE w <> '') n
          JOIN tix ON contains(lower(summary), name) OR contains(lower(description), name)
            OR contains(lower(labels), name)) p WHERE rank <= 3""",
    "script_lookup": """
        SELECT job_name, coalesce(script_name, '-') AS script_name, config_script, md5(config_content) AS config_content,
          coalesce(md5(node_content), '-') AS node_content, coalesce(permissions, '-') AS permissions, on_node
        FROM lookups""",
    "node_for_job": """
        SELECT request_id, job_name, n.name AS node, n.port FROM inc JOIN nodes n ON n.rank = 1""",
    "assemble": """
        SELECT request_id, CAST(past AS INTEGER) AS past, CAST(tickets AS INTEGER) AS tickets, ticket_total, on_node,
          md5(config_content) AS config_content, md5(resolutions) AS resolutions FROM found""",
    "recommend_incidents": """
        SELECT request_id, f AS failure_type, confidence, root_cause, actions, confidence = 'low' AS escalation_needed, confidence = 'low' AS has_reason
        FROM (SELECT request_id, f, CASE
            WHEN f IN ('job_not_trigger', 'upstream_dependency')
              THEN CASE WHEN request_id % 3 > 0 OR request_id % 2 > 0 THEN 'high' ELSE 'moderate' END
            WHEN f IN ('cpu_high', 'oom', 'python_version')
              THEN CASE WHEN request_id % 3 > 0 THEN 'high' ELSE 'moderate' END
            WHEN f = 'long_running' THEN CASE WHEN request_id % 5 = 0 THEN 'high' ELSE 'moderate' END
            WHEN f = 'permission_error' THEN 'high' ELSE 'low' END AS confidence
          FROM (SELECT request_id, CASE WHEN request_id % 17 = 0 THEN 'unknown' ELSE failure_type END AS f FROM asked) a) b
        LEFT JOIN playbook ON playbook.failure_type = f""",
    "recommend_summary": """
        SELECT failure_type, CASE failure_type WHEN 'permission_error' THEN 'high' WHEN 'unknown' THEN 'low'
          ELSE 'moderate' END AS confidence, count(*) AS n FROM asked GROUP BY ALL""",
    "reconcile_trades": _RECON,
    "reconcile_trades_day": _RECON + " AND t.trade_date = DATE '1997-05-28'",
    "positions_with_factors": """
        SELECT position_id, p.instrument_id, portfolio_id, round(CAST(notional_value AS DOUBLE), 2) AS notional_value,
          coalesce(CAST(risk_weight AS VARCHAR), '-') AS risk_weight
        FROM positions p LEFT JOIN risk_factors f ON f.instrument_id = p.instrument_id""",
    "predecessor_gate": _GATE.format(go="coalesce(status, 'NOTFOUND') NOT IN ('HOLD', 'ABEND')", code=2),
    "predecessor_gate_strict": _GATE.format(go="coalesce(status, 'NOTFOUND') = 'COMPLETE'", code=1),
    "store_count": "SELECT count(*) AS count, count(DISTINCT id) AS ids FROM store_docs",
    "evidence_records": """
        SELECT request_id, CAST(past AS INTEGER) AS historical_tickets, CAST(tickets AS INTEGER) AS jira_tickets,
          on_node AS edge_node_available, TRUE AS bitbucket_config, ids AS historical_ticket_ids,
          keys AS jira_ticket_keys,
          CASE WHEN on_node THEN n.name || ' (' || n.host || ':' || n.port || ') → /opt/jobs/' || config_script
            ELSE '-' END AS edge_node_ref,
          'ops/batch-jobs/jobs/' || config_script || ' @ main' AS bitbucket_ref
        FROM found JOIN nodes n ON n.rank = 1""",
    "pending_accounts": """
        SELECT DISTINCT account_id, CAST(sched_date AS VARCHAR) AS sched_date FROM trade_schedule WHERE status = 'PENDING'""",
    "risk_totals": """
        SELECT portfolio_id, currency_code, round(CAST(sum(notional_value) AS DOUBLE), 2) AS total_notional,
          round(CAST(sum(risk_weight) AS DOUBLE), 2) AS total_risk, count(position_id) AS position_count
        FROM positions p LEFT JOIN risk_factors f ON f.instrument_id = p.instrument_id GROUP BY ALL""",
    "settlement_totals": """
        SELECT run_date AS date, currency, round(CAST(sum(coalesce(gross_amount, 0)) AS DOUBLE), 2) AS gross,
          round(CAST(sum(coalesce(net_amount, 0)) AS DOUBLE), 3) AS net, count(*) AS records
        FROM netting GROUP BY ALL""",
    "salted_totals": """
        SELECT currency_code, round(CAST(sum(notional_value) AS DOUBLE), 2) AS total, count(*) AS n
        FROM positions GROUP BY currency_code""",
    "key_skew": """
        SELECT instrument_id, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM positions), 9) AS share
        FROM positions GROUP BY instrument_id""",
    "heavy_keys": """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders), 9) AS share
        FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) >= 0.02 * (SELECT count(*) FROM orders)""",
    "largest_share": """
        SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows, round(CAST(max(n) AS DOUBLE) / sum(n), 9) AS max_share
        FROM (SELECT currency_code, count(*) AS n FROM positions GROUP BY currency_code) k""",
    "stage_outcomes": _STAGES.format(done="request_id % 3 = 0"),
    "stage_summary": f"""
        SELECT stage, status, count(*) AS n FROM ({_STAGES.format(done="FALSE")}) s GROUP BY stage, status""",
    "instrument_count": """
        SELECT portfolio_id, count(DISTINCT instrument_id) AS instruments, count(*) AS records
        FROM positions GROUP BY portfolio_id""",
    "top_k_nearest": f"""
        SELECT request_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(distance, 9), id) AS rank FROM (
            SELECT e.label AS request_id, 'H-' || e.vec_id AS id, {_l2("e.embedding", "c.center", 64)} AS distance
            FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS center FROM embeddings GROUP BY label) c
              ON c.label = e.label) d) r
        WHERE rank <= 5""",
    "first_n_in_order": """
        SELECT name, seq, total, CAST(rank AS INTEGER) AS rank FROM (
          SELECT source AS name, doc_id AS seq, count(*) OVER (PARTITION BY source) AS total,
            row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) d WHERE rank <= 3""",
    "log_tail": """
        SELECT log_name, md5(string_agg(line || chr(10), '' ORDER BY line_no)) AS content, max(total) AS total_lines,
          count(*) AS returned_lines
        FROM (SELECT conv_id AS log_name, turn AS line_no, text AS line, count(*) OVER (PARTITION BY conv_id) AS total,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c
        WHERE rn <= 3 GROUP BY log_name
        UNION ALL SELECT -1, md5(''), 0, 0""",
    "last_call_path": """
        SELECT run_id, coalesce(p, '-') AS resolved_path,
          coalesce(string_split(p, '/')[-1], 's' || run_id) AS script_name
        FROM (SELECT run_id, arg_max(path, seq) FILTER (WHERE path IS NOT NULL
          AND contains(name, 'get_repo_file_content')) AS p FROM calls GROUP BY run_id) c""",
    "last_model_text": """
        SELECT run_id, coalesce(arg_max(content, seq) FILTER (WHERE kind = 'on_chat_model_end' AND content <> ''), '')
          AS final_content FROM run_events GROUP BY run_id""",
    "tool_calls": "SELECT run_id, seq, name, input FROM run_events WHERE kind = 'on_tool_start'",
    "union_batches": """
        SELECT INCIDENT_ID AS ticket_id, JOB_NAME AS job_name, FAILURE_TYPE AS failure_type FROM export""",
    "match_union": """
        SELECT vec_id, job_name, script_name FROM past_vec p
        WHERE job_name IN (SELECT job_name FROM inc WHERE job_name = 'DBS_ASIA')
          OR script_name IN (SELECT script_name FROM inc WHERE script_name <> '' AND request_id % 40 = 0)""",
    "sha_embedding": f"""
        SELECT doc_id, CAST(len(e) AS INTEGER) AS dim, round(e[1], 6) AS first, round(e[100], 6) AS last,
          {_place_sum("e")} AS places
        FROM (SELECT doc_id, list_transform(range(0, 100), lambda j: s[j % 32 + 1]) AS e FROM (
          SELECT doc_id, {_hash_vector("sha256(text)", 32)} AS s FROM documents) d) x""",
    "md5_embedding": f"""
        SELECT doc_id, CAST(len(e) AS INTEGER) AS dim, {_place_sum("e")} AS places
        FROM (SELECT doc_id, {_hash_vector("md5(text)", 8)} AS e FROM documents) d""",
    "encoder_embedding": "SELECT doc_id, "
    + ", ".join(f"round(n_{c} / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS {c}" for c in "aeiou")
    + " FROM (SELECT *, sqrt("
    + " + ".join(f"n_{c} * n_{c}" for c in "aeiou")
    + ") AS norm FROM (SELECT doc_id, "
    + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS n_{c}" for c in "aeiou")
    + " FROM documents) c) d",
    "embedding_provider": f"""
        SELECT provider, id, CAST(len(e) AS INTEGER) AS dim, {_place_sum("e")} AS places FROM (
          SELECT 'md5' AS provider, id, {_hash_vector("md5(document)", 8)} AS e FROM store_docs
          UNION ALL SELECT 'sha', id, {_hash_vector("sha256(document)", 16)} FROM store_docs) s""",
    "l2_distance": f"""
        SELECT vec_id, round(d, 6) AS distance, round(1 - d, 6) AS similarity FROM (
          SELECT a.vec_id, {_l2("a.embedding", "b.embedding", 64)} AS d
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) p""",
    "same_dimension": "SELECT vec_id, CAST(64 AS INTEGER) AS dim FROM embeddings WHERE label <> 3",
    "diagnosis_context": """
        SELECT request_id, CAST(length(body) AS INTEGER) AS n, md5(body) AS context FROM (
          SELECT request_id, 'Job: ' || job_name || chr(10) || chr(10) || 'Failure type: ' || failure_type || chr(10)
            || chr(10) || 'Description: ' || description || chr(10) || chr(10) || 'Scheduler log:' || chr(10) || tws_log
            || chr(10) || chr(10) || 'Script ' || coalesce(script_name, '') || ':' || chr(10)
            || left(config_content, 3000) || CASE WHEN length(config_content) > 3000 THEN '…' ELSE '' END
            || chr(10) || chr(10) || 'Past incidents:' || chr(10) || coalesce(past_lines, 'None found')
            || chr(10) || chr(10) || 'Tickets:' || chr(10) || coalesce(ticket_lines, 'None found') AS body
          FROM found) f""",
    "repo_ref": """
        SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'ops/batch-jobs/' || coalesce(
            CASE WHEN p_partkey % 5 = 0 THEN 'x/' || p_name END,
            CASE WHEN p_partkey % 2 = 0 THEN 'jobs/' ELSE '' END || p_type) || ' @ main'
          ELSE coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'x/' || p_name END, p_type) END AS ref FROM part""",
    "node_ref": """
        SELECT rank, CASE WHEN rank % 7 = 0 THEN '-' ELSE name || CASE WHEN rank % 4 <> 0
          THEN ' (' || host || ':' || port || ')' ELSE '' END || ' → /opt/jobs/a.py' END AS ref FROM nodes""",
    "score_customers": f"""
        SELECT customer_id, round(s, 6) AS score, CASE WHEN s >= 0 AND s < 0.30 THEN 'low'
          WHEN s >= 0.30 AND s < 0.65 THEN 'medium' ELSE 'high' END AS risk_band, '{CALC_DATE}' AS calc_date
        FROM (SELECT customer_id, 1 / (1 + exp(-(0.5 * (c_acctbal - 4500) / CAST(3000 AS DOUBLE)
            - 0.25 * (c_nationkey - 12) / CAST(7 AS DOUBLE)
            + 0.125 * (coalesce(n, 0) - 10) / CAST(4 AS DOUBLE)))) AS s
          FROM customers LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
            ON o_custkey = customer_id) c""",
    "linear_score": f"""
        SELECT customer_id, round(s, 6) AS score, CASE WHEN s >= 0 AND s < 0.30 THEN 'low'
          WHEN s >= 0.30 AND s < 0.65 THEN 'medium' ELSE 'high' END AS risk_band, '{CALC_DATE}' AS calc_date
        FROM (SELECT customer_id, CAST(1000 AS DOUBLE) / 11000 + c_acctbal * (CAST(1 AS DOUBLE) / 11000) AS s
          FROM customers) c""",
    "investigate_incidents": _INVESTIGATION,
    "response_records": """
        SELECT j.request_id, i.job_name, confidence, CAST(past AS INTEGER) AS past, keys,
          coalesce(nullif(command, ''), '-') AS log_analysis,
          'historical_search:completed bitbucket_context:completed edge_node_script:completed '
            || 'jira_intelligence:completed log_analysis:' || CASE WHEN command <> '' THEN 'completed' ELSE 'skipped' END
            || ' resolution_synthesis:completed' AS stages
        FROM judged j JOIN inc i ON i.request_id = j.request_id""",
    "investigate_incident_stream": _INVESTIGATION,
    "store_feed_stream": _flat_store("CASE WHEN failure_type = 'oom' THEN 'held' ELSE resolved_by END"),
}

# the same results by another way
_BODIES["history_search_indexed"] = _BODIES["history_search"]
_BODIES["history_search_indexed_jobs"] = _BODIES["history_search_many_jobs"]
_BODIES["ticket_match_posted"] = _BODIES["ticket_match"]
_BODIES["ticket_match_many_words"] = _BODIES["ticket_match_words"]
_BODIES["investigate_indexed_stream"] = _INVESTIGATION
_BODIES["store_feed_by_state"] = _flat_store("resolved_by")
_BODIES["sync_since"] = f"""
    SELECT 0 AS run, CASE WHEN count(*) > 0 THEN 'synced' ELSE 'no tickets found' END AS status, count(*) AS tickets_added,
      count(*) AS rows_added FROM store_docs WHERE resolved_at <= '{SYNC_TO}'
    UNION ALL
    SELECT 1, CASE WHEN count(*) > 0 THEN 'synced' ELSE 'no tickets found' END, count(*), count(*)
      FROM store_docs WHERE resolved_at > (SELECT max(resolved_at) FROM store_docs WHERE resolved_at <= '{SYNC_TO}')
    UNION ALL SELECT 2, 'no tickets found', 0, 0"""
for _name in ("reconcile_trades", "positions_with_factors", "predecessor_gate"):
    _BODIES[f"{_name}_skewed"] = _BODIES[_name]

ORACLE: dict[str, str] = {name: _with(body) for name, body in _BODIES.items()}
