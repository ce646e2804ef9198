"""DuckDB SQL for the queries, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from ..functions import fixed
from . import derived as D

SALT = "fixture-salt"
AS_OF = 1_706_745_600


def _q(text: str) -> str:
    return text.replace("'", "''")


def _list(values) -> str:
    return ", ".join(f"'{_q(v)}'" if isinstance(v, str) else str(v) for v in values)


def _duck(query: str) -> str:
    """The derived tables' SQL in DuckDB's spelling."""
    for spark, duck in (
        ("{events}", "events"),
        ("user_id div 65536", "user_id // 65536"),
        ("(user_id div 256)", "(user_id // 256)"),
        ("date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", "strftime(ts, '%d/%b/%Y:%H:%M:%S')"),
        ("date_format(ts, 'MMM dd HH:mm:ss')", "strftime(ts, '%b %d %H:%M:%S')"),
        ("{{", "{"), ("}}", "}"),
        ("'```json\\n", "'```json' || chr(10) || '"), ("\\n```'", "' || chr(10) || '```'"),
    ):
        query = query.replace(spark, duck)
    return query


LINES = f"lines AS ({_duck(D.ACCESS)})"
AUTH = f"auth AS ({_duck(D.AUTH)})"
REPLY = f"replies AS ({_duck(D.REPLIES)})"
DEEP = f"deep AS ({_duck(D.DEEP_REPLIES)})"

# DuckDB numbers at most nine groups, so the two that are not read do not capture
_A = _q(fixed.ACCESS_LINE.replace(r" - (\S+) ", r" - \S+ ").replace(r'(\S+)" (\d', r'\S+" (\d'))
_S = _q(fixed.SYSLOG_LINE)
_V4 = fixed.IPV4_IN_TEXT


def _access(source: str, name: str) -> str:
    field = lambda n: f"regexp_extract(raw_line, '{_A}', {n})"
    return f"""{name} AS (
SELECT seq, source_label, raw_line, {field(1)} AS source_ip, {field(3)} AS method,
  {field(4)} AS path, CAST({field(5)} AS INTEGER) AS status,
  CAST({field(6)} AS BIGINT) AS response_size, {field(7)} AS referer, {field(8)} AS user_agent,
  CAST(epoch(try_strptime({field(2)}, '%d/%b/%Y:%H:%M:%S %z')) AS BIGINT) AS ts_epoch
FROM {source} WHERE regexp_matches(raw_line, '{_A}')
  AND try_strptime({field(2)}, '%d/%b/%Y:%H:%M:%S %z') IS NOT NULL)"""


_PARTS = " OR ".join(
    f"contains(lower(path), '{p}')" for p in fixed.SUSPICIOUS_PATH_PARTS)
_BOTS = " OR ".join(f"contains(user_agent, '{b}')" for b in fixed.KNOWN_BOTS)

# file extension: last dot of the last path segment, not counting leading dots
FLAGGED = f"""named AS (
SELECT *, ltrim(list_extract(string_split(split_part(path, '?', 1), '/'), -1), '.') AS file
FROM parsed),
entries AS (
SELECT *, noise_reason IS NOT NULL AS is_noise,
  CASE WHEN regexp_extract(raw_line, '{_V4}') <> '' THEN regexp_extract(raw_line, '{_V4}')
       WHEN source_ip <> '' THEN source_ip ELSE 'unknown' END AS actor,
  strftime(to_timestamp(ts_epoch) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day
FROM (SELECT *, CASE
  WHEN status IN ({_list(fixed.SUSPICIOUS_STATUSES)}) AND ({_PARTS}) THEN NULL
  WHEN contains(file, '.') AND lower('.' || list_extract(string_split(file, '.'), -1))
       IN ({_list(fixed.STATIC_EXTENSIONS)}) THEN 'static_asset'
  WHEN path IN ({_list(fixed.HEALTH_PATHS)}) THEN 'health_check'
  WHEN {_BOTS} THEN 'known_bot' END AS noise_reason FROM named)),
signal AS (SELECT * FROM entries WHERE NOT is_noise)"""

BASE = f"{LINES},\n{_access('lines', 'parsed')},\n{FLAGGED}"

_SQLI = " OR ".join(f"regexp_matches(path, '(?i){_q(p)}')" for p in fixed.SQLI_PATTERNS)
_TRAV = " OR ".join(f"regexp_matches(path, '(?i){_q(p)}')" for p in fixed.TRAVERSAL_PATTERNS)
_SCAN = " OR ".join(f"contains(lower(user_agent), '{s}')" for s in fixed.SCANNER_AGENTS)
_BRUTE = (
    f"status IN ({_list(fixed.BRUTE_STATUSES)}) AND rtrim(path, '/') IN "
    f"({_list(fixed.BRUTE_PATHS)}) AND upper(method) IN ({_list(fixed.BRUTE_METHODS)})"
)
_FUZZ = f"status IN ({_list(fixed.FUZZ_STATUSES)})"

# the rules one after the other, each on what the ones before left
LABELS = f"""r1 AS (SELECT *, CASE WHEN {_SQLI} THEN 'sqli' END AS l1 FROM signal),
r2 AS (SELECT *, coalesce(l1, CASE WHEN {_TRAV} THEN 'traversal' END) AS l2 FROM r1),
bf AS (SELECT source_label, actor FROM r2 WHERE l2 IS NULL AND {_BRUTE}
       GROUP BY ALL HAVING count(*) >= 5),
r3 AS (SELECT r2.*, coalesce(l2, CASE WHEN {_BRUTE} AND bf.actor IS NOT NULL
         THEN 'bruteforce' END) AS l3
       FROM r2 LEFT JOIN bf ON r2.actor = bf.actor AND r2.source_label = bf.source_label),
r4 AS (SELECT *, coalesce(l3, CASE WHEN {_SCAN} THEN 'scanner' END) AS l4 FROM r3),
fz AS (SELECT source_label, actor FROM r4 WHERE l4 IS NULL AND {_FUZZ}
       GROUP BY ALL HAVING count(DISTINCT path) >= 5),
labelled AS (SELECT r4.*, coalesce(l4, CASE WHEN {_FUZZ} AND fz.actor IS NOT NULL
         THEN 'path_fuzz' END) AS label
       FROM r4 LEFT JOIN fz ON r4.actor = fz.actor AND r4.source_label = fz.source_label)"""

FINDINGS = f"""{LABELS},
grouped AS (SELECT label AS rule, source_label,
    CASE WHEN label IN ('bruteforce', 'path_fuzz') THEN actor END AS who,
    count(*) AS n_rows, count(DISTINCT path) AS n_paths, count(DISTINCT actor) AS n_ips,
    min(seq) AS first_seq, arg_min(actor, seq) AS ip, arg_min(path, seq) AS path,
    arg_min(user_agent, seq) AS agent
  FROM labelled WHERE label IS NOT NULL GROUP BY ALL),
findings AS (SELECT rule, source_label, who AS actor,
  CASE rule WHEN 'bruteforce' THEN 'bruteforce' WHEN 'scanner' THEN 'scan'
            WHEN 'path_fuzz' THEN 'scan' ELSE 'exploit_attempt' END AS category,
  CASE rule WHEN 'sqli' THEN 'critical' WHEN 'path_fuzz' THEN 'medium' ELSE 'high' END AS severity,
  CAST(0.95 AS DOUBLE) AS confidence,
  CASE rule WHEN 'sqli' THEN 'SQL injection attempt detected: ' || left(path, 80)
    WHEN 'traversal' THEN 'Directory traversal attempt: ' || left(path, 80)
    WHEN 'bruteforce' THEN 'Brute force: ' || n_rows || ' failed logins from ' || ip || ' to ' || path
    WHEN 'scanner' THEN 'Known scanner detected from ' || ip || ': ' || agent
    ELSE 'Path fuzzing: ' || n_paths || ' distinct 404/403 paths from ' || ip END AS summary,
  CASE rule WHEN 'sqli' THEN 'sqli_pattern_in_' || left(path, 50)
    WHEN 'traversal' THEN 'traversal_in_' || left(path, 50)
    WHEN 'bruteforce' THEN n_rows || 'x_401_from_' || ip
    WHEN 'scanner' THEN 'scanner_ua=' || agent
    ELSE n_paths || 'x_unique_paths_from_' || ip END AS indicator,
  CASE WHEN rule IN ('scanner', 'path_fuzz') THEN 'rate_limit' ELSE 'block_ip' END
    AS recommended_action,
  ip, n_ips, path, CASE WHEN rule = 'path_fuzz' THEN n_paths ELSE n_rows END AS n, n_rows,
  first_seq, 'local_rules' AS analyzed_by FROM grouped)"""

_ID = "sha256(rule || chr(1) || source_label || chr(1) || coalesce(actor, ''))"

ALERTS = f"""{FINDINGS},
alerts AS (SELECT *, {_ID} AS alert_id, {AS_OF} - first_seq % 600 AS created
  FROM findings),
targets AS (SELECT DISTINCT {_ID} AS alert_id, source_label, ip, min(seq) AS ord
  FROM (SELECT label AS rule, source_label, seq, actor AS ip,
          CASE WHEN label IN ('bruteforce', 'path_fuzz') THEN actor END AS actor
        FROM labelled WHERE label IS NOT NULL)
  GROUP BY rule, source_label, actor, ip),
blocked AS (SELECT t.* FROM targets t JOIN alerts a USING (alert_id)
  WHERE a.recommended_action = 'block_ip'),
limited AS (SELECT * FROM alerts WHERE recommended_action = 'rate_limit'),
rules AS (
  SELECT alert_id, ord * 2 AS rule_ord, 'nginx_deny' AS rule_type, 'deny ' || ip || ';' AS command,
    'Deny IP ' || ip || ' in Nginx (detected on ' || source_label || ')' AS description,
    true AS critical, '# remove: deny ' || ip || ';' AS rollback_command FROM blocked
  UNION ALL
  SELECT alert_id, ord * 2 + 1, 'ufw', 'sudo ufw deny from ' || ip,
    'Block IP ' || ip || ' via UFW firewall (detected on ' || source_label || ')', true,
    'sudo ufw delete deny from ' || ip FROM blocked
  UNION ALL
  SELECT alert_id, CAST(0 AS BIGINT), 'rate_limit',
    'limit_req_zone $binary_remote_addr zone=threat_limit:10m rate=10r/m;',
    'Rate limit zone ''threat_limit'' at 10r/m (detected on ' || source_label || ')', false,
    '# remove: limit_req_zone ... zone=threat_limit:10m ...' FROM limited
  UNION ALL
  SELECT alert_id, CAST(1 AS BIGINT), 'rate_limit', 'limit_req zone=threat_limit;',
    'Apply rate limit zone ''threat_limit'' to ' || path || ' (detected on ' || source_label || ')',
    false, '# remove: limit_req zone=threat_limit; from ' || path FROM limited),
rule_counts AS (SELECT alert_id, count(*) AS n_rules,
  bool_or(rule_type IN ('ufw', 'nginx_deny')) AS drastic FROM rules GROUP BY 1),
gated AS (SELECT a.*, n_rules, severity IN ('high', 'critical') OR drastic AS critical,
    severity IN ('low', 'medium') AND NOT (severity IN ('high', 'critical') OR drastic)
      AS auto_action
  FROM alerts a JOIN rule_counts USING (alert_id)),
gate AS (SELECT *, CASE WHEN auto_action THEN 'approved' ELSE 'pending' END AS status,
    CASE WHEN auto_action THEN created END AS resolved FROM gated),
decisions AS (SELECT CASE WHEN first_seq % 4 = 3 THEN 'x' || alert_id ELSE alert_id END AS alert_id,
    CASE WHEN first_seq % 4 = 1 THEN 'reject' ELSE 'approve' END AS decision,
    created + CASE WHEN first_seq % 8 = 4 THEN 900 ELSE 60 END AS decided
  FROM gate WHERE first_seq % 4 <> 2),
decided AS (SELECT g.* EXCLUDE (status, resolved),
    CASE WHEN status <> 'pending' THEN status
         WHEN d.decided - created <= 300 THEN
           CASE WHEN decision = 'approve' THEN 'approved' ELSE 'rejected' END
         WHEN {AS_OF + 3600} - created > 300 THEN 'expired' ELSE 'pending' END AS status,
    CASE WHEN status <> 'pending' THEN resolved
         WHEN d.decided - created <= 300 THEN d.decided
         WHEN {AS_OF + 3600} - created > 300 THEN {AS_OF + 3600} END AS resolved
  FROM gate g LEFT JOIN decisions d USING (alert_id)),
ledger AS (
  SELECT d.alert_id, 'execute' AS kind, true AS record_success, true AS dry_run,
    rule_ord AS step, rule_type, command, true AS success, '[DRY RUN] ' || command AS output,
    rollback_command
  FROM decided d JOIN rules USING (alert_id) WHERE status = 'approved'
  UNION ALL
  SELECT alert_id, 'execute', false, true, NULL, NULL, NULL, NULL, NULL, NULL
  FROM decided WHERE status <> 'approved')"""


def _pass(column: str, prefix: str, matches: str, number: int) -> str:
    """One masking pass in SQL: longest match first, literal replacement."""
    token = f"'{prefix}' || left(sha256('{SALT}' || m), 32) || ']'"
    return f"""p{number} AS (SELECT * EXCLUDE (t, ms),
    list_reduce(list_concat([t], list_transform(list_sort(list_transform(list_distinct(ms),
      lambda m: {{'n': -length(m), 'm': m}})), lambda s: s.m)),
      lambda t, m: replace(t, m, {token})) AS t, ms AS {column}
  FROM (SELECT *, {matches} AS ms FROM p{number - 1}))"""


_WIDE = "replace(t, '/', '//')"
_MATCHES = {
    "ipv4": f"regexp_extract_all(t, '{fixed.IPV4}')",
    "ipv6": f"regexp_extract_all(t, '{fixed.IPV6}')",
    "email": f"regexp_extract_all(t, '{fixed.EMAIL}')",
    "url_sensitive": f"regexp_extract_all(t, '{fixed.URL_SENSITIVE}')",
    # no look-ahead here: with every slash doubled, the one that ends a match is spare
    "path_ids": f"regexp_extract_all({_WIDE}, '(/[0-9]{{3,}})(?:/|$|\\s)', 1)",
}
MASK = ",\n".join(
    ["p0 AS (SELECT *, raw_line AS t FROM entries)"]
    + [_pass(f"m_{name}", prefix, _MATCHES[name], k + 1)
       for k, (name, _, prefix) in enumerate(fixed.PII_PATTERNS)]
    + ["masked AS (SELECT * EXCLUDE (t), t AS sanitized_line FROM p5)"]
)
MASKED = f"{BASE},\n{MASK}"

OCCURRENCES = ",\n".join(
    f"o_{name} AS (SELECT seq, ts_epoch, '{prefix}' AS prefix, "
    f"'{prefix}' || left(sha256('{SALT}' || v), 32) || ']' AS hashed, v AS original, "
    f"list_position(m_{name}, v) AS pos "
    f"FROM (SELECT seq, ts_epoch, m_{name}, unnest(list_distinct(m_{name})) AS v FROM masked))"
    for name, _, prefix in fixed.PII_PATTERNS
) + ",\nocc AS (" + " UNION ALL ".join(
    f"SELECT * FROM o_{name}" for name, _, _ in fixed.PII_PATTERNS) + ")"

DICTIONARY = f"""{MASKED},
{OCCURRENCES},
firsts AS (SELECT prefix, hashed, arg_min(original, (seq, pos)) AS original, min(seq) AS first_seq,
    min((seq, pos)) AS place FROM occ GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY place) AS k FROM firsts),
dict AS (SELECT prefix, hashed, original, first_seq,
    prefix || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || ']'
      AS token FROM numbered)"""

# batches of five in arrival order within a day
BATCHED = """batched AS (SELECT *, (rn - 1) // 5 AS batch_no,
    CAST(flush AS VARCHAR) || '-' || CAST((rn - 1) // 5 AS VARCHAR) AS batch_id
  FROM (SELECT *, row_number() OVER (PARTITION BY flush ORDER BY seq) AS rn
        FROM (SELECT *, ts_epoch - ts_epoch % 86400 AS flush FROM {source})))"""

TEXTS = """labels AS (SELECT batch_id, source_label, count(*) AS n, min(seq) AS s
  FROM batched WHERE NOT is_noise GROUP BY 1, 2),
texts AS (SELECT batch_id, count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq,
    string_agg({line}, chr(10) ORDER BY seq) AS batch_text,
    (SELECT arg_max(source_label, (n, -s)) FROM labels l WHERE l.batch_id = b.batch_id)
      AS source_label
  FROM batched b WHERE NOT is_noise GROUP BY 1)"""

HEAD = _q(
    "Classify the web server activity below. Answer with one JSON object: category (normal, "
    "suspicious, malicious, scan, bruteforce, exploit_attempt), indicators, severity (low, "
    "medium, high, critical), confidence (0.0 to 1.0), summary, recommended_action (block_ip, "
    "block_path, rate_limit, alert_only, investigate), action_details with ip, ips, path and "
    "paths. Copy addresses, tokens such as [IP_001] and paths exactly as the lines show them."
)

FAST = f"""{REPLY},
objects AS (SELECT batch_id, try_cast(reply AS JSON) IS NOT NULL AS ok,
    CASE WHEN json_type(try_cast(reply AS JSON)) = 'ARRAY'
         THEN json_extract(try_cast(reply AS JSON), '$[0]') ELSE try_cast(reply AS JSON) END AS j
  FROM replies),
fast AS (SELECT batch_id, NOT ok AS parse_error, json_extract_string(j, '$.category') AS raw_category,
    try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) AS raw_confidence,
    CASE WHEN json_extract_string(j, '$.category') IN ({_list(fixed.CATEGORIES)})
         THEN json_extract_string(j, '$.category') ELSE 'normal' END AS category,
    CASE WHEN json_extract_string(j, '$.severity') IN ({_list(fixed.SEVERITIES)})
         THEN json_extract_string(j, '$.severity') ELSE 'low' END AS severity,
    coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.0) AS confidence,
    CASE WHEN ok THEN '' ELSE 'parse error' END AS summary, 'alert_only' AS recommended_action,
    'l2_fast' AS analyzed_by FROM objects),
judged AS (SELECT *, NOT parse_error AND (coalesce(raw_confidence, 1.0) < 0.6
    OR (coalesce(raw_category IN ('suspicious', 'scan'), false)
        AND coalesce(raw_confidence, 1.0) < 0.8)) AS escalate FROM fast)"""

DEEP_MERGED = f"""{FAST},
{DEEP},
joined AS (SELECT f.*, try_cast(trim(replace(replace(d.deep_reply, '```json', ''), '```', ''),
      ' ' || chr(10)) AS JSON) AS dj
  FROM judged f LEFT JOIN deep d ON d.batch_id = f.batch_id AND f.escalate),
merged AS (SELECT batch_id, escalate, category, parse_error,
    CASE WHEN dj IS NULL THEN severity ELSE json_extract_string(dj, '$.severity') END AS severity,
    round(CASE WHEN dj IS NULL THEN confidence ELSE
      coalesce(try_cast(json_extract_string(dj, '$.confidence') AS DOUBLE), confidence) END, 6)
      AS confidence,
    CASE WHEN dj IS NULL THEN summary ELSE coalesce(json_extract_string(dj, '$.summary'),
      json_extract_string(dj, '$.threat_type'), summary) END AS summary,
    CASE WHEN json_extract_string(dj, '$.recommended_action') = 'block_ip' THEN 'block_ip'
      ELSE 'alert_only' END AS recommended_action,
    CASE WHEN json_extract(dj, '$.action_details') IS NOT NULL THEN 'dict' ELSE 'none' END
      AS details_kind,
    json_extract_string(dj, '$.action_details.ip') AS ip,
    CASE WHEN json_extract(dj, '$.action_details') IS NOT NULL THEN
      array_to_string(CAST(json_extract(dj, '$.action_details.ips') AS VARCHAR[]), ' ') END AS ips,
    CAST(NULL AS VARCHAR) AS path,
    CASE WHEN dj IS NULL THEN 'l2_fast' ELSE 'l2_deep' END AS analyzed_by FROM joined)"""

ORACLES: dict[str, str] = {}


def oracle(name: str, base: str, select: str) -> None:
    ORACLES[name] = f"WITH {base}\n{select}" if base else select


# --- sources and parsing ---------------------------------------------------------

oracle("source_registry", f"""{LINES}, {AUTH},
n AS (SELECT source_label, count(*) AS c FROM (SELECT source_label FROM lines
  UNION ALL SELECT source_label FROM auth) GROUP BY 1),
s(name, format, tags) AS (VALUES ('site-0', 'nginx', 'web,eu'), ('site-1', 'apache', 'web'),
  ('site-2', 'iis', ''), ('auth-main', 'syslog', ''))""",
"SELECT name, format, tags, coalesce(c, 0) AS n_lines FROM s LEFT JOIN n ON source_label = name")

oracle("log_lines", f"{LINES}, {AUTH}",
       "SELECT source_label, raw_line FROM lines UNION ALL SELECT source_label, raw_line FROM auth")

oracle("parse_access_logs", f"{LINES}, {_access('lines', 'parsed')}",
       "SELECT seq, ts_epoch, source_ip, method, path, status, response_size, user_agent, referer, "
       "source_label FROM parsed")

_MSG = f"regexp_extract(raw_line, '{_S}', 5)"
_ACTION = "CASE " + " ".join(
    f"WHEN contains(lower({_MSG}), '{phrase}') THEN '{action}'"
    for phrase, action in fixed.SYSLOG_ACTIONS
) + f" WHEN {_MSG} = '' THEN 'UNKNOWN' ELSE upper(split_part({_MSG}, ' ', 1)) END"
_CLOCK = f"'2024 ' || regexp_extract(raw_line, '{_S}', 1)"
SYSLOG = f"""{AUTH}, sysl AS (SELECT seq, source_label,
  CAST(epoch(try_strptime({_CLOCK}, '%Y %b %d %H:%M:%S')) AS BIGINT) AS ts_epoch,
  regexp_extract({_MSG}, '{_V4}') AS source_ip, {_ACTION} AS method,
  regexp_extract(raw_line, '{_S}', 3) AS path, CAST(0 AS INTEGER) AS status
  FROM auth WHERE regexp_matches(raw_line, '{_S}'))"""
oracle("parse_syslog", SYSLOG, "SELECT seq, ts_epoch, source_ip, method, path, status FROM sysl")

ROUTED = f"""{LINES}, {SYSLOG}, {_access('lines', 'parsed')}"""
oracle("format_routing", ROUTED, """
SELECT l.seq, l.source_label, CASE l.source_label WHEN 'site-0' THEN 'nginx'
    WHEN 'site-1' THEN 'apache' ELSE 'iis' END AS format,
  CASE l.source_label WHEN 'site-0' THEN 'web,eu' WHEN 'site-1' THEN 'web' ELSE '' END AS tags,
  CASE WHEN l.source_label = 'site-2' THEN 'unknown_format' WHEN p.seq IS NULL THEN 'no_match' END
    AS reason,
  CASE WHEN l.source_label <> 'site-2' THEN p.method END AS method,
  CASE WHEN l.source_label <> 'site-2' THEN p.path END AS path,
  CASE WHEN l.source_label <> 'site-2' THEN p.status END AS status
FROM lines l LEFT JOIN parsed p USING (seq)
UNION ALL SELECT seq, source_label, 'syslog', '', NULL, method, path, status FROM sysl""")

oracle("format_coverage", LINES, f"""
SELECT source_label, count(*) AS lines,
  CAST(sum(CAST(regexp_matches(raw_line, '{_A}') AS INT)) AS BIGINT) AS matched,
  round(avg(CAST(regexp_matches(raw_line, '{_A}') AS INT)), 6) AS coverage
FROM lines GROUP BY 1""")

oracle("malformed_lines", f"{LINES}, {AUTH}", f"""
SELECT seq, source_label, raw_line, 'no_match' AS reason
FROM (SELECT * FROM lines UNION ALL SELECT * FROM auth) WHERE NOT regexp_matches(raw_line, '{_A}')""")

# --- noise -----------------------------------------------------------------------

oracle("noise_classification", BASE, "SELECT seq, path, is_noise, noise_reason FROM entries")
oracle("noise_summary", BASE, """
SELECT source_label, count(*) AS n_rows, count(*) FILTER (is_noise) AS n_noise,
  count(*) FILTER (noise_reason = 'static_asset') AS n_static_asset,
  count(*) FILTER (noise_reason = 'health_check') AS n_health_check,
  count(*) FILTER (noise_reason = 'known_bot') AS n_known_bot,
  round(avg(CAST(is_noise AS INT)), 6) AS noise_rate FROM entries GROUP BY 1""")
oracle("health_semi_join", BASE,
       f"SELECT seq, path, actor FROM entries WHERE path IN ({_list(fixed.HEALTH_PATHS)})")

# --- masking ---------------------------------------------------------------------

oracle("pii_scan", "texts AS (SELECT text AS t FROM documents UNION ALL SELECT url FROM pages)",
       "SELECT pattern, value, count(*) AS n_texts FROM (" + " UNION ALL ".join(
           f"SELECT '{name}' AS pattern, unnest(list_distinct({_MATCHES[name]})) AS value FROM texts"
           for name, _, _ in fixed.PII_PATTERNS) + ") GROUP BY 1, 2")
oracle("anonymize_hashed", MASKED, "SELECT seq, sanitized_line, CAST(" + " + ".join(
    f"len(list_distinct(m_{name}))" for name, _, _ in fixed.PII_PATTERNS)
    + " AS INTEGER) AS n_tokens FROM masked")
oracle("token_dictionary", DICTIONARY,
       "SELECT prefix, token, hashed, original, first_seq FROM dict")
oracle("anonymize_numbered", f"""{DICTIONARY},
present AS (SELECT seq, unnest(list_distinct(regexp_extract_all(sanitized_line,
    '{fixed.ANY_TOKEN}'))) AS hashed FROM masked),
names AS (SELECT seq, list(hashed || '|' || token) AS pairs
  FROM present JOIN dict USING (hashed) GROUP BY 1)""", """
SELECT seq, CASE WHEN pairs IS NULL THEN sanitized_line ELSE
  list_reduce(list_concat([sanitized_line], pairs),
    lambda t, p: replace(t, split_part(p, '|', 1), split_part(p, '|', 2))) END AS sanitized_line
FROM masked LEFT JOIN names USING (seq)""")
oracle("deanonymize_roundtrip", MASKED,
       "SELECT seq, raw_line AS restored, sanitized_line <> raw_line AS was_masked FROM masked")
oracle("actor_key", BASE, "SELECT seq, actor FROM entries")
IP_TOKENS = f"""{MASKED}, {OCCURRENCES},
ip_occ AS (SELECT * FROM occ WHERE prefix = '[IP_'),
ip_dict AS (SELECT hashed AS token, original, min(ts_epoch) AS created FROM ip_occ GROUP BY 1, 2)"""
oracle("resolve_tokens", IP_TOKENS, """
SELECT o.seq, token, CASE WHEN o.ts_epoch - created <= 864000 THEN d.original END AS original
FROM ip_occ o JOIN ip_dict d ON token = hashed""")
oracle("token_purge", IP_TOKENS, f"""
SELECT token, created, {AS_OF} - created > 2592000 AS expired FROM ip_dict""")
oracle("token_epochs_ttl", f"""RECURSIVE {BASE},
seen AS (SELECT actor AS value, ts_epoch AS epoch, count(*) AS n FROM entries GROUP BY 1, 2),
starts AS (SELECT value, min(epoch) AS s, 1 AS k FROM seen GROUP BY 1
  UNION ALL SELECT p.value, min(o.epoch), p.k + 1 FROM starts p JOIN seen o
    ON o.value = p.value AND o.epoch > p.s + 3600 GROUP BY p.value, p.s, p.k)""", """
SELECT value, CAST(k AS BIGINT) AS epoch_no, s AS epoch_start, CAST((SELECT sum(n) FROM seen o
  WHERE o.value = starts.value AND o.epoch BETWEEN s AND s + 3600) AS BIGINT) AS n_seen
FROM starts""")

# --- statistics --------------------------------------------------------------------

_HMS = "strftime(to_timestamp({}) AT TIME ZONE 'UTC', '%H:%M:%S')"
oracle("batch_overview", BASE, f"""
SELECT day, count(*) AS total_entries, count(*) FILTER (NOT is_noise) AS signal_entries,
  coalesce({_HMS.format('min(ts_epoch) FILTER (NOT is_noise)')}, '') AS time_start,
  coalesce({_HMS.format('max(ts_epoch) FILTER (NOT is_noise)')}, '') AS time_end
FROM entries GROUP BY 1""")
oracle("ip_stats", BASE, """
SELECT day, actor, count(*) AS request_count, count(DISTINCT path) AS n_paths,
  count(DISTINCT method) AS n_methods, count(DISTINCT nullif(user_agent, '')) AS n_user_agents,
  min(seq) AS first_seq FROM signal GROUP BY 1, 2""")
oracle("ip_status_hist", f"""{BASE},
h AS (SELECT day, actor, status, count(*) AS n, min(seq) AS s FROM signal GROUP BY 1, 2, 3)""", """
SELECT day, actor, string_agg(status || ':' || n, ', ' ORDER BY n DESC, s) AS statuses,
  count(*) AS n_statuses FROM h GROUP BY 1, 2""")
oracle("ip_path_topk", f"""{BASE},
h AS (SELECT day, actor, path, count(*) AS n, min(seq) AS first_seq FROM signal GROUP BY 1, 2, 3)""",
"""SELECT *, CAST(row_number() OVER (PARTITION BY day, actor ORDER BY n DESC, first_seq) AS INTEGER)
  AS place FROM h QUALIFY place <= 5""")
oracle("ip_top_method", f"""{BASE},
h AS (SELECT day, actor, method, count(*) AS n, min(seq) AS s FROM signal GROUP BY 1, 2, 3)""",
       "SELECT day, actor, arg_max(method, (n, -s)) AS method FROM h GROUP BY 1, 2")
oracle("ip_user_agents", f"""{BASE},
h AS (SELECT DISTINCT day, actor, user_agent FROM signal WHERE user_agent <> '')""", """
SELECT day, actor, count(*) AS n_user_agents,
  array_to_string(list_sort(list(user_agent))[1:3], ', ') AS sample FROM h GROUP BY 1, 2""")
_PATHS = """SELECT day, path, count(*) AS request_count, count(DISTINCT actor) AS n_ips,
  min(seq) AS first_seq FROM signal WHERE path <> '' GROUP BY 1, 2"""
oracle("path_stats", BASE, _PATHS)
oracle("path_status_hist", BASE, """SELECT day, path, status, count(*) AS n, min(seq) AS first_seq
FROM signal WHERE path <> '' GROUP BY 1, 2, 3""")
oracle("frequent_paths", BASE, _PATHS + " HAVING count(*) >= 3 OR count(DISTINCT actor) >= 2")

oracle("path_stats_sketched", BASE, """SELECT path, count(*) AS request_count, min(seq) AS first_seq,
  count(DISTINCT actor) AS n_ips, true AS within FROM signal WHERE path <> '' GROUP BY 1""")

# --- rules -------------------------------------------------------------------------

for _name, _predicate in (("l1_sqli", _SQLI), ("l1_traversal", _TRAV), ("l1_scanner", _SCAN)):
    oracle(_name, BASE, f"SELECT seq, source_label, actor, path FROM signal WHERE {_predicate}")
oracle("l1_bruteforce", f"{BASE}, {FINDINGS}",
       "SELECT source_label, actor, n, first_seq, path, summary FROM findings "
       "WHERE rule = 'bruteforce'")
oracle("l1_path_fuzz", f"{BASE}, {FINDINGS}",
       "SELECT source_label, actor, n, n_rows, first_seq, summary FROM findings "
       "WHERE rule = 'path_fuzz'")
oracle("l1_assessments", f"{BASE}, {FINDINGS}", "SELECT * FROM findings")
oracle("l1_finding_actors", f"{BASE}, {LABELS}", """
SELECT label AS rule, source_label, CASE WHEN label IN ('bruteforce', 'path_fuzz') THEN actor END
  AS actor, actor AS ip, min(seq) AS ip_seq FROM labelled WHERE label IS NOT NULL
GROUP BY label, source_label, labelled.actor""")
oracle("l1_remaining", f"{BASE}, {LABELS}", "SELECT seq, actor FROM labelled WHERE label IS NULL")
oracle("assessment_entries", f"{BASE}, {LABELS}", """
SELECT label AS rule, source_label, CASE WHEN label IN ('bruteforce', 'path_fuzz') THEN actor END
  AS actor, seq FROM labelled WHERE label IS NOT NULL""")

# one rule after the other takes its rows from what the earlier ones left
_CUSTOM, _LEFT = [], "signal"
for _k, (_name, _kind, _predicate, _least) in enumerate(D.CUSTOM_RULES):
    _n = "count(DISTINCT path)" if _kind == "paths" else "count(*)"
    _CUSTOM.append(f"""take{_k} AS MATERIALIZED (SELECT * FROM {_LEFT} JOIN (
  SELECT source_label, actor, {_n} AS n FROM {_LEFT} WHERE {_predicate} GROUP BY 1, 2 HAVING {_n} >= {_least})
  USING (source_label, actor) WHERE {_predicate}),
left{_k} AS MATERIALIZED (SELECT * FROM {_LEFT} WHERE seq NOT IN (SELECT seq FROM take{_k}))""")
    _LEFT = f"left{_k}"
CUSTOM = ",\n".join([BASE, *_CUSTOM])
oracle("custom_rules", CUSTOM, "\nUNION ALL ".join(f"""
SELECT '{_name}' AS rule, source_label, {"CAST(NULL AS VARCHAR)" if _kind == "row" else "actor"} AS actor,
  CAST({"count(*)" if _kind == "row" else "any_value(n)"} AS BIGINT) AS n, count(*) AS n_rows,
  count(DISTINCT take{_k}.actor) AS n_ips, arg_min(take{_k}.actor, seq) AS ip, arg_min(path, seq) AS path, min(seq) AS first_seq,
  CAST({"count(*)" if _kind == "row" else "any_value(n)"} AS VARCHAR) || ' of ' || arg_min(take{_k}.actor, seq) AS summary
FROM take{_k} GROUP BY source_label{"" if _kind == "row" else f", take{_k}.actor"}"""
    for _k, (_name, _kind, _, _) in enumerate(D.CUSTOM_RULES)))
oracle("custom_labels", CUSTOM, "\nUNION ALL ".join([
    *(f"SELECT source_label, actor, '{_name}' AS label, count(*) AS n FROM take{_k} GROUP BY 1, 2"
      for _k, (_name, *_) in enumerate(D.CUSTOM_RULES)),
    f"SELECT source_label, actor, 'none', count(*) FROM {_LEFT} GROUP BY 1, 2"]))

TRIES = f"{BASE}, tries AS (SELECT * FROM signal WHERE {_BRUTE})"
oracle("brute_force_rolling", f"""{TRIES},
w AS (SELECT source_label, actor, ts_epoch, count(*) OVER (PARTITION BY source_label, actor
  ORDER BY ts_epoch RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW) AS c FROM tries)""", """
SELECT source_label, actor, min(ts_epoch) AS reached_at, max(c) AS peak FROM w WHERE c >= 3
GROUP BY 1, 2""")
oracle("stream_rolling", "", ORACLES["brute_force_rolling"])
oracle("detect_tumbling", TRIES, """
SELECT source_label, actor, ts_epoch - ts_epoch % 86400 AS window_start, count(*) AS n FROM tries
GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
oracle("detect_sliding", f"""{TRIES},
w AS (SELECT source_label, actor, unnest(generate_series(
    ts_epoch - ts_epoch % 21600 - 64800, ts_epoch - ts_epoch % 21600, 21600)) AS window_start
  FROM tries)""", """
SELECT source_label, actor, window_start, count(*) AS n FROM w GROUP BY 1, 2, 3
HAVING count(*) >= 2""")
oracle("detect_session", f"""{BASE},
g AS (SELECT *, CASE WHEN ts_epoch - lag(ts_epoch) OVER (PARTITION BY source_label, actor
    ORDER BY ts_epoch, seq) < 21600 THEN 0 ELSE 1 END AS new FROM signal),
s AS (SELECT *, sum(new) OVER (PARTITION BY source_label, actor ORDER BY ts_epoch, seq) AS run
  FROM g)""", """
SELECT source_label, actor, min(ts_epoch) AS "start", max(ts_epoch) AS "last", count(*) AS n FROM s
GROUP BY source_label, actor, run HAVING count(*) >= 2""")

# --- batches, context, scoring --------------------------------------------------------

_B_RAW = f"{BASE}, {BATCHED.format(source='entries')}"
_B_MASKED = f"{MASKED}, {BATCHED.format(source='masked')}, {TEXTS.format(line='sanitized_line')}"
oracle("batch_assign", _B_RAW, "SELECT seq, batch_id, batch_no FROM batched")
oracle("batch_source_label", _B_MASKED,
       "SELECT batch_id, source_label, CAST(n_rows AS INTEGER) AS n_rows, first_seq, last_seq "
       "FROM texts")
oracle("batch_prompts", _B_MASKED, f"""
SELECT batch_id, '{HEAD}' || chr(10) || 'Source: ' || source_label || chr(10) || 'Lines:'
  || chr(10) || batch_text AS prompt FROM texts""")
oracle("rolling_context", BASE, """
SELECT seq, CAST(count(*) OVER w AS INTEGER) AS n_rows, min(seq) OVER w AS first_seq,
  CAST(count(*) FILTER (status = 401) OVER w AS INTEGER) AS n_failed FROM signal
WINDOW w AS (PARTITION BY source_label ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
CONTEXT = f"""{_B_RAW},
ranked AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM batched WHERE NOT is_noise),
ends AS (SELECT batch_id AS b, max(r) AS e FROM ranked GROUP BY 1),
ctx AS (SELECT b, ranked.* FROM ends JOIN ranked ON r BETWEEN e - 29 AND e),
heads AS (SELECT b, 'Total entries: ' || count(*) || chr(10) || 'Time window: '
    || {_HMS.format('min(ts_epoch)')} || ' - ' || {_HMS.format('max(ts_epoch)')} AS t
  FROM ctx GROUP BY 1),
st AS (SELECT b, actor, string_agg(status || ':' || n, ', ' ORDER BY n DESC, s) AS statuses FROM (
    SELECT b, actor, status, count(*) AS n, min(seq) AS s FROM ctx GROUP BY 1, 2, 3) GROUP BY 1, 2),
me AS (SELECT b, actor, arg_max(method, (n, -s)) AS method FROM (
    SELECT b, actor, method, count(*) AS n, min(seq) AS s FROM ctx GROUP BY 1, 2, 3) GROUP BY 1, 2),
ua AS (SELECT b, actor, array_to_string(list_sort(list(DISTINCT user_agent))[1:3], ', ') AS agents
  FROM ctx WHERE user_agent <> '' GROUP BY 1, 2),
pa AS (SELECT b, actor, string_agg('  ' || method || ' ' || path || ' -> ' || n || 'x (status '
      || statuses || ')', chr(10) ORDER BY n DESC, s) AS lines FROM (
    SELECT b, actor, path, count(*) AS n, min(seq) AS s FROM ctx GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY b, actor ORDER BY n DESC, s) <= 5)
  JOIN st USING (b, actor) JOIN me USING (b, actor) GROUP BY 1, 2),
ac AS (SELECT b, actor, count(*) AS n, min(seq) AS s FROM ctx GROUP BY 1, 2),
blocks AS (SELECT b, string_agg('IP ' || actor || ': ' || n || ' requests' || chr(10) || lines
      || coalesce(chr(10) || '  User-Agent: ' || agents, '') || chr(10), chr(10)
      ORDER BY n DESC, s) AS t
  FROM ac JOIN pa USING (b, actor) LEFT JOIN ua USING (b, actor) GROUP BY 1),
freq AS (SELECT b, 'Frequent paths:' || chr(10) || string_agg('  ' || path || ': ' || n
      || ' hits from ' || ips || ' IPs', chr(10) ORDER BY n DESC, s) || chr(10) AS t FROM (
    SELECT b, path, count(*) AS n, count(DISTINCT actor) AS ips, min(seq) AS s FROM ctx
    WHERE path <> '' GROUP BY 1, 2 HAVING count(*) >= 3 OR count(DISTINCT actor) >= 2) GROUP BY 1)"""
oracle("batch_context_text", CONTEXT, """
SELECT h.b AS batch_id, h.t || chr(10) || chr(10) || blocks.t || coalesce(chr(10) || freq.t, '')
  AS context_text FROM heads h JOIN blocks USING (b) LEFT JOIN freq USING (b)""")
_UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
oracle("extract_from_batch", f"""{_B_MASKED},
found AS (SELECT batch_id, regexp_extract_all(batch_text, '{fixed.IP_TOKEN}') AS tok,
    regexp_extract_all(batch_text, '{_V4}') AS raw,
    regexp_extract_all(batch_text, '{fixed.REQUEST_IN_LINE}', 1) AS paths FROM texts),
chosen AS (SELECT batch_id, CASE WHEN len(tok) > 0 THEN tok ELSE raw END AS ips, paths FROM found)""",
f"""SELECT batch_id, ips[1] AS ip, array_to_string({_UNIQ.format('ips')}, ' ') AS ips,
  paths[1] AS path, array_to_string({_UNIQ.format('paths')}, ' ') AS paths FROM chosen""")
oracle("responses_parse", FAST, """
SELECT batch_id, parse_error, category, severity, round(confidence, 6) AS confidence, summary,
  recommended_action, analyzed_by FROM fast""")
oracle("severity_rank", FAST, f"""
SELECT batch_id, severity, CAST(list_position([{_list(fixed.SEVERITIES)}], severity) - 1 AS INTEGER)
  AS rank, severity <> 'low' AS at_least_medium FROM fast""")
oracle("escalation", FAST,
       "SELECT batch_id, category, round(confidence, 6) AS confidence, escalate FROM judged")
oracle("deep_merge", DEEP_MERGED, """
SELECT batch_id, escalate, category, severity, confidence, summary, recommended_action,
  details_kind, ip, ips, path, analyzed_by FROM merged""")
oracle("enrich_actions", f"""{DEEP_MERGED}, {LINES},
m AS (SELECT merged.*, regexp_extract(raw_line, '{_V4}') AS line_ip,
    regexp_extract_all(raw_line, '{_V4}') AS line_ips,
    regexp_extract(raw_line, '{fixed.REQUEST_IN_LINE}', 1) AS line_path
  FROM merged JOIN lines ON seq = batch_id),
d AS (SELECT * EXCLUDE (ip, ips, path),
    CASE WHEN parse_error OR details_kind <> 'none' THEN ip ELSE nullif(line_ip, '') END AS ip,
    CASE WHEN parse_error OR details_kind <> 'none' THEN ips
         ELSE array_to_string({_UNIQ.format('line_ips')}, ' ') END AS ips,
    CASE WHEN parse_error OR details_kind <> 'none' THEN path ELSE nullif(line_path, '') END AS path
  FROM m)""", """
SELECT batch_id, category, severity, confidence, summary,
  CASE WHEN recommended_action <> 'alert_only' OR category = 'normal' THEN recommended_action
       WHEN category IN ('bruteforce', 'exploit_attempt', 'malicious') THEN 'block_ip'
       WHEN ips <> '' THEN 'rate_limit' ELSE recommended_action END AS recommended_action,
  ip, ips, path, analyzed_by FROM d""")
oracle("infer_action", DEEP_MERGED, """
SELECT batch_id, category, severity, recommended_action,
  CASE WHEN recommended_action <> 'alert_only' THEN recommended_action
       WHEN severity NOT IN ('high', 'critical') THEN 'alert_only'
       WHEN category IN ('bruteforce', 'exploit_attempt', 'malicious') THEN 'block_ip'
       WHEN category IN ('scan', 'suspicious') THEN 'rate_limit' ELSE 'alert_only' END
    AS effective_action FROM merged""")
_B_LABELLED = f"""{_B_MASKED}, {LABELS},
caught AS (SELECT DISTINCT batch_id FROM labelled JOIN batched USING (seq) WHERE label IS NOT NULL),
open AS (SELECT texts.* FROM texts ANTI JOIN caught USING (batch_id)),
k AS (SELECT *, CASE WHEN contains(batch_text, '" 401 ') THEN 1
    WHEN contains(batch_text, '" 404 ') OR contains(batch_text, '" 403 ') THEN 2 ELSE 0 END AS c,
    contains(batch_text, '[IP_') OR regexp_matches(batch_text, '{_V4}') AS has_ip FROM open)"""
oracle("score_cascade", _B_LABELLED, """
SELECT batch_id, source_label,
  CASE c WHEN 1 THEN 'bruteforce' WHEN 2 THEN 'suspicious' ELSE 'normal' END AS category,
  CASE c WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'low' END AS severity,
  CAST(CASE c WHEN 2 THEN 0.85 ELSE 0.9 END AS DOUBLE) AS confidence, c = 2 AS escalate,
  CASE WHEN c = 1 THEN 'block_ip' WHEN c = 2 AND has_ip THEN 'rate_limit' ELSE 'alert_only' END
    AS recommended_action,
  CASE c WHEN 2 THEN 'l2_deep' ELSE 'l2_fast' END AS analyzed_by FROM k""")

# --- response -------------------------------------------------------------------------

_R = f"{BASE}, {ALERTS}"
oracle("alerts", _R, """
SELECT alert_id, rule, source_label, actor, category, severity,
  recommended_action AS effective_action, created FROM alerts""")
oracle("mitigation_rules", _R, """
SELECT rule_ord, rule_type, command, description, critical, rollback_command FROM rules""")
oracle("hitl_gate", _R, """
SELECT alert_id, severity, n_rules, critical, auto_action, status, resolved FROM gate""")
oracle("expire_pending", _R, f"""
SELECT alert_id, CASE WHEN status = 'pending' AND {AS_OF} - created > 300 THEN 'expired'
    ELSE status END AS status,
  CASE WHEN status = 'pending' AND {AS_OF} - created > 300 THEN {AS_OF} ELSE resolved END
    AS resolved FROM gate""")
oracle("apply_decisions", _R, "SELECT alert_id, status, resolved FROM decided")
oracle("ignored_decisions", _R, """
SELECT alert_id, decision FROM decisions ANTI JOIN gate USING (alert_id)""")
oracle("execution_dry_run", _R, "SELECT * FROM ledger")
oracle("rules_report", _R, f"""
SELECT DISTINCT alert_id, CAST(NULL AS BIGINT) AS line_ord,
  CASE WHEN record_success THEN '✓' ELSE '✗' END || ' Alert ' || left(alert_id, 8)
    || '... [DRY-RUN] at 2024-02-01T02:00:00' AS line FROM ledger
UNION ALL SELECT alert_id, step, '  ✓ [' || rule_type || '] ' || command FROM ledger
WHERE step IS NOT NULL""")
oracle("rollback_plan", _R, """
SELECT alert_id, -step AS step, rule_type, rollback_command AS command,
  '[DRY RUN] ' || rollback_command AS output, starts_with(rollback_command, '#') AS manual
FROM ledger WHERE rollback_command <> ''""")
_E = r"regexp_replace({}, '([_*\[\]()~`>#+\-=|{{}}.!])', '\\\1', 'g')"
_CAT = "CASE category " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CATEGORY_LABELS.items()) + " END"
_ICON = "CASE severity " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEVERITY_ICONS.items()) + " END"
_TIME = "strftime(to_timestamp(created) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S UTC')"
_N = "chr(10)"
oracle("alert_messages", f"""{_R},
cmds AS (SELECT alert_id, string_agg('`' || {_E.format('command')} || '`', {_N} ORDER BY rule_ord)
    AS chat, string_agg('  ' || command, {_N} ORDER BY rule_ord) AS plain FROM rules GROUP BY 1),
parts AS (SELECT *, rule_ord FROM rules)""", f"""
SELECT alert_id, CAST(0 AS BIGINT) AS part, 'chat' AS channel,
  '\U0001f6a8 *THREAT DETECTED*' || {_N} || {_N} || '*Site:* ' || {_E.format('source_label')} || {_N}
  || '*Category:* ' || {_CAT} || {_N} || '*Severity:* ' || upper(severity) || {_N}
  || '*Confidence:* 0\\.95' || {_N} || '*Time:* ' || {_E.format(_TIME)} || {_N} || {_N}
  || '*Summary:* ' || {_E.format('summary')} || {_N} || {_N} || '*Indicators:*' || {_N} || '• '
  || {_E.format('indicator')} || {_N} || {_N} || '*Mitigation suggestion:*' || {_N} || chat
  AS message FROM gate JOIN cmds USING (alert_id)
UNION ALL
SELECT alert_id, CAST(0 AS BIGINT), 'plain',
  {_ICON} || '  THREAT DETECTED' || {_N} || 'Site: ' || source_label || {_N} || 'Category: '
  || {_CAT} || {_N} || 'Severity: ' || {_ICON} || ' ' || upper(severity) || {_N}
  || 'Confidence: 0.95' || {_N} || 'Source: ' || ip || {_N} || 'Time: ' || {_TIME} || {_N} || {_N}
  || 'Summary:' || {_N} || '  ' || summary || {_N} || {_N} || 'Indicators:' || {_N} || '  • '
  || indicator || {_N} || {_N} || 'Suggested Mitigation:' || {_N} || plain || {_N} || {_N}
  || 'Status: ' || upper(status) || CASE status WHEN 'pending' THEN ' (awaiting approval)'
       ELSE ' (approved)' END
FROM gate JOIN cmds USING (alert_id)""")

# --- across sources and over time --------------------------------------------------------

oracle("source_correlation", f"""{ROUTED},
rows AS (SELECT ts_epoch, source_ip AS actor, source_label, status, method,
    CASE source_label WHEN 'site-0' THEN 'nginx' ELSE 'apache' END AS format
  FROM parsed WHERE source_label <> 'site-2'
  UNION ALL SELECT ts_epoch, source_ip, source_label, status, method, 'syslog' FROM sysl),
g AS (SELECT ts_epoch - ts_epoch % 86400 AS window_start, actor,
    count(DISTINCT source_label) AS n_sources, count(*) AS n,
    count(*) FILTER (format <> 'syslog' AND status = 404) AS web_404,
    count(*) FILTER (format = 'syslog' AND method IN ('FAILED', 'AUTH_FAILED')) AS auth_failed,
    count(*) FILTER (format = 'apache' AND status = 500) AS apache_500,
    count(*) FILTER (format = 'nginx' AND status = 200) AS nginx_200 FROM rows GROUP BY 1, 2)""", """
SELECT *, web_404 >= 1 AND auth_failed >= 1 AS coordinated,
  apache_500 > 0 AND nginx_200 > 0 AS app_layer FROM g WHERE n_sources >= 2""")
oracle("feedback_metrics", _R, """
SELECT category, count(*) AS n_settled, count(*) FILTER (status = 'rejected') AS n_rejected,
  round(avg(CAST(status = 'rejected' AS INT)), 6) AS false_positive_rate,
  round(avg(CAST(status <> 'rejected' AS INT)), 6) AS accuracy
FROM decided WHERE status IN ('approved', 'rejected') GROUP BY 1""")
oracle("autonomy_gate", _R, """
SELECT alert_id, rule_ord, rule_type, recommended_action AS effective_action,
  CASE rule_type WHEN 'ufw' THEN 'never' WHEN 'rate_limit' THEN 'auto' ELSE 'approval' END AS mode
FROM rules JOIN alerts USING (alert_id)""")
oracle("mitigation_verdict", f"""{_R},
acts AS (SELECT alert_id, actor, {AS_OF - 16 * 86_400} - first_seq % 600 AS acted FROM gate
  WHERE actor IS NOT NULL),
c AS (SELECT alert_id, acts.actor,
    count(*) FILTER (ts_epoch >= acted - 432000 AND ts_epoch < acted) AS n_before,
    count(*) FILTER (ts_epoch >= acted AND ts_epoch < acted + 432000) AS n_after
  FROM acts LEFT JOIN signal ON signal.actor = acts.actor GROUP BY 1, 2)""", """
SELECT *, CASE WHEN n_after = 0 THEN 'resolved' WHEN n_after > n_before THEN 'escalated'
  ELSE 'ongoing' END AS verdict FROM c""")

# --- streams ------------------------------------------------------------------------------

_W = "ts_epoch - ts_epoch % 86400"
oracle("stream_detect", f"""{BASE},
x AS (SELECT {_W} AS window_start, source_label, actor, path, coalesce({_SQLI}, false) AS s,
    coalesce({_TRAV}, false) AS t, coalesce({_BRUTE}, false) AS b, coalesce({_SCAN}, false) AS c,
    coalesce({_FUZZ}, false) AS f FROM signal),
y AS (SELECT *, count(*) FILTER (b AND NOT s AND NOT t)
    OVER (PARTITION BY window_start, source_label, actor) >= 2 AS q FROM x),
w AS (SELECT window_start, source_label, actor,
    count(*) FILTER (s) AS sqli, count(*) FILTER (t AND NOT s) AS traversal,
    count(*) FILTER (b AND NOT s AND NOT t) AS bruteforce,
    count(*) FILTER (c AND NOT s AND NOT t AND NOT (q AND b)) AS scanner,
    count(DISTINCT path) FILTER (f AND NOT s AND NOT t AND NOT c AND NOT (q AND b)) AS path_fuzz
    FROM y GROUP BY 1, 2, 3),
u AS (UNPIVOT w ON sqli, traversal, bruteforce, scanner, path_fuzz INTO NAME rule VALUE n)""", """
SELECT window_start, source_label, actor, rule, CASE rule WHEN 'sqli' THEN 'critical'
  WHEN 'path_fuzz' THEN 'medium' ELSE 'high' END AS severity, n FROM u
WHERE n >= CASE WHEN rule IN ('bruteforce', 'path_fuzz') THEN 2 ELSE 1 END""")
oracle("stream_token_epochs", f"""RECURSIVE {BASE},
seen AS (SELECT DISTINCT actor AS value, ts_epoch AS epoch FROM signal),
starts AS (SELECT value, min(epoch) AS s, 1 AS k FROM seen GROUP BY 1
  UNION ALL SELECT p.value, min(o.epoch), p.k + 1 FROM starts p JOIN seen o
    ON o.value = p.value AND o.epoch > p.s + 3600 GROUP BY p.value, p.s, p.k)""",
       "SELECT value, CAST(k AS BIGINT) AS epoch_no, s AS epoch_start FROM starts")

# --- the whole path -------------------------------------------------------------------

oracle("pipeline_rejected", "", f"""
SELECT source_label, reason, count(*) AS n_lines FROM ({ORACLES["format_routing"]})
WHERE reason IS NOT NULL GROUP BY 1, 2""")
oracle("pipeline_alerts", "", f"""
SELECT rule, source_label, category, severity, effective_action, 'local_rules' AS analyzed_by
FROM ({ORACLES["alerts"]})
UNION ALL SELECT 'batch ' || batch_id, source_label, category, severity,
  CASE category WHEN 'bruteforce' THEN 'block_ip' ELSE 'rate_limit' END, analyzed_by
FROM ({ORACLES["score_cascade"]}) WHERE category <> 'normal'""")
oracle("windowed_findings", "", ORACLES["stream_detect"])
oracle("l1_finding_paths", f"{BASE}, {LABELS}", """
SELECT label AS rule, source_label, CASE WHEN label IN ('bruteforce', 'path_fuzz') THEN actor END
  AS actor, path, min(seq) AS path_seq FROM labelled WHERE label IS NOT NULL GROUP BY 1, 2, 3, 4""")
oracle("stream_tail", f"{LINES}, {_access('lines', 'parsed')}",
       "SELECT ts_epoch, source_ip, method, path, status FROM parsed")
# each step of the recursion takes the next row of every shard into its list of recent rows
oracle("context_consume", f"""RECURSIVE {BASE},
tries AS (SELECT seq, source_label, actor, coalesce({_BRUTE}, false) AS failed,
    CAST(CAST('0x' || substr(md5(actor), 1, 8) AS BIGINT) % 16 AS INT) AS shard FROM signal),
r AS (SELECT *, row_number() OVER (PARTITION BY source_label, shard ORDER BY seq) AS n FROM tries),
st AS (
  SELECT CAST(0 AS BIGINT) AS n, source_label, shard,
    CAST([] AS STRUCT(seq BIGINT, actor VARCHAR, failed BOOLEAN)[]) AS recent,
    CAST(NULL AS VARCHAR) AS actor, CAST(0 AS BIGINT) AS first_seq, CAST(0 AS BIGINT) AS last_seq,
    CAST(0 AS BIGINT) AS k FROM (SELECT DISTINCT source_label, shard FROM r)
  UNION ALL
  SELECT n, source_label, shard,
    CASE WHEN hit THEN list_filter(cur, lambda x: NOT (x.failed AND x.actor = who)) ELSE cur END,
    CASE WHEN hit THEN who END, mine[1].seq, at_seq, len(mine)
  FROM (SELECT *, failed AND len(mine) >= 3 AS hit FROM (
    SELECT *, list_filter(cur, lambda x: x.failed AND x.actor = who) AS mine FROM (
      SELECT r.n, r.source_label, r.shard, r.actor AS who, r.seq AS at_seq, r.failed,
        list_append(s.recent, {{'seq': r.seq, 'actor': r.actor, 'failed': r.failed}})[-30:] AS cur
      FROM st s JOIN r ON r.source_label = s.source_label AND r.shard = s.shard AND r.n = s.n + 1)))
)""", """
SELECT source_label, shard, actor, first_seq, last_seq, CAST(k AS INT) AS n FROM st
WHERE actor IS NOT NULL""")
oracle("noise_reasons", BASE, f"""
SELECT source_label, noise_reason, count(*) AS n_rows FROM (SELECT source_label, CASE
    WHEN noise_reason IS NOT NULL THEN noise_reason
    WHEN status IN ({_list(fixed.SUSPICIOUS_STATUSES)}) AND ({_PARTS}) THEN NULL
    WHEN status = 404 THEN 'ignored_status'
    WHEN method = 'GET' AND status = 200 AND response_size < 500 THEN 'small_get' END AS noise_reason
  FROM entries) GROUP BY 1, 2""")
oracle("execution_status", "", f"""
SELECT a.alert_id, CASE WHEN a.status = 'approved' THEN CASE WHEN l.good THEN 'executed' ELSE 'failed' END
  ELSE a.status END AS status FROM ({ORACLES["apply_decisions"]}) a
JOIN (SELECT alert_id, bool_and(step IS NULL OR step % 5 <> 0) AS good
  FROM ({ORACLES["execution_dry_run"]}) GROUP BY 1) l USING (alert_id)""")

# --- live ------------------------------------------------------------------------------

# row rules are one alert per window and source, actor rules one per actor
oracle("stream_alerts", "", f"""
SELECT window_start, source_label, rule, actor, severity,
  CASE WHEN severity = 'medium' THEN 'approved' ELSE 'pending' END AS status, channel,
  CASE channel WHEN 'dead' THEN 'dead' ELSE 'sent' END AS state,
  CAST(CASE channel WHEN 'dead' THEN 0 ELSE 1 END AS BIGINT) AS n_sent
FROM (SELECT DISTINCT window_start, source_label, rule, severity,
        CASE WHEN rule IN ('bruteforce', 'path_fuzz') THEN actor END AS actor
      FROM ({ORACLES["stream_detect"]})),
  (SELECT unnest(['chat', 'flaky', 'dead']) AS channel)""")
oracle("stream_approvals", "", f"""
SELECT alert_id, d.status FROM ({ORACLES["apply_decisions"]}) d
JOIN (SELECT alert_id FROM ({ORACLES["hitl_gate"]}) WHERE status = 'pending') USING (alert_id)""")

oracle("epoch_tokens", f"""RECURSIVE {MASKED}, {OCCURRENCES},
seen AS (SELECT DISTINCT hashed AS value, ts_epoch AS epoch FROM occ),
starts AS (SELECT value, min(epoch) AS s, 1 AS k FROM seen GROUP BY 1
  UNION ALL SELECT p.value, min(o.epoch), p.k + 1 FROM starts p JOIN seen o
    ON o.value = p.value AND o.epoch > p.s + 3600 GROUP BY p.value, p.s, p.k)""", f"""
SELECT seq, prefix, original, CAST(k AS BIGINT) AS epoch_no, s AS epoch_start,
  prefix || left(sha256('{SALT}' || original || '|' || s), 32) || ']' AS token
FROM occ JOIN starts ON value = hashed AND ts_epoch BETWEEN s AND s + 3600""")
oracle("token_state_purge", f"""RECURSIVE {BASE},
seen AS (SELECT DISTINCT actor AS value, ts_epoch AS epoch FROM signal),
starts AS (SELECT value, min(epoch) AS s FROM seen GROUP BY 1
  UNION ALL SELECT p.value, min(o.epoch) FROM starts p JOIN seen o
    ON o.value = p.value AND o.epoch > p.s + 86400 GROUP BY p.value, p.s)""", """
SELECT value, max(s) AS epoch_start,
  max(s) + 86400 <= (SELECT max(ts_epoch) FROM signal) - 3600 AS purged FROM starts GROUP BY 1""")
# contexts as in CONTEXT, of the rows that no rule took
_C_OPEN = f"""{_B_RAW}, {LABELS}, {TEXTS.format(line='raw_line')},
caught AS (SELECT DISTINCT batch_id FROM labelled JOIN batched USING (seq) WHERE label IS NOT NULL),
rest AS (SELECT * FROM batched ANTI JOIN (SELECT seq FROM labelled WHERE label IS NOT NULL) USING (seq)),
{CONTEXT[len(_B_RAW) + 2:].replace("FROM batched WHERE NOT is_noise", "FROM rest WHERE NOT is_noise")},
c AS (SELECT h.b AS batch_id, h.t || chr(10) || chr(10) || blocks.t || coalesce(chr(10) || freq.t, '')
    AS context_text FROM heads h JOIN blocks USING (b) LEFT JOIN freq USING (b)),
asked AS (SELECT batch_id, source_label, batch_text, context_text,
    chr(10) || 'Source: ' || source_label || chr(10) || 'Context:' || chr(10) || context_text || chr(10)
      || 'Lines:' || chr(10) || batch_text AS tail,
    CASE WHEN contains(context_text, '(status 401:') THEN 'bruteforce'
      WHEN len(string_split(context_text, ' hits from ')) > 5 THEN 'suspicious' ELSE 'normal' END AS category
  FROM texts ANTI JOIN caught USING (batch_id) JOIN c USING (batch_id))"""
oracle("scored_context", _C_OPEN, f"""
SELECT batch_id, '{HEAD}' || tail AS prompt, category,
  CASE category WHEN 'bruteforce' THEN 'medium' ELSE 'low' END AS severity,
  category = 'suspicious' AS escalate FROM asked""")
DEEP_HEAD = _q(
    "Investigate the activity below in depth: stages, links between lines, techniques. Answer with one JSON object: "
    "threat_type, attack_pattern, mitre_ttps, severity (low, medium, high, critical), confidence (0.0 to 1.0), summary, "
    "recommended_action (block_ip, block_path, rate_limit, alert_only, investigate), action_details with ip, ips, path "
    "and paths, zone_name and rate for a rate limit. Copy addresses, tokens such as [IP_001] and paths exactly as the "
    "lines show them."
)
oracle("deep_prompts", _C_OPEN, f"""
SELECT batch_id, '{DEEP_HEAD}' || chr(10) || 'First opinion: suspicious at 0.50' || tail AS prompt
FROM asked WHERE category = 'suspicious'""")

oracle("cached_replies", BASE, """
SELECT seq, CASE WHEN status = 401 THEN '{"category":"bruteforce","severity":"medium","confidence":0.9}'
  WHEN status IN (403, 404) THEN '{"category":"suspicious","severity":"medium","confidence":0.5}'
  ELSE '{"category":"normal","severity":"low","confidence":0.9}' END AS reply FROM entries""")
oracle("stream_correlation", "", f"""
SELECT window_start, actor, web_404, auth_failed FROM ({ORACLES["source_correlation"]}) WHERE coordinated""")

# --- all formats to rules and status ------------------------------------------------------

_SITE = "' (detected on ' || source_label || ')'"
_ALL = f"""{LINES}, {SYSLOG}, {_access('lines', 'acc')},
parsed AS (SELECT seq, source_label, raw_line, source_ip, method, path, status, user_agent, ts_epoch
  FROM acc WHERE source_label <> 'site-2'
  UNION ALL SELECT s.seq, s.source_label, a.raw_line, source_ip, method, path, status, '', ts_epoch
  FROM sysl s JOIN auth a USING (seq)),
{FLAGGED}, {ALERTS},
named2 AS (SELECT 'batch ' || source_label || '-' || seq AS rule, source_label, CAST(NULL AS VARCHAR) AS actor,
    seq AS first_seq, status, path, source_ip FROM signal
  WHERE source_label <> 'auth-main' AND status IN (401, 403, 404)),
second AS (SELECT *, {_ID} AS alert_id FROM named2),
t401 AS (SELECT *, unnest(['0', '1']) AS k FROM second WHERE status = 401),
i401 AS (SELECT * REPLACE (CAST(k AS BIGINT) AS k), CASE k WHEN '0' THEN source_ip ELSE '192.0.2.9' END AS ip FROM t401),
t404 AS (SELECT *, unnest(['0', '1']) AS k FROM second WHERE status = 404),
p404 AS (SELECT * REPLACE (CAST(k AS BIGINT) AS k, CASE k WHEN '0' THEN path ELSE '/extra' END AS path) FROM t404),
more AS (
  SELECT alert_id, k * 2 AS rule_ord, 'nginx_deny' AS rule_type, 'deny ' || ip || ';' AS command,
    'Deny IP ' || ip || ' in Nginx' || {_SITE} AS description, true AS critical,
    '# remove: deny ' || ip || ';' AS rollback_command FROM i401
  UNION ALL SELECT alert_id, k * 2 + 1, 'ufw', 'sudo ufw deny from ' || ip,
    'Block IP ' || ip || ' via UFW firewall' || {_SITE}, true, 'sudo ufw delete deny from ' || ip FROM i401
  UNION ALL SELECT alert_id, k * 2, 'nginx_deny', 'location ' || path || ' {{ deny all; }}',
    'Deny all access to path ' || path || {_SITE}, true, '# remove: location ' || path || ' {{ deny all; }}' FROM p404
  UNION ALL SELECT alert_id, CAST(0 AS BIGINT), 'rate_limit',
    'limit_req_zone $binary_remote_addr zone=z403:10m rate=3r/s;', 'Rate limit zone ''z403'' at 3r/s' || {_SITE}, false,
    '# remove: limit_req_zone ... zone=z403:10m ...' FROM second WHERE status = 403
  UNION ALL SELECT alert_id, CAST(1 AS BIGINT), 'rate_limit', 'limit_req zone=z403;',
    'Apply rate limit zone ''z403'' to ' || path || {_SITE}, false, '# remove: limit_req zone=z403; from ' || path
  FROM second WHERE status = 403),
both_rules AS (SELECT * FROM rules UNION ALL SELECT * FROM more),
both_alerts AS (
  SELECT alert_id, rule, source_label, severity, recommended_action AS effective_action, created FROM alerts
  UNION ALL SELECT alert_id, rule, source_label, 'high', CASE status WHEN 401 THEN 'block_ip' WHEN 403 THEN 'rate_limit'
    ELSE 'block_path' END, {AS_OF} - first_seq % 600 FROM second)"""
oracle("pipeline_rules", _ALL, """
SELECT rule_ord, rule_type, command, description, critical, rollback_command, a.rule AS alert_rule, source_label
FROM both_rules JOIN both_alerts a USING (alert_id)""")
oracle("pipeline_status", _ALL, f"""
SELECT alert_id, rule, source_label, severity, effective_action, n_rules, c AS critical,
  CASE WHEN severity IN ('low', 'medium') AND NOT c THEN 'approved'
    WHEN {AS_OF + 3600} - created > 300 THEN 'expired' ELSE 'pending' END AS status
FROM (SELECT a.*, n_rules, severity IN ('high', 'critical') OR drastic AS c
  FROM both_alerts a JOIN (SELECT alert_id, count(*) AS n_rules, bool_or(rule_type IN ('ufw', 'nginx_deny')) AS drastic
    FROM both_rules GROUP BY 1) USING (alert_id))""")
