"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views. The
feedback view is inlined as a CTE; column names equal the Spark results.
"""

from __future__ import annotations

import datetime

from feedlens.plans import catalog as C

_WS = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


FEEDBACK_CTE = """feedback AS (
SELECT e.event_id AS id,
  concat(CASE e.event_id % 12
    WHEN 0 THEN 'URGENT: checkout is down.' WHEN 1 THEN 'Feature idea: dark theme.' WHEN 2 THEN 'Bug when saving a draft.'
    WHEN 3 THEN 'I love the new editor.' WHEN 4 THEN 'Author page shows an error.' WHEN 5 THEN 'Very slow on mobile.'
    WHEN 6 THEN 'Login timeout again.' WHEN 7 THEN 'Please debug the slow export, urgent.' WHEN 8 THEN 'Discount of 50% is unclear.'
    WHEN 9 THEN concat('Path C:', chr(92), 'temp is rejected.') WHEN 10 THEN 'Écran noir au démarrage.' ELSE 'Nothing to add.' END,
    ' ', d.text) AS text,
  concat('user_', CAST(e.user_id AS VARCHAR)) AS source,
  CASE e.event_id % 7 WHEN 0 THEN 'web' WHEN 1 THEN 'discord' WHEN 2 THEN 'github' WHEN 3 THEN 'twitter'
    WHEN 4 THEN 'email' WHEN 5 THEN 'support' ELSE 'slack' END AS channel,
  CASE e.event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity_hint,
  CASE e.user_id % 9 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'business' WHEN 3 THEN 'enterprise' WHEN 4 THEN 'dev'
    WHEN 5 THEN 'tester' WHEN 6 THEN 'team lead' WHEN 7 THEN 'manager' ELSE NULL END AS user_tier,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE CASE (e.event_id * 31 + e.user_id) % 7 WHEN 0 THEN 'Bug Report'
    WHEN 1 THEN 'Feature Request' WHEN 2 THEN 'Urgent' WHEN 3 THEN 'Praise' WHEN 4 THEN 'Security' WHEN 5 THEN 'Performance'
    ELSE 'Other' END END AS tag,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE CAST((e.event_id * 37) % 201 - 100 AS DOUBLE) / 100 END AS sentiment,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE CAST(regexp_extract(e.props, '[0-9]+', 0) AS DOUBLE) / 100 END AS urgency_score,
  CAST(NULL AS VARCHAR) AS summary,
  CASE e.event_id % 4 WHEN 0 THEN 'To Do' WHEN 1 THEN 'in progress' WHEN 2 THEN 'to be reviewed' ELSE 'done' END AS status,
  e.ts AS created_at,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE e.ts + INTERVAL '1' MINUTE END AS analyzed_at,
  CASE WHEN e.event_id % 3 = 0 THEN e.ts ELSE e.ts + (e.event_id % 240) * INTERVAL '37' MINUTE END AS updated_at,
  CASE e.event_id % 10
    WHEN 0 THEN 'not json' WHEN 1 THEN '{"tag":"bug","sentiment":"0.4","urgency":0.9,"summary":"ok"}'
    WHEN 2 THEN '{"tag":null,"sentiment":null,"urgency":null}' WHEN 3 THEN '{"sentiment":7,"urgency_score":-3}'
    WHEN 4 THEN '{"tag":"Slow page","sentiment":"Infinity","urgency":"abc","summary":5}'
    WHEN 5 THEN '{"urgency":null,"urgency_score":null}' WHEN 6 THEN '{"sentiment":"","urgency":true}'
    WHEN 7 THEN '{"sentiment":"0x10","urgency":"1f"}' WHEN 8 THEN '[]' ELSE NULL END AS raw_response
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""

LIB = "id, text, source, channel, tag, sentiment, urgency_score, summary, status, user_tier, created_at, analyzed_at, updated_at"
SRCH = "id, text, tag, sentiment, status, user_tier, channel, created_at"


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join((FEEDBACK_CTE,) + ctes) + "\n"


# Tag cascade. Fixed values, written out so that a wrong list elsewhere shows.
_TAG_WORDS = [("Urgent", ["urgent"]), ("Feature Request", ["feature"]), ("Bug Report", ["bug"]), ("Praise", ["praise", "love"]),
              ("Security", ["security", "auth", "vulnerability"]), ("Performance", ["performance", "slow", "timeout"])]


def _kw_tag(text: str) -> str:
    arms = []
    for tag, words in _TAG_WORDS:
        cond = " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        arms.append(f"WHEN {cond} THEN '{tag}'")
    return "CASE " + " ".join(arms) + " ELSE 'Other' END"


def _dim(col: str) -> str:
    return f"coalesce(nullif({col}, ''), 'unknown')"


def _boxplot(col: str) -> str:
    return W(f"""b AS (SELECT {_dim(col)} AS dimension, sentiment AS v FROM feedback WHERE {col} IS NOT NULL AND sentiment IS NOT NULL)""",
             """r AS (SELECT dimension, v, row_number() OVER (PARTITION BY dimension ORDER BY v) - 1 AS r,
                   count(*) OVER (PARTITION BY dimension) AS n FROM b)""") + """
SELECT dimension, CAST(max(n) AS BIGINT) AS n, min(v) AS "min",
  max(CASE WHEN r = floor(n * 0.25) THEN v END) AS q1, max(CASE WHEN r = floor(n * 0.5) THEN v END) AS median,
  max(CASE WHEN r = floor(n * 0.75) THEN v END) AS q3, max(v) AS "max", round(avg(v), 6) AS mean
FROM r GROUP BY dimension"""


def _resolution(actionable: bool) -> str:
    extra = " AND tag IN ('Bug Report', 'Feature Request', 'Urgent', 'Security', 'Performance')" if actionable else ""
    return W() + f"""SELECT tag, CAST(trunc(avg(h)) AS INTEGER) AS avg_hours, count(*) AS count FROM (
  SELECT tag, CAST(trunc((epoch_us(updated_at) - epoch_us(created_at)) / 3600000000.0) AS BIGINT) AS h FROM feedback
  WHERE tag IS NOT NULL AND updated_at IS NOT NULL AND created_at IS NOT NULL AND updated_at <> created_at{extra}) GROUP BY tag"""


def _group_key(group: str) -> str:
    if group == "tier":
        return "coalesce(nullif(user_tier, ''), 'unknown')"
    return f"coalesce(nullif({group}, ''), nullif(user_tier, ''), 'unknown')"


def _intervals_cte(group: str) -> str:
    return f"""o AS (SELECT min(coalesce(created_at, updated_at)) AS m FROM feedback),
iv AS (SELECT id, {_group_key(group)} AS group_key,
  CAST(floor((epoch_us(created_at) - epoch_us(m)) / 86400000000.0) AS BIGINT) AS start_day,
  greatest(CAST(floor((epoch_us(updated_at) - epoch_us(m)) / 86400000000.0) AS BIGINT), start_day) AS end_day
  FROM feedback, o)"""


def _peak(group: str) -> str:
    return W(_intervals_cte(group),
             """ev AS (SELECT group_key, start_day AS day, 1 AS d, 1 AS item FROM iv
        UNION ALL SELECT group_key, end_day + 1 AS day, -1 AS d, 0 AS item FROM iv)""",
             """pd AS (SELECT group_key, day, sum(d) AS d, sum(item) AS items FROM ev GROUP BY group_key, day)""",
             """r AS (SELECT group_key, items, sum(d) OVER (PARTITION BY group_key ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive FROM pd)""") + \
        "SELECT group_key, CAST(sum(items) AS BIGINT) AS items, CAST(max(alive) AS BIGINT) AS lanes FROM r GROUP BY group_key"


def _jkind(j: str, path: str) -> str:
    return f"json_type({j}, '{path}')"


def _jnum(kind: str, val: str) -> str:
    """JavaScript Number() over a JSON value given its DuckDB json_type and text; NULL = NaN."""
    s = _trim(val)
    return f"""(CASE WHEN {kind} IS NULL THEN NULL WHEN {kind} = 'NULL' THEN 0.0
  WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {val} = 'true' THEN 1.0 ELSE 0.0 END
  WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN TRY_CAST({val} AS DOUBLE)
  WHEN {kind} = 'VARCHAR' THEN CASE
    WHEN {s} = '' THEN 0.0
    WHEN regexp_full_match({s}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({s} AS DOUBLE)
    WHEN regexp_full_match(lower({s}), '0x[0-9a-f]+') THEN CAST(TRY_CAST({s} AS UBIGINT) AS DOUBLE)
    WHEN regexp_full_match({s}, '[+]?Infinity') THEN CAST('inf' AS DOUBLE)
    WHEN {s} = '-Infinity' THEN CAST('-inf' AS DOUBLE)
    ELSE NULL END
  ELSE NULL END)"""


def _clamp(n: str, lo: float, hi: float, fb: float) -> str:
    return f"(CASE WHEN {n} IS NULL OR NOT isfinite({n}) THEN CAST({fb} AS DOUBLE) ELSE least(CAST({hi} AS DOUBLE), greatest(CAST({lo} AS DOUBLE), {n})) END)"


def _normalize() -> str:
    tag_text = """(CASE WHEN tk IS NULL OR tk = 'NULL' THEN '' WHEN tk = 'VARCHAR' THEN tv
        WHEN tk = 'BOOLEAN' THEN CASE WHEN tv = 'true' THEN 'true' ELSE '' END
        WHEN tk = 'ARRAY' THEN CAST(json_extract(j, '$.tag') AS VARCHAR) WHEN tk = 'OBJECT' THEN '[object Object]' ELSE tv END)"""
    return W("""p AS (SELECT id, raw_response AS raw, CASE WHEN json_valid(raw_response) THEN raw_response END AS j FROM feedback)""",
             """f AS (SELECT id, raw, j, json_type(j, '$.tag') AS tk, json_extract_string(j, '$.tag') AS tv,
   json_type(j, '$.sentiment') AS sk, json_extract_string(j, '$.sentiment') AS sv,
   CASE WHEN json_type(j, '$.urgency') IS NULL OR json_type(j, '$.urgency') = 'NULL' THEN json_type(j, '$.urgency_score')
        ELSE json_type(j, '$.urgency') END AS uk,
   CASE WHEN json_type(j, '$.urgency') IS NULL OR json_type(j, '$.urgency') = 'NULL' THEN json_extract_string(j, '$.urgency_score')
        ELSE json_extract_string(j, '$.urgency') END AS uv,
   json_type(j, '$.summary') AS mk, json_extract_string(j, '$.summary') AS mv FROM p)""") + f"""
SELECT id,
  CASE WHEN raw IS NOT NULL THEN {_kw_tag(tag_text)} END AS tag,
  CASE WHEN raw IS NOT NULL THEN {_clamp(_jnum('sk', 'sv'), -1.0, 1.0, 0.0)} END AS sentiment,
  CASE WHEN raw IS NOT NULL THEN {_clamp(_jnum('uk', 'uv'), 0.0, 1.0, 0.2)} END AS urgency_score,
  CASE WHEN raw IS NOT NULL THEN coalesce(CASE WHEN mk = 'VARCHAR' THEN substring(mv, 1, 140) END, '') END AS summary
FROM f"""


def _truthy(b: str, path: str) -> str:
    k, v = f"json_type({b}, '{path}')", f"json_extract_string({b}, '{path}')"
    return (f"({k} IS NOT NULL AND {k} <> 'NULL' AND NOT ({k} = 'VARCHAR' AND {v} = '') "
            f"AND NOT ({k} = 'BOOLEAN' AND {v} = 'false') "
            f"AND NOT ({k} IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND TRY_CAST({v} AS DOUBLE) = 0))")


_INGEST_RAW = """raw AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN json_object('feedback', turn)
  WHEN role = 'user' THEN json_object('feedback', text, 'source', role, 'channel',
       CASE conv_id % 3 WHEN 0 THEN 'discord' WHEN 1 THEN 'github' ELSE 'email' END)
  ELSE json_object('feedback', text, 'tier', '', 'user_tier', 'pro', 'severity_hint', 'low') END AS value
  FROM conversations)"""


def _ingest() -> str:
    b = "value"
    ft = _trim(f"json_extract_string({b}, '$.feedback')")
    ok = f"(json_valid({b}) AND json_type({b}, '$.feedback') = 'VARCHAR' AND {ft} <> '')"

    def od(path, default):
        return f"CASE WHEN {_truthy(b, path)} THEN json_extract_string({b}, '{path}') ELSE {default} END"
    return f"""WITH {_INGEST_RAW}
SELECT conv_id, turn, CASE WHEN {ok} THEN {ft} END AS text,
  CASE WHEN {ok} THEN {od('$.source', "'user'")} END AS source,
  CASE WHEN {ok} THEN {od('$.channel', "'web'")} END AS channel,
  CASE WHEN {ok} THEN {od('$.severity_hint', 'CAST(NULL AS VARCHAR)')} END AS severity_hint,
  CASE WHEN {ok} THEN CASE WHEN {_truthy(b, '$.tier')} THEN json_extract_string({b}, '$.tier')
                           WHEN {_truthy(b, '$.user_tier')} THEN json_extract_string({b}, '$.user_tier') ELSE 'free' END END AS user_tier,
  CASE WHEN NOT {ok} THEN 'Missing ''feedback'' string in body' END AS reject_reason
FROM raw"""


def _changes() -> str:
    b = "body"
    tx = _trim(f"json_extract_string({b}, '$.text')")
    is_str = lambda p: f"(json_type({b}, '{p}') = 'VARCHAR')"
    text_ok = f"({is_str('$.text')} AND {tx} <> '')"
    tag_alone = f"({is_str('$.tag')} AND NOT {_truthy(b, '$.text')})"
    text_alone = f"({text_ok} AND NOT {_truthy(b, '$.tag')})"
    both = f"({text_ok} AND {is_str('$.tag')})"
    pid = f"TRY_CAST(nullif(regexp_extract(id_text, '^{_WS}*([+-]?[0-9]+)', 1), '') AS BIGINT)"
    return f"""WITH raw AS (SELECT event_id AS request_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'patch' END AS op,
  CASE WHEN event_type = 'view' THEN concat(' ', CAST(event_id // 2 AS VARCHAR), 'abc')
       WHEN event_type = 'signup' THEN concat('x', CAST(event_id AS VARCHAR)) ELSE CAST(event_id AS VARCHAR) END AS id_text,
  CASE WHEN event_type = 'click' THEN json_object('status', 'done', 'sentiment', value / 100)
       WHEN event_type = 'purchase' THEN json_object('tag', 'Praise', 'text', '  ')
       WHEN event_type = 'view' THEN json_object('text', ' B ', 'tag', '')
       WHEN event_type = 'signup' THEN json_object('sentiment', '0.5') END AS body FROM events),
p AS (SELECT request_id, op, {pid} AS id, CASE WHEN json_valid({b}) THEN {b} END AS {b} FROM raw)
SELECT request_id, op, id,
  CASE WHEN op = 'patch' AND {is_str('$.status')} THEN json_extract_string({b}, '$.status') END AS status,
  CASE WHEN op = 'patch' AND json_type({b}, '$.sentiment') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
       THEN CAST(json_extract_string({b}, '$.sentiment') AS DOUBLE) END AS sentiment,
  CASE WHEN op = 'patch' AND ({tag_alone} OR {both}) THEN json_extract_string({b}, '$.tag') END AS tag,
  CASE WHEN op = 'patch' AND ({text_alone} OR {both}) THEN {tx} END AS text,
  CASE WHEN op NOT IN ('patch', 'delete') THEN 'Unknown operation' WHEN id IS NULL OR id = 0 THEN 'Invalid ID'
       WHEN op = 'patch' AND {b} IS NULL THEN 'Empty body' END AS reject_reason
FROM p"""


def _ingest_to_snapshot() -> str:
    """Accepted requests numbered in order, tagged by keyword, then changed by the request of their number, if any."""
    t0 = "TIMESTAMP '2024-03-01 00:00:00'"
    return _ingest().replace("\nSELECT conv_id, turn, CASE WHEN", ", q AS (SELECT conv_id, turn, CASE WHEN", 1).replace("\nFROM raw", "\nFROM raw)", 1) + f""",
a AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS id FROM q WHERE reject_reason IS NULL),
c AS (SELECT conv_id + 1 AS n, conv_id % 6 AS k, conv_id FROM conversations WHERE turn = 0)
SELECT id, CASE c.k WHEN 0 THEN concat('edited ', CAST(c.n AS VARCHAR)) WHEN 2 THEN 'both' ELSE a.text END AS text, source, channel,
  severity_hint, user_tier, CASE c.k WHEN 2 THEN 'Praise' WHEN 5 THEN 'Security' ELSE {_kw_tag('a.text')} END AS tag,
  CASE WHEN c.k = 1 THEN (c.conv_id % 21 - 10) / 8.0::DOUBLE ELSE 0.0::DOUBLE END AS sentiment, 0.2::DOUBLE AS urgency_score, '' AS summary,
  CASE WHEN c.k = 4 THEN 'done' ELSE 'To Do' END AS status, {t0} + to_minutes(id) AS created_at,
  {t0} + to_minutes(id) + INTERVAL 30 SECOND AS analyzed_at,
  CASE WHEN c.n IS NOT NULL THEN {t0} + INTERVAL 30 DAY + to_seconds(c.n) ELSE {t0} + to_minutes(id) END AS updated_at
FROM a LEFT JOIN c ON c.n = a.id WHERE c.k IS NULL OR c.k <> 3"""


def _event_log_cte() -> str:
    nulls = {"text": "VARCHAR", "source": "VARCHAR", "channel": "VARCHAR", "severity_hint": "VARCHAR",
             "user_tier": "VARCHAR", "status": "VARCHAR", "tag": "VARCHAR", "sentiment": "DOUBLE",
             "urgency_score": "DOUBLE", "summary": "VARCHAR"}

    def row(seq, ts, op, id_, src, **vals):
        cols = ", ".join(vals.get(c, f"CAST(NULL AS {t})") + f" AS {c}" for c, t in nulls.items())
        return f"SELECT {seq} AS seq, {ts} AS event_ts, '{op}' AS op, {id_} AS id, {cols} FROM {src}"
    parts = [
        row("id * 8", "created_at", "insert", "id", "feedback", text="text", source="source", channel="channel",
            severity_hint="severity_hint", user_tier="user_tier", status="'To Do'"),
        row("id * 8 + 1", "analyzed_at", "analysis", "id", "feedback WHERE analyzed_at IS NOT NULL", tag="tag",
            sentiment="sentiment", urgency_score="urgency_score", summary="''"),
        row("id * 8 + 2", "updated_at", "patch", "id", "feedback WHERE status <> 'To Do'", status="status"),
        row("event_id * 8 + 3", "ts", "delete", "event_id", "events WHERE event_type = 'error'"),
        row("event_id * 8 + 4", "ts + INTERVAL 1 HOUR", "patch", "event_id // 2", "events WHERE event_type = 'click'",
            tag="'Praise'"),
        row("event_id * 8 + 5", "ts", "patch", "event_id + 1000000000000", "events WHERE event_type = 'signup'",
            status="'done'"),
        row("event_id * 8 + 6", "ts + INTERVAL 2 DAY", "patch", "event_id", "events WHERE event_type = 'view'"),
    ]
    return "ev AS (" + "\nUNION ALL ".join(parts) + ")"


def _snapshot() -> str:
    ev = _event_log_cte()
    writes = "op IN ('insert', 'patch', 'analysis')"
    cols = []
    for c in ["text", "source", "channel", "severity_hint", "user_tier", "tag", "sentiment", "urgency_score", "summary"]:
        cols.append(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL AND {writes}) AS {c}")
    cols.append(f"coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL AND {writes}), 'To Do') AS status")
    eff = "(op = 'insert' OR (op = 'patch' AND (status IS NOT NULL OR sentiment IS NOT NULL OR tag IS NOT NULL OR text IS NOT NULL)))"
    cols += ["arg_max(event_ts, seq) FILTER (WHERE op = 'insert') AS created_at",
             "arg_max(event_ts, seq) FILTER (WHERE op = 'analysis') AS analyzed_at",
             f"arg_max(event_ts, seq) FILTER (WHERE {eff}) AS updated_at"]
    return W(ev) + "SELECT id, " + ", ".join(cols) + """ FROM ev GROUP BY id
HAVING max(CASE WHEN op = 'insert' THEN 1 END) = 1 AND max(CASE WHEN op = 'delete' THEN 1 END) IS NULL"""


_FINGERPRINT = ("bit_xor(CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), coalesce(tag, '-'), "
                "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), coalesce(text, ''))), 1, 15) AS BIGINT))")


def _of_snapshot(sql: str) -> str:
    """``sql`` over the folded log as ``snap``."""
    body = _snapshot().replace("\nSELECT id,", ",\nsnap AS (SELECT id,", 1)
    return body + ")\n" + sql


def _stream_ingest() -> str:
    """Accepted requests with the keyword tag; ids are dense from 1, in any order."""
    return _ingest().replace("\nSELECT conv_id, turn, CASE WHEN", ", q AS (SELECT conv_id, turn, CASE WHEN", 1).replace("\nFROM raw", "\nFROM raw)", 1) + f""",
a AS (SELECT * FROM q WHERE reject_reason IS NULL)
SELECT text, source, channel, severity_hint, user_tier, {_kw_tag('a.text')} AS tag, 0.0::DOUBLE AS sentiment, 0.2::DOUBLE AS urgency_score, '' AS summary,
  'To Do' AS status, CAST(1 AS BIGINT) AS first_id, (SELECT count(*) FROM a) AS last_id, (SELECT count(*) FROM a) AS ids FROM a"""


def _digest_refresh() -> str:
    """Each day's digest from its rows before or after the changes, whichever a refresh leaves."""
    def lines(name, rows):
        return f"""{name} AS (SELECT date, concat(CAST(date AS VARCHAR), ': ', CAST(sum(len(string_split(line, chr(10)))) AS VARCHAR), ' items, ',
    CAST(sum(length(line)) + count(*) - 1 AS VARCHAR), ' characters') AS summary FROM (
  SELECT date, concat(CAST(row_number() OVER (PARTITION BY date ORDER BY created_at DESC, id DESC) AS VARCHAR), '. [',
    coalesce(nullif(tag, ''), 'Unknown'), '] ', coalesce(text, '')) AS line FROM {rows}) GROUP BY date)"""

    def state(name, rows):
        return f"{name} AS (SELECT date, count(*) AS count, {_FINGERPRINT} AS row_fingerprint FROM {rows} GROUP BY date)"
    now, old = f"{C.DIGEST_NOW:%Y-%m-%d %H:%M:%S}", f"{C.DIGEST_NOW - datetime.timedelta(hours=1):%Y-%m-%d %H:%M:%S}"
    return W("r0 AS (SELECT f.id, f.tag, f.text, f.created_at, e.event_type, CAST(f.created_at AS DATE) AS date, "
             "(CAST(f.created_at AS DATE) - DATE '1970-01-01') % 5 AS k FROM feedback f JOIN events e ON e.event_id = f.id)",
             "r1 AS (SELECT id, CASE WHEN k = 2 AND event_type = 'click' THEN 'Praise' ELSE tag END AS tag, text, created_at, date "
             "FROM r0 WHERE NOT (k = 1 AND event_type = 'error'))",
             state("s0", "r0"), state("s1", "r1"), lines("l0", "r0"), lines("l1", "r1"),
             "days AS (SELECT DISTINCT date, k FROM r0)",
             """stale AS (SELECT days.date, k IN (3, 4) OR s0.count IS DISTINCT FROM s1.count OR s0.row_fingerprint IS DISTINCT FROM s1.row_fingerprint AS stale
  FROM days LEFT JOIN s0 USING (date) LEFT JOIN s1 USING (date))""") + f"""
SELECT CAST(date AS VARCHAR) AS date,
  CASE WHEN NOT stale THEN l0.summary ELSE coalesce(l1.summary, 'No feedback received on ' || CAST(date AS VARCHAR) || '.') END AS summary,
  CASE WHEN NOT stale THEN s0.count ELSE coalesce(s1.count, 0) END AS count,
  CAST(CASE WHEN NOT stale THEN s0.row_fingerprint ELSE s1.row_fingerprint END AS VARCHAR) AS row_fingerprint,
  CASE WHEN stale THEN '{now}' ELSE '{old}' END AS generated_at
FROM stale LEFT JOIN s0 USING (date) LEFT JOIN s1 USING (date) LEFT JOIN l0 USING (date) LEFT JOIN l1 USING (date)
UNION ALL SELECT d, 'No feedback received on ' || d || '.', 0, NULL, '{now}'
FROM (SELECT CAST(CAST(max(date) + 1 AS DATE) AS VARCHAR) AS d FROM days)"""


# digest lines: number per creation day (newest first) and the weight of the
# day's earlier lines, which cuts a busy day into bounded prompts
_DIGEST_LINES = ("n AS (SELECT CAST(created_at AS DATE) AS date, tag, text, row_number() OVER ("
                 "PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC NULLS LAST, id DESC) AS line_no, "
                 f"coalesce(sum(length(coalesce(text, '')) + length(coalesce(nullif(tag, ''), 'Unknown')) "
                 "+ 25) OVER ("
                 "PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC NULLS LAST, id DESC "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_before FROM feedback), "
                 "l AS (SELECT date, line_no, concat(CAST(line_no AS VARCHAR), '. [', coalesce(nullif(tag, ''), 'Unknown'), "
                 "'] ', coalesce(text, '')) AS line, CAST(chars_before AS BIGINT) AS chars_before FROM n)")
def _lanes_sql(group: str) -> str:
    """T2 by brute force: a recursive replay of first-fit per group, in
    (start, duration, updated_at desc, id desc) order, keeping the list of
    lane end days; an item takes the first lane that ended before its start,
    else opens a new one."""
    return "WITH RECURSIVE " + ",\n".join((FEEDBACK_CTE, _intervals_cte(group), """items AS (
  SELECT iv.id, iv.group_key, iv.start_day, iv.end_day, row_number() OVER (PARTITION BY iv.group_key
    ORDER BY iv.start_day, iv.end_day - iv.start_day, f.updated_at DESC NULLS LAST, iv.id DESC) AS k
  FROM iv JOIN feedback f ON f.id = iv.id)""", """r(group_key, k, ends, id, lane) AS (
  SELECT group_key, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT group_key FROM items)
  UNION ALL
  SELECT r.group_key, r.k + 1,
    CASE WHEN p.pos = 0 THEN list_append(r.ends, i.end_day)
         ELSE list_concat(list_concat(r.ends[1:p.pos - 1], [i.end_day]), r.ends[p.pos + 1:]) END,
    i.id, CASE WHEN p.pos = 0 THEN len(r.ends) ELSE p.pos - 1 END
  FROM r JOIN items i ON i.group_key = r.group_key AND i.k = r.k + 1,
  LATERAL (SELECT coalesce(list_position(list_transform(r.ends, lambda e: e < i.start_day), true), 0) AS pos) p)""")) + """
SELECT r.id, r.group_key, i.start_day, i.end_day, i.end_day - i.start_day + 1 AS duration, r.lane
FROM r JOIN items i ON i.id = r.id WHERE r.id IS NOT NULL"""


_TOP_SEARCH = lambda q: W() + f"""SELECT {SRCH} FROM feedback
WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE {q}
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20"""  # noqa: E731

_PAGE_BASE = f"SELECT {LIB} FROM feedback WHERE status = 'done'"
_PAGE_ORDER = "coalesce(sentiment, 0) DESC, id DESC"

_BUCKET = "CASE WHEN sentiment >= 0.25 THEN 'positive' WHEN sentiment <= -0.25 THEN 'negative' ELSE 'neutral' END"

ORACLE: dict[str, str] = {
    "tag_counts": W() + "SELECT tag, count(*) AS count FROM feedback WHERE tag IS NOT NULL GROUP BY tag",
    "sentiment_counts": W() + f"SELECT {_BUCKET} AS sentiment_bucket, count(*) AS count FROM feedback WHERE sentiment IS NOT NULL GROUP BY 1",
    "status_timeline": W() + "SELECT CAST(CAST(updated_at AS DATE) AS VARCHAR) AS date, status, count(*) AS count FROM feedback GROUP BY 1, 2",
    "status_timeline_dense": W("c AS (SELECT CAST(updated_at AS DATE) AS date, status, count(*) AS n FROM feedback GROUP BY 1, 2)",
                               "d AS (SELECT DISTINCT date FROM c)",
                               "s AS (SELECT DISTINCT status FROM c)") +
    "SELECT CAST(d.date AS VARCHAR) AS date, s.status, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM d CROSS JOIN s "
    "LEFT JOIN c ON c.date IS NOT DISTINCT FROM d.date AND c.status IS NOT DISTINCT FROM s.status",
    "sentiment_by_tier": W() + "SELECT user_tier, sentiment FROM feedback WHERE sentiment IS NOT NULL",
    **{f"sentiment_by_dimension_{d}": W() + f"SELECT {_dim(d)} AS dimension, sentiment FROM feedback "
       f"WHERE {d} IS NOT NULL AND sentiment IS NOT NULL" for d in ("status", "tag", "channel")},
    "sentiment_boxplot_tier": _boxplot("user_tier"),
    "sentiment_boxplot_status": _boxplot("status"),
    "sentiment_boxplot_tag": _boxplot("tag"),
    "sentiment_boxplot_channel": _boxplot("channel"),
    "resolution_time": _resolution(False),
    "resolution_time_actionable": _resolution(True),
    "feedback_dates": W() + "SELECT CAST(date AS VARCHAR) AS date FROM (SELECT DISTINCT CAST(created_at AS DATE) AS date FROM feedback "
                            "ORDER BY date DESC NULLS LAST LIMIT 30)",
    "feedback_by_date": W() + f"SELECT {SRCH} FROM feedback WHERE CAST(created_at AS DATE) = DATE '{C.BY_DATE}'",
    "date_span": W() + """SELECT min(t) AS min_ts, max(t) AS max_ts,
  CAST(ceil((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000.0) + 1 AS BIGINT) AS days
FROM (SELECT coalesce(created_at, updated_at) AS t FROM feedback)""",
    "latest_feedback": W() + f"SELECT {LIB} FROM feedback ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 100",
    "latest_analyzed": W() + "SELECT id, text, tag, sentiment FROM feedback WHERE analyzed_at IS NOT NULL "
                             "ORDER BY analyzed_at DESC, id DESC LIMIT 25",
    "search_text": _TOP_SEARCH("concat('%c:', chr(92), 'temp%')"),
    "search_text_wildcard": _TOP_SEARCH("'%50%%'"),
    "search_lookup": W("""h AS (SELECT id FROM feedback
  WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE concat('%c:', chr(92), 'temp%')
  ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20)""") +
    "SELECT id, status, user_tier, updated_at FROM feedback WHERE id IN (SELECT id FROM h)",
    "urgency_impact": W() + "SELECT id, tag, urgency_score, abs(sentiment) AS impact, status, created_at FROM feedback "
                            "WHERE urgency_score IS NOT NULL ORDER BY urgency_score DESC, id DESC LIMIT 50",
    "filter_sort_page": W() + f"{_PAGE_BASE} ORDER BY {_PAGE_ORDER} LIMIT 10 OFFSET 20",
    "filter_sort_page_past_end": W(f"f AS (SELECT {LIB}, row_number() OVER (ORDER BY {_PAGE_ORDER}) - 1 AS pos FROM feedback WHERE status = 'done')",
                                   "n AS (SELECT greatest(CAST(ceil(count(*) / 10.0) AS BIGINT), 1) AS last FROM f)") +
    f"SELECT {LIB} FROM f, n WHERE pos >= (least({C.PAGE_PAST_END}, last) - 1) * 10 AND pos < (least({C.PAGE_PAST_END}, last) - 1) * 10 + 10",
    "page_count": W() + "SELECT CAST(greatest(ceil(count(*) / 10.0), 1) AS BIGINT) AS pages FROM feedback WHERE status = 'done'",
    "visible_columns": W() + """SELECT substr(strftime(created_at, '%Y-%m-%d %H:%M:%S'), 1, 16) AS "when", id,
  coalesce(nullif(user_tier, ''), 'unknown') AS tier, coalesce(nullif(channel, ''), '-') AS channel, status,
  CASE WHEN sentiment IS NULL THEN 'N/A' ELSE concat(CASE WHEN sentiment < 0 THEN '-' ELSE '' END, CAST(CAST(round(abs(sentiment) * 100) AS BIGINT) // 100 AS VARCHAR), '.',
       lpad(CAST(CAST(round(abs(sentiment) * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')) END AS sentiment FROM feedback""",
    "filter_sort_page_deep": W() + f"SELECT {LIB} FROM feedback WHERE user_tier = 'pro' ORDER BY created_at ASC NULLS FIRST, id ASC LIMIT 10 OFFSET 60",
    **{f"sort_{k}": W() + f"SELECT {LIB} FROM feedback WHERE channel = 'github' ORDER BY {o} LIMIT 10 OFFSET 10" for k, o in (
        ("updated_desc", "coalesce(updated_at, created_at) DESC NULLS LAST, id DESC"), ("updated_asc", "coalesce(updated_at, created_at) ASC NULLS FIRST, id ASC"),
        ("created_desc", "created_at DESC NULLS LAST, id DESC"), ("created_asc", "created_at ASC NULLS FIRST, id ASC"),
        ("negative_desc", "coalesce(sentiment, 0) ASC, id DESC"))},
    "filter_tier_channel_tag": W() + "SELECT id FROM feedback WHERE user_tier = 'free' AND channel = 'web' AND tag = 'Bug Report'",
    "filter_sentiment_class": W() + "SELECT id, sentiment FROM feedback WHERE coalesce(sentiment, 0) < -0.3",
    "filter_id": W() + "SELECT id, status, tag FROM feedback WHERE id = 42",
    "drill_down": W() + """SELECT f.id FROM feedback f, (SELECT status, tag, user_tier FROM feedback WHERE id = 42) p
WHERE (coalesce(p.status, '') = '' OR f.status = p.status) AND (coalesce(p.tag, '') = '' OR f.tag = p.tag)
  AND (coalesce(p.user_tier, '') = '' OR f.user_tier = p.user_tier)""",
    "stored_table": W() + """SELECT id, text, source, channel, severity_hint, user_tier, tag, sentiment, urgency_score, summary, status,
  created_at, analyzed_at, updated_at FROM feedback""",
    "stale_digest_state": W() + """SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS count, max(updated_at) AS max_updated_at
FROM feedback GROUP BY 1""",
    "timeline_intervals": W(_intervals_cte("status")) + "SELECT id, group_key, start_day, end_day, end_day - start_day + 1 AS duration FROM iv",
    "peak_concurrency": _peak("status"),
    "peak_concurrency_tier": _peak("tier"),
    "peak_concurrency_tag": _peak("tag"),
    "date_spine": W("s AS (SELECT min(coalesce(created_at, updated_at)) AS mi, max(coalesce(created_at, updated_at)) AS ma FROM feedback)") +
    """SELECT CAST(i AS BIGINT) AS day_index, CAST(CAST(CAST(mi AS DATE) + CAST(i AS INTEGER) AS DATE) AS VARCHAR) AS date
FROM (SELECT mi, unnest(generate_series(0, CAST(ceil((epoch_us(ma) - epoch_us(mi)) / 86400000000.0) AS BIGINT))) AS i FROM s)""",
    "keyword_classify": W() + f"SELECT id, {_kw_tag('text')} AS tag FROM feedback",
    "classify_pending": W() + f"SELECT id, {_kw_tag('text')} AS tag, CAST(0 AS DOUBLE) AS sentiment, "
                              "CAST(0.2 AS DOUBLE) AS urgency_score, '' AS summary FROM feedback WHERE analyzed_at IS NULL",
    "normalize_analysis": _normalize(),
    "snapshot_fold": _snapshot(),
    "stream_snapshot": _snapshot(),
    "stream_rollups": _of_snapshot(f"""SELECT 'tag_counts' AS rollup, tag AS key1, CAST(NULL AS VARCHAR) AS key2, count(*) AS count FROM snap WHERE tag IS NOT NULL GROUP BY tag
UNION ALL SELECT 'sentiment_counts', {_BUCKET}, NULL, count(*) FROM snap WHERE sentiment IS NOT NULL GROUP BY 2
UNION ALL SELECT 'status_timeline', CAST(CAST(updated_at AS DATE) AS VARCHAR), status, count(*) FROM snap GROUP BY 2, 3"""),
    "stream_digest_state": _of_snapshot(f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS date, count(*) AS count, {_FINGERPRINT} AS row_fingerprint FROM snap GROUP BY 1"),
    "stream_ingest": _stream_ingest(),
    "digest_refresh": _digest_refresh(),
    "result_output": W() + f"""SELECT 'tag' AS section, tag AS key, count(*) AS count FROM feedback WHERE tag IS NOT NULL GROUP BY tag
UNION ALL SELECT 'sentiment' AS section, {_BUCKET} AS key, count(*) AS count FROM feedback WHERE sentiment IS NOT NULL GROUP BY 2""",
    "ingest_feedback": _ingest(),
    "parse_changes": _changes(),
    "ingest_to_snapshot": _ingest_to_snapshot(),
    "similar_items": W("u AS (SELECT id FROM feedback WHERE urgency_score IS NOT NULL ORDER BY urgency_score DESC, id DESC LIMIT 50)",
                       "k AS (SELECT u.id AS point_id, f.status, f.tag, f.user_tier FROM u JOIN feedback f ON f.id = u.id)") +
    """SELECT k.point_id, f.id FROM k JOIN feedback f ON (coalesce(k.status, '') = '' OR f.status = k.status)
  AND (coalesce(k.tag, '') = '' OR f.tag = k.tag) AND (coalesce(k.user_tier, '') = '' OR f.user_tier = k.user_tier)""",
    "similar_classes": W("c AS (SELECT status, tag, user_tier, count(*) AS n FROM feedback GROUP BY ALL)",
                         """p AS (SELECT k.status, k.tag, k.user_tier, sum(c.n) AS n FROM (SELECT status, tag, user_tier FROM c) k
  JOIN c ON (coalesce(k.status, '') = '' OR c.status = k.status) AND (coalesce(k.tag, '') = '' OR c.tag = k.tag)
  AND (coalesce(k.user_tier, '') = '' OR c.user_tier = k.user_tier) GROUP BY ALL)""") +
    """SELECT f.id AS point_id, concat('{', array_to_string(list_filter([
    CASE WHEN coalesce(f.status, '') <> '' THEN concat('"status":"', f.status, '"') END, CASE WHEN coalesce(f.tag, '') <> '' THEN concat('"tag":"', f.tag, '"') END,
    CASE WHEN coalesce(f.user_tier, '') <> '' THEN concat('"user_tier":"', f.user_tier, '"') END], lambda x: x IS NOT NULL), ','), '}') AS point_class,
  CAST(p.n AS BIGINT) AS similar
FROM feedback f JOIN p ON f.status IS NOT DISTINCT FROM p.status AND f.tag IS NOT DISTINCT FROM p.tag AND f.user_tier IS NOT DISTINCT FROM p.user_tier""",
    "stakeholder_rollup": W() + """SELECT CASE WHEN user_tier IN ('free', 'pro', 'business', 'enterprise') THEN 'External'
  WHEN user_tier IN ('dev', 'developer', 'tester', 'team lead', 'manager') THEN 'Internal' ELSE 'Unknown' END AS stakeholder,
  coalesce(nullif(user_tier, ''), 'unknown') AS tier, count(*) AS count, round(avg(sentiment), 6) AS mean_sentiment
FROM feedback GROUP BY 1, 2""",
    "mood_bands": W() + """SELECT CASE WHEN sentiment IS NULL THEN 'unknown' WHEN sentiment < -0.2 THEN 'negative'
  WHEN sentiment <= 0.2 THEN 'neutral' ELSE 'positive' END AS band,
  CASE WHEN sentiment IS NULL THEN 'unknown' WHEN sentiment <= -0.6 THEN 'very_negative' WHEN sentiment < -0.2 THEN 'negative'
  WHEN sentiment > 0.6 THEN 'very_positive' WHEN sentiment > 0.2 THEN 'positive' ELSE 'neutral' END AS mood,
  count(*) AS count FROM feedback GROUP BY 1, 2""",
    "daily_digest_prompt": W(_DIGEST_LINES) +
    "SELECT CAST(date AS VARCHAR) AS date, CAST(line_no AS BIGINT) AS line_no, line, chars_before FROM l",
    "event_day_counts": W(_event_log_cte()) + "SELECT CAST(CAST(date_trunc('day', event_ts) AS DATE) AS VARCHAR) AS date, op, "
                                             "count(*) AS count FROM ev GROUP BY 1, 2",
    "summary_bundle": W() + f"""SELECT 'tag' AS section, tag AS key, count(*) AS count FROM feedback WHERE tag IS NOT NULL GROUP BY tag
UNION ALL SELECT 'sentiment' AS section, {_BUCKET} AS key, count(*) AS count FROM feedback WHERE sentiment IS NOT NULL GROUP BY 2""",
    "narrative_input": W() + """SELECT to_json(list({'text': text, 'tag': tag, 'sentiment': sentiment} ORDER BY analyzed_at DESC, id DESC)) AS input
FROM (SELECT id, text, tag, sentiment, analyzed_at FROM feedback WHERE analyzed_at IS NOT NULL ORDER BY analyzed_at DESC, id DESC LIMIT 25)""",
    "daily_digest": W(_DIGEST_LINES) +
    "SELECT CAST(date AS VARCHAR) AS date, concat(CAST(date AS VARCHAR), ': ', "
    "CAST(sum(len(string_split(line, chr(10)))) AS VARCHAR), ' items, ', CAST(sum(length(line)) + count(*) - 1 AS VARCHAR), ' characters') AS summary, "
    "count(*) AS count FROM l GROUP BY date",
    "status_timeline_wide": W() + """SELECT CAST(CAST(updated_at AS DATE) AS VARCHAR) AS date,
  count(*) FILTER (WHERE status = 'To Do') AS "To Do", count(*) FILTER (WHERE status = 'in progress') AS "in progress",
  count(*) FILTER (WHERE status = 'to be reviewed') AS "to be reviewed", count(*) FILTER (WHERE status = 'done') AS "done"
FROM feedback GROUP BY 1""",
    "sentiment_histogram_tier": W() + f"SELECT {_dim('user_tier')} AS dimension, sentiment, count(*) AS n FROM feedback "
                                      "WHERE user_tier IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1, 2",
    "keyset_page": W() + f"""SELECT {LIB} FROM feedback WHERE created_at < TIMESTAMP '{C.KEYSET_AFTER[0]}'
  OR (created_at = TIMESTAMP '{C.KEYSET_AFTER[0]}' AND id < {C.KEYSET_AFTER[1]})
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20""",
    "urgency_bubbles": W("u AS (SELECT id, urgency_score, abs(sentiment) AS impact FROM feedback WHERE urgency_score IS NOT NULL "
                         "ORDER BY urgency_score DESC, id DESC LIMIT 50)") +
    "SELECT id, coalesce(urgency_score, 0.0) * 100 AS x, coalesce(impact, 0.0) * 100 AS y, "
    "sqrt(CASE WHEN coalesce(impact, 0.0) = 0 THEN 1.0 ELSE impact END) * 8 AS r FROM u",
    "sentiment_slider": W() + """SELECT id, CAST(floor((sentiment + 1) / 2 * 100 + 0.5) AS BIGINT) AS pct,
  CASE WHEN sentiment <= -0.6 THEN 'very_negative' WHEN sentiment < -0.2 THEN 'negative'
       WHEN sentiment > 0.6 THEN 'very_positive' WHEN sentiment > 0.2 THEN 'positive' ELSE 'neutral' END AS mood,
  concat(CASE WHEN sentiment >= 0 THEN '+' ELSE '' END, printf('%.2f', sentiment)) AS value_text
FROM feedback WHERE sentiment IS NOT NULL""",
    "timeline_bar_labels": W() + f"""SELECT id, {_group_key("status")} AS group_key,
  concat('#', CAST(id AS VARCHAR), ' ', substring(coalesce(text, ''), 1, 20)) AS label,
  concat(coalesce(nullif(substring(coalesce(text, ''), 1, 100), ''), 'No text'), ' (ID: ', CAST(id AS VARCHAR), ', ',
         coalesce(status, 'null'), ')') AS tooltip
FROM feedback""",
    "sentiment_chart": W() + f"""SELECT concat(upper(substring(b, 1, 1)), substring(b, 2)) AS label, count(*) AS count
FROM (SELECT {_BUCKET} AS b FROM feedback WHERE sentiment IS NOT NULL) GROUP BY b""",
    "summary_payload": W() + f"""SELECT
  (SELECT to_json(list({{'tag': tag, 'count': count}} ORDER BY tag, count))
     FROM (SELECT tag, count(*) AS count FROM feedback WHERE tag IS NOT NULL GROUP BY tag)) AS tags,
  (SELECT to_json(list({{'sentiment_bucket': b, 'count': count}} ORDER BY b, count))
     FROM (SELECT {_BUCKET} AS b, count(*) AS count FROM feedback WHERE sentiment IS NOT NULL GROUP BY 1)) AS sentiment,
  (SELECT to_json(list({{'text': text, 'tag': tag, 'sentiment': sentiment}} ORDER BY analyzed_at DESC, id DESC))
     FROM (SELECT id, text, tag, sentiment, analyzed_at FROM feedback WHERE analyzed_at IS NOT NULL
           ORDER BY analyzed_at DESC, id DESC LIMIT 25)) AS narrative_input,
  strftime(TIMESTAMP '{C.SUMMARY_NOW:%Y-%m-%d %H:%M:%S}', '%Y-%m-%dT%H:%M:%S.000Z') AS generated_at""",
    "timeline_lanes": _lanes_sql("status"),
    "assign_ids_dense": f"""WITH {_INGEST_RAW},
t AS (SELECT conv_id, turn, {_trim("json_extract_string(value, '$.feedback')")} AS text FROM raw
  WHERE json_valid(value) AND json_type(value, '$.feedback') = 'VARCHAR')
SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) AS id FROM t WHERE text <> ''""",
    "similar_texts": """WITH x AS (SELECT label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS cen FROM (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos) GROUP BY label),
s AS (SELECT c.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.cen) AS score FROM embeddings e, c),
r AS (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT label, CAST(rank AS BIGINT) AS rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 10""",
}
