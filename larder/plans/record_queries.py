"""Registered queries over records: JSON envelopes, logs, identities, chats and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars as sc
from larder.functions import text as tx
from larder.operators import checks as ck
from larder.operators import conversations as cv
from larder.operators import escalation as es
from larder.operators import joins as jn
from larder.operators import model_quality as mq
from larder.operators import predicates as pr
from larder.operators import status as st
from larder.operators import windows as wn
from larder.plans import model as m
from larder.plans.registry import query
from larder.sources import envelopes as en

_NOW = "TIMESTAMP '2024-01-16 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")



def _json(**fields):
    return F.to_json(F.struct(*[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in fields.items()]))


# --- envelopes -------------------------------------------------------------------------------------


@query(
    "explode_event_envelopes",
    """SELECT user_id AS chat_id, event_id * 10 + 1 AS seq, 'TEXT_MESSAGE_CONTENT' AS type, 'm' || event_id AS message_id,
    event_type AS delta, NULL::VARCHAR AS name FROM events
    UNION ALL SELECT user_id, event_id * 10 + 2, 'TOOL_CALL_START', NULL, NULL, event_type FROM events""",
)
def _(spark, d):
    e = m.table(spark, d, "events")
    mid = F.concat(F.lit("m"), F.col("event_id").cast("string"))
    events = F.concat_ws(
        ",",
        F.lit('{"type":"RUN_STARTED"}'),
        _json(type="TEXT_MESSAGE_CONTENT", messageId=mid, delta=F.col("event_type"), role=F.lit(None).cast("string")),
        _json(type="TOOL_CALL_START", toolCallName=F.col("event_type")),
        F.lit('{"type":"RUN_FINISHED"}'),
    )
    body = F.concat(F.lit('{"events":['), events, F.lit("]}"))
    rows = e.select(F.col("user_id").alias("chat_id"), (F.col("event_id") * 10).alias("base_seq"), body.alias("body"))
    return en.explode_event_envelopes(rows).select("chat_id", "seq", "type", "message_id", "delta", "name")


@query(
    "manifest_to_rows",
    """SELECT o_orderkey AS id, CAST(0 AS INTEGER) AS row_number, o_orderstatus AS status, o_orderpriority AS second, NULL::VARCHAR AS missing FROM orders
    UNION ALL SELECT o_orderkey, 1, NULL, NULL, NULL FROM orders""",
)
def _(spark, d):
    o = m.table(spark, d, "orders")
    # "status" is named twice, and its last column counts; the second row is short.
    columns = '{"statement_response":{"manifest":{"schema":{"columns":[{"name":"status"},{"kind":"x"},{"name":"status"},{"name":"missing"}]}},'
    body = F.concat(
        F.lit(columns + '"result":{"data_array":[["first","'), F.col("o_orderpriority"), F.lit('","'), F.col("o_orderstatus"),
        F.lit('"],["'), F.col("o_custkey").cast("string"), F.lit('"]]}}}'),
    )
    rows = en.manifest_to_rows(o.select(F.col("o_orderkey").alias("id"), body.alias("body")))
    cell = {n: F.col("values")[k].alias(n) for n, k in (("status", "status"), ("second", "column_1"), ("missing", "missing"))}
    return rows.select("id", "row_number", *cell.values())


@query(
    "to_json_document",
    "SELECT 'orders' AS source, 'largest?' AS question, o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def _(spark, d):
    o = m.table(spark, d, "orders").select((-F.col("o_totalprice")).alias("rank_by"), "o_orderkey", "o_orderstatus")
    doc = en.to_json_document(o, "orders", "largest?", ["rank_by", "o_orderkey"], cap=50)
    schema = "source string, question string, rows array<struct<o_orderkey:bigint,o_orderstatus:string>>"
    parsed = doc.select(F.from_json("document", schema).alias("p"))
    return parsed.select("p.source", "p.question", F.explode("p.rows").alias("r")).select("source", "question", "r.*")


@query(
    "decode_payloads",
    """SELECT message_id AS message_uuid, CAST(chat_id AS VARCHAR) AS chat_id, role, content, true AS in_progress,
    CAST(seq AS VARCHAR) AS call_name, '' AS call_arguments FROM msg""",
)
def _(spark, d):
    call = F.array(F.struct(F.lit("t").alias("uuid"), F.col("seq").cast("string").alias("name"), F.lit(tx.PLACEHOLDER).alias("arguments")))
    rows = m.messages(spark, d)
    versions = rows.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    body = _json(
        v=F.col("v"), message_uuid=F.col("message_id"), chat_id=F.col("chat_id").cast("string"), role=F.col("role"),
        content=tx.add_placeholder("content"), tool_calls=call,
    )
    out = cv.decode_payloads(versions.select(body.alias("body")))
    return out.select(
        "message_uuid", "chat_id", "role", "content", "in_progress",
        F.col("tool_calls")[0]["name"].alias("call_name"), F.col("tool_calls")[0]["arguments"].alias("call_arguments"),
    )


# --- logs and text ---------------------------------------------------------------------------------

_LOG = "CASE event_type WHEN 'view' THEN 'GET /health 200' WHEN 'click' THEN 'POST /health 200' ELSE 'GET /chat 200' END"


@query("drop_health_checks", f"SELECT event_id, {_LOG} AS message FROM events WHERE event_type <> 'view'")
def _(spark, d):
    e = F.col("event_type")
    line = sc.case([(e == "view", "GET /health 200"), (e == "click", "POST /health 200")], "GET /chat 200")
    return pr.drop_health_checks(m.table(spark, d, "events").select("event_id", line.alias("message")))


@query(
    "redact_logs",
    """SELECT event_id, 'login {"access_token": "[REDACTED]", "n": ' || event_id || '} refresh_token=[REDACTED], ' || props AS message,
    '{"refresh_token": "[REDACTED]", "k": "' || event_type || '"}' AS extra FROM events""",
)
def _(spark, d):
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    logs = m.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit('login {"access_token": "s'), n, F.lit('", "n": '), n, F.lit("} refresh_token=r"), n, F.lit(", "), "props").alias("message"),
        F.concat(F.lit('{"refresh_token": "'), kind, F.lit('", "k": "'), kind, F.lit('"}')).alias("extra"),
    )
    return ck.redact_logs(logs, extras="extra")


@query(
    "record_functions",
    """SELECT event_id, 'kind=' || event_type || ' | user=' || user_id AS extras,
    CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS first_text, ts + INTERVAL 1 HOUR - INTERVAL 60 SECOND < """
    + _NOW
    + """ AS expired, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS stripped,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""",
)
def _(spark, d):
    e = F.col("event_type")
    extras = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), e)
    body = F.when(e == "view", F.lit('{"content": " "}')).when(e == "click", _json(content=F.lit(""), text=e)).otherwise(_json(content=e))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    shown = F.date_format(F.to_utc_timestamp(tx.parse_iso(iso), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return m.table(spark, d, "events").select(
        "event_id",
        tx.extras_text(extras).alias("extras"),
        tx.first_text(body).alias("first_text"),
        sc.is_expired(F.expr("ts + INTERVAL 1 HOUR"), _now(), 60).alias("expired"),
        tx.strip_placeholder(F.when(e == "error", F.lit(tx.PLACEHOLDER)).otherwise(e)).alias("stripped"),
        shown.alias("parsed"),
    )


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21)"


@query(
    "uuid_functions",
    f"""SELECT c_custkey, greatest(1, CAST('0x' || substr(s, 1, 8) AS BIGINT) & 2147483647) AS synthetic,
    CASE WHEN c_custkey % 2 = 0 THEN substr(h, 1, 24) ELSE substr(s, 1, 24) END AS participant, {_UUID} AS uuid
    FROM (SELECT c_custkey, md5(c_name) AS h, sha256(unhex(md5(c_name))) AS s FROM customer)""",
)
def _(spark, d):
    h = F.md5("c_name")
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    rows = m.table(spark, d, "customer").select("c_custkey", h.alias("h"), F.concat_ws("-", *parts).alias("uuid"))
    raw = F.when(sc.pmod("c_custkey", 2) == 0, F.concat(F.lit(" "), F.upper(F.substring("h", 1, 24)))).otherwise(F.lit("no id"))
    return rows.select(
        "c_custkey", tx.synthetic_id("uuid").alias("synthetic"), tx.participant_id(raw, "uuid").alias("participant"), "uuid"
    )


# --- users and identities --------------------------------------------------------------------------


@query(
    "find_user",
    "SELECT c_custkey AS id, c_name AS uuid, c_mktsegment AS email FROM customer WHERE c_custkey = 77 OR c_name = 'Customer#000000012' ORDER BY 1 LIMIT 1",
)
def _(spark, d):
    users = m.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("uuid"), F.col("c_mktsegment").alias("email")
    )
    return pr.find_user(users, id=77, uuid="Customer#000000012")


def _identities(spark, d):
    """Customers as identities; the first letter of the segment is the provider."""
    return m.table(spark, d, "customer").select(
        F.col("c_custkey").alias("provider_user_id"), F.lit("oauth").alias("provider_type"),
        F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("access_token"),
        F.when(F.col("c_acctbal") > 0, F.expr("timestampadd(HOUR, cast(c_custkey % 720 as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')")).alias("access_token_expires_at"),
    )


_IDENTITY = """SELECT c_custkey AS provider_user_id, 'oauth' AS provider_type, c_nationkey AS user_id, c_mktsegment AS access_token,
    CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 720 AS INTEGER)) END AS access_token_expires_at
    FROM customer"""


@query(
    "upsert_identities",
    f"""SELECT coalesce(b.provider_user_id, u.k) AS provider_user_id, coalesce(b.provider_type, 'oauth') AS provider_type,
    b.user_id, coalesce(u.token, b.access_token) AS access_token, b.access_token_expires_at
    FROM ({_IDENTITY}) b FULL JOIN (SELECT o_custkey * 2 AS k, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'F') AS token
        FROM orders GROUP BY 1) u ON u.k = b.provider_user_id""",
)
def _(spark, d):
    o = m.table(spark, d, "orders")
    updates = o.select(
        (F.col("o_custkey") * 2).alias("provider_user_id"), F.lit("oauth").alias("provider_type"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("access_token"), F.col("o_orderkey").alias("seq"),
    )
    return cv.upsert_identities(_identities(spark, d), updates)


@query("identity_by_external", f"SELECT * FROM ({_IDENTITY}) WHERE provider_type = 'oauth' AND provider_user_id = 42")
def _(spark, d):
    return cv.identity_by_external(_identities(spark, d), "oauth", 42)


@query("expired_tokens", f"SELECT * FROM ({_IDENTITY}) WHERE access_token_expires_at - INTERVAL 60 SECOND < {_NOW}")
def _(spark, d):
    return cv.expired_tokens(_identities(spark, d), _now())


@query(
    "apply_partial",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large ' || p_name ELSE p_name END AS p_name, p_brand,
    CASE WHEN p_size > 25 THEN p_size * 2 ELSE p_size END AS p_size FROM part""",
)
def _(spark, d):
    base = m.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    large = F.col("p_size") > 25
    updates = base.select(
        "p_partkey", F.when(large, F.concat(F.lit("large "), "p_name")).alias("p_name"), F.when(large, F.col("p_size") * 2).alias("p_size")
    )
    return cv.apply_partial(base, updates, "p_partkey")


# --- chats -----------------------------------------------------------------------------------------


@query(
    "nest_children",
    """SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, seq) - 1 AS messages_position, message_id, role FROM msg
    UNION ALL SELECT chat_id, NULL, NULL, NULL FROM cht WHERE chat_id < 0""",
)
def _(spark, d):
    chats = m.chats(spark, d).select("chat_id")
    children = m.messages(spark, d).select("chat_id", "created_at", "seq", "message_id", "role")
    nested = jn.nest_children(chats, children, "chat_id", ["created_at", "seq"], "messages")
    return nested.select("chat_id", "messages_position", "messages.message_id", "messages.role")


@query(
    "latest_open",
    "SELECT chat_id, message_id, seq FROM msg WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) = 1",
)
def _(spark, d):
    rows = m.messages(spark, d).withColumn("in_progress", F.col("role") == "user")
    return wn.latest_open(rows, "chat_id", ["seq"]).select("chat_id", "message_id", "seq")


@query(
    "attach_tool_results",
    """SELECT a.chat_id, a.message_id, a.role, 'tool-invocation' AS part, u.message_id AS tool_call_id,
        CASE WHEN u.content IS NULL THEN 'call' ELSE 'result' END AS state, u.content AS text
    FROM msg a LEFT JOIN msg u ON u.chat_id = a.chat_id AND u.seq = a.seq + 1 AND u.role = 'user' WHERE a.role = 'assistant' AND u.message_id IS NOT NULL
    UNION ALL SELECT a.chat_id, a.message_id, a.role, 'tool-invocation', 'm-' || a.chat_id || '-' || (a.seq + 1), 'call', NULL
    FROM msg a ANTI JOIN (SELECT chat_id, seq FROM msg WHERE role = 'user') u ON u.chat_id = a.chat_id AND u.seq = a.seq + 1 WHERE a.role = 'assistant'
    UNION ALL SELECT u.chat_id, u.message_id, CASE WHEN u.role = 'user' THEN 'tool' ELSE u.role END, 'text', NULL, NULL, u.content
    FROM msg u ANTI JOIN (SELECT chat_id, seq FROM msg WHERE role = 'assistant') a ON a.chat_id = u.chat_id AND a.seq + 1 = u.seq AND u.role = 'user'
    WHERE u.role <> 'assistant'""",
)
def _(spark, d):
    """Each assistant turn calls a tool whose id is that of the next turn; user turns are tool results."""
    rows = m.messages(spark, d)
    answer = F.col("role") == "assistant"
    call = F.struct(
        F.concat_ws("-", F.lit("m"), "chat_id", (F.col("seq") + 1).cast("string")).alias("id"), F.lit("lookup").alias("name"), F.lit("{}").alias("arguments")
    )
    history = rows.select(
        "chat_id", F.col("message_id").alias("id"), F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        "seq", F.when(~answer, F.col("content")).alias("content"), F.when(answer, F.array(call)).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>")).alias("tool_calls"),
    )
    # Every result comes twice; the later one counts.
    early = history.filter(F.col("role") == "tool").withColumns({"seq": F.col("seq") - 1, "content": F.lit("early")})
    called = early.join(history.select("chat_id", F.explode("tool_calls.id").alias("id")), ["chat_id", "id"], "left_semi")
    history = history.unionByName(called.select(*history.columns))
    return cv.attach_tool_results(history).select("chat_id", "message_id", "role", "part", "tool_call_id", "state", "text")


@query(
    "delete_chats",
    """SELECT 'chats' AS table_name, count(*) AS rows FROM cht ANTI JOIN (SELECT DISTINCT chat_id FROM msg WHERE role = 'system') s USING (chat_id)
    UNION ALL SELECT 'messages', count(*) FROM msg ANTI JOIN (SELECT DISTINCT chat_id FROM msg WHERE role = 'system') s USING (chat_id)
    UNION ALL SELECT 'tool_calls', count(*) FROM (SELECT * FROM msg WHERE role = 'assistant') t ANTI JOIN (SELECT DISTINCT chat_id FROM msg WHERE role = 'system') s USING (chat_id)""",
)
def _(spark, d):
    rows = m.messages(spark, d).withColumnRenamed("message_id", "message_uuid")
    gone = rows.filter(F.col("role") == "system").select("chat_id")
    calls = rows.filter(F.col("role") == "assistant").select("message_uuid", F.lit("lookup").alias("name"))
    left = cv.delete_chats(gone, m.chats(spark, d), rows, tool_calls=calls)
    out = None
    for name, df in left.items():
        line = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = line if out is None else out.unionByName(line)
    return out


# --- rules, evaluation, provenance, alerts ---------------------------------------------------------

_FAMILIES = [f"MED-STOCK-{c[2]}" for c in m.COMMODITIES] + ["MED-STOCK-GENERAL"]


@query(
    "rules_for",
    f"""SELECT p.location_id, p.item_id, r.policy_reference_id, r.section_id, r.document
    FROM (SELECT location_id, item_id, policy_reference_id FROM prs JOIN (SELECT item_id, policy_reference_id FROM itm) i USING (item_id)) p
    JOIN (SELECT [{", ".join(f"'{f}'" for f in _FAMILIES)}][CAST(item_id % 7 AS INTEGER) + 1] AS policy_reference_id,
        CAST(item_id AS VARCHAR) AS section_id, text AS document FROM benchmark) r
    ON r.policy_reference_id IN (p.policy_reference_id, 'MED-STOCK-GENERAL')""",
)
def _(spark, d):
    """The benchmark passages as rule sections of the six families and the general ones."""
    position = jn.enrich(m.pairs(spark, d).select(*m.LEDGER_KEYS), m.items(spark), "item_id", ["policy_reference_id"])
    sections = m.table(spark, d, "benchmark").select(
        F.col("text").alias("document"), F.lit("file").alias("document_file_path"),
        sc.pick(_FAMILIES, F.col("item_id")).alias("policy_reference_id"), F.lit("title").alias("policy_title"),
        F.col("item_id").cast("string").alias("section_id"), F.lit("a").alias("authority"), F.lit(m.AS_OF).alias("effective_date"),
    )
    return es.rules_for(position, sections).select(*m.LEDGER_KEYS, "policy_reference_id", "section_id", "document")


@query(
    "eval_summary",
    """SELECT metric, count(*) AS rows, count(*) FILTER (answer = '') AS rows_with_missing_field, count(value) AS scored, avg(value) AS mean
    FROM (SELECT CASE WHEN lang = 'en' THEN '' ELSE text END AS answer, UNNEST([{'metric': 'quality', 'value': CAST(quality AS DOUBLE)},
        {'metric': 'toxic', 'value': CAST(toxic AS DOUBLE)}], recursive := true) FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""",
)
def _(spark, d):
    rows = m.table(spark, d, "documents").join(m.table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("question"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("text")).alias("answer"), "quality", "toxic",
    )
    return mq.eval_summary(rows, ["quality", "toxic"])


@query(
    "provenance_check",
    """SELECT count(*) AS metrics, count(*) FILTER (url IS NULL OR NOT regexp_matches(url, '^https?://')) AS without_source,
    count(*) FILTER (page_id % 2 = 1) AS synthetic FROM pages""",
)
def _(spark, d):
    pages = m.table(spark, d, "pages").select(F.col("url").alias("source_url"), (sc.pmod("page_id", 2) == 1).alias("made"))
    return ck.provenance_check(pages, "made")


@query(
    "status_changes",
    """SELECT location_id, item_id, snapshot_date, CASE WHEN b THEN 'BELOW_MINIMUM' ELSE 'RECOVERED' END AS alert
    FROM (SELECT *, days_of_supply < minimum_days_supply AS b, lag(days_of_supply < minimum_days_supply, 1, false)
        OVER (PARTITION BY location_id, item_id ORDER BY snapshot_date) AS a FROM inv) WHERE a <> b""",
)
def _(spark, d):
    below = F.col("days_of_supply") < F.col("minimum_days_supply")
    out = st.status_changes(m.inventory(spark, d), m.LEDGER_KEYS, "snapshot_date", below)
    return out.select(*m.LEDGER_KEYS, "snapshot_date", "alert")
