"""Registered queries: each applies a library operator to whole test tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.operators import metrics, sessions
from tallywood.plans import cards_sql, facts_sql, redaction_sql
from tallywood.sources.staging import spread, staged

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    source = F.when(F.col("conv_id") % 2 == 0, "codex").otherwise("claude_code")
    return sessions.human_messages(c.select(source.alias("source"), F.col("conv_id").alias("session"), "role", "text", F.col("turn").alias("ordinal")))


M = r"""WITH m AS (
  SELECT CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'claude_code' END AS source, conv_id AS session, role,
    regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, turn AS ordinal
  FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S'))"""
C = M + """, c AS (
  SELECT source, session, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_count,
    count(*) FILTER (role = 'assistant') AS assistant_count, min(ordinal) AS first_ordinal
  FROM m GROUP BY source, session HAVING count(*) FILTER (role = 'user') > 0)"""


@query(C + " SELECT source, session, message_count, user_count, assistant_count, first_ordinal, user_count AS turn_count FROM c")
def session_turns(spark, sf):
    return sessions.counts(messages(spark, sf))


@query(C + """ SELECT count(user_count) AS sample_size, quantile_disc(user_count, 0.5)::BIGINT AS p50, quantile_disc(user_count, 0.95)::BIGINT AS p95,
  avg(user_count)::DOUBLE AS mean, max(user_count)::BIGINT AS max FROM c""")
def turns_distribution(spark, sf):
    return metrics.distribution(sessions.counts(messages(spark, sf)), [], "turn_count")


@query("SELECT role, count(*) AS messages FROM conversations GROUP BY role")
def role_message_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("messages"))


@query(C + """ SELECT source, count(*) AS session_count, sum(message_count)::BIGINT AS message_count, sum(user_count)::BIGINT AS turn_count,
  sum(assistant_count)::BIGINT AS assistant_count, quantile_disc(user_count, 0.95)::BIGINT AS p95 FROM c GROUP BY GROUPING SETS ((source), ())""")
def metric_set_by_source(spark, sf):
    total = lambda c: F.sum(c).cast("long").alias(c)
    return metrics.by_source_and_overall(sessions.counts(messages(spark, sf)), "source", F.count("*").alias("session_count"), total("message_count"), total("turn_count"), total("assistant_count"), wanted={"p95": ("turn_count", 0.95)})


@query("""SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max
  FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def metric_set_overall_by_group(spark, sf):
    return metrics.by_source_and_overall(table(spark, sf, "events"), "event_type", F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.max("value").alias("max"), wanted=metrics.halves("value"))


@query("""SELECT event_type, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS active_days, count(DISTINCT strftime(ts, '%Y-%m')) AS active_months FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def active_days_months(spark, sf):
    return metrics.by_source_and_overall(table(spark, sf, "events"), "event_type", *metrics.active_days("ts"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(min(ts)) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS earliest_at,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(max(ts)) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS latest_at FROM events GROUP BY user_id""")
def activity_range(spark, sf):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf, "events").groupBy("user_id").agg(iso(F.min("ts")).alias("earliest_at"), iso(F.max("ts")).alias("latest_at"))


def usage_rows(spark, sf):
    """Events as usage records, increments and, of three users in four, running totals; fields are missing here and there."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        "user_id",
        ((F.col("event_id") % 7 == 0) & (F.col("user_id") % 4 != 0)).alias("cumulative"),
        F.when(F.col("event_id") % 3 != 0, F.col("k")).alias("input"),
        F.when(F.col("event_id") % 5 != 0, F.col("k") + 1).alias("output"),
        F.when(F.col("event_id") % 2 == 0, 2 * F.col("k") + 1).alias("total"),
    )


U = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT user_id, event_id % 7 = 0 AND user_id % 4 <> 0 AS cumulative, CASE WHEN event_id % 3 <> 0 THEN k END AS input,
  CASE WHEN event_id % 5 <> 0 THEN k + 1 END AS output, CASE WHEN event_id % 2 = 0 THEN 2 * k + 1 END AS total FROM e),
u AS (SELECT user_id,
  coalesce(max(input) FILTER (cumulative), sum(input) FILTER (NOT cumulative))::BIGINT AS input,
  coalesce(max(output) FILTER (cumulative), sum(output) FILTER (NOT cumulative))::BIGINT AS output,
  coalesce(max(total) FILTER (cumulative), sum(total) FILTER (NOT cumulative))::BIGINT AS total FROM r GROUP BY user_id)"""


@query(U + " SELECT * FROM u")
def usage_incremental_vs_cumulative(spark, sf):
    return metrics.usage(usage_rows(spark, sf), "user_id")


@query(U + """ SELECT count(*) AS session_count, count(input) AS with_input, count(output) AS with_output, count(*) FILTER (input IS NOT NULL AND output IS NOT NULL) AS with_total FROM u""")
def token_coverage(spark, sf):
    return metrics.usage(usage_rows(spark, sf), "user_id").agg(*metrics.coverage())


@query(U + """ SELECT sum(input)::BIGINT AS input_tokens, sum(output)::BIGINT AS output_tokens, sum(input + output)::BIGINT AS total_tokens FROM u WHERE input IS NOT NULL AND output IS NOT NULL""")
def token_conditional_sum(spark, sf):
    u = metrics.usage(usage_rows(spark, sf), "user_id")
    return u.agg(F.sum(metrics.complete("input")).alias("input_tokens"), F.sum(metrics.complete("output")).alias("output_tokens"), F.sum(F.when(metrics.complete(), F.col("input") + F.col("output"))).alias("total_tokens"))


@query(U + " SELECT count(*) FILTER (total <> input + output) AS mismatches FROM u")
def token_arithmetic_mismatch(spark, sf):
    return metrics.usage(usage_rows(spark, sf), "user_id").agg(metrics.mismatches())


@query("""SELECT event_type, count(*) AS parsed, count(*) FILTER (event_type IN ('click', 'purchase') OR value > 50) AS recognized, count(*) FILTER (NOT json_valid(props)) AS malformed FROM events GROUP BY event_type""")
def recognized_record_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("parsed"), F.count_if(F.col("event_type").isin("click", "purchase") | (F.col("value") > 50)).alias("recognized"), F.count_if(F.try_parse_json("props").isNull()).alias("malformed"))


@query("""SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def record_json_projection(spark, sf):
    from tallywood.operators.records import numeric, text_field

    v = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return v.select("event_id", numeric("v", "$.k").cast("long").alias("k"), text_field("v", "$.missing").alias("missing"))


@query("""SELECT event_id, (epoch_us(ts) // 1000) AS from_millis, ((epoch_us(ts) // 1000) // 1000) * 1000 AS from_seconds, (epoch_us(ts) // 1000) AS from_text FROM events""")
def epoch_timestamp_normalize(spark, sf):
    from tallywood.operators.records import epoch_millis

    e = table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    v = e.select("event_id", F.to_variant_object(F.struct(F.col("ms").alias("a"), F.expr("ms div 1000").alias("b"), F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("c"))).alias("v"))
    return v.select("event_id", epoch_millis("v", "$.a").alias("from_millis"), epoch_millis("v", "$.b").alias("from_seconds"), epoch_millis("v", "$.c").alias("from_text"))


@query(M + " SELECT source, session, min(ordinal) AS first_ordinal, arg_min(text, ordinal) AS first_text, max(ordinal) AS last_ordinal, arg_max(text, ordinal) AS last_text FROM m WHERE role = 'user' GROUP BY source, session")
def first_last_user_message(spark, sf):
    return sessions.edges(messages(spark, sf))


N = M + """, n AS (SELECT *, CASE WHEN lag(role) OVER w = 'assistant' THEN lag(ordinal) OVER w END AS before,
  CASE WHEN lead(role) OVER w = 'assistant' THEN lead(ordinal) OVER w END AS after FROM m WINDOW w AS (PARTITION BY source, session ORDER BY ordinal))"""


@query(N + " SELECT source, session, ordinal, before, after FROM n WHERE role = 'user'")
def message_neighbours(spark, sf):
    return sessions.neighbours(messages(spark, sf)).select("source", "session", "ordinal", "before", "after")


@query(M + " SELECT source, session, ordinal, (SELECT min(a.ordinal) FROM m a WHERE a.session = m.session AND a.role = 'assistant' AND a.ordinal > m.ordinal) AS reply FROM m WHERE role = 'user'")
def assistant_after_user(spark, sf):
    return sessions.assistant_after(messages(spark, sf)).select("source", "session", "ordinal", "reply")


@query(N + """, b AS (SELECT *, min(ordinal) OVER (PARTITION BY session) AS lo, max(ordinal) OVER (PARTITION BY session) AS hi FROM n WHERE role = 'user'),
 s AS (SELECT source, session, ordinal, ((before IS NOT NULL)::BIGINT + (after IS NOT NULL)::BIGINT) AS completeness, length(text)::BIGINT AS length FROM b WHERE ordinal > lo AND ordinal < hi)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY completeness DESC, length DESC, ordinal) = 1""")
def best_middle_turn(spark, sf):
    return sessions.best_middle(messages(spark, sf)).select("source", "session", "ordinal", "completeness", "length")


@query(M + """, f AS (SELECT *, ordinal % 3 = 0 AS is_fallback FROM m),
 g AS (SELECT *, bool_or(NOT is_fallback) OVER (PARTITION BY source, session, role) AS p FROM f)
SELECT source, session, role, text, ordinal, is_fallback FROM g WHERE NOT is_fallback OR (source = 'codex' AND NOT p)""")
def canonical_role_fallback(spark, sf):
    return sessions.canonical(messages(spark, sf).withColumn("is_fallback", F.col("ordinal") % 3 == 0))


@query(C + " SELECT source, session, user_count, (row_number() OVER (PARTITION BY source ORDER BY first_ordinal, session) - 1) AS session_order FROM c")
def session_order(spark, sf):
    return sessions.order(sessions.counts(messages(spark, sf))).select("source", "session", "user_count", "session_order")


@query(M + r""", e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS r FROM m WHERE role = 'user')
SELECT source, session, list(regexp_replace(substr(text, 1, 600), '\s+$', '') ORDER BY ordinal) AS evidence FROM e WHERE r <= 3 GROUP BY source, session""")
def evidence_first_three(spark, sf):
    from tallywood.operators.topics import first_segments

    return first_segments(messages(spark, sf).filter(sessions.is_user()))


def records_a(spark, sf):
    """Conversations as records of dialect A: every third turn is an event, some others are of an unknown type."""
    c = table(spark, sf, "conversations")
    at, sid = (F.lit(1_700_000_000) + F.col("turn")).alias("timestamp"), F.concat(F.lit("c-"), "conv_id").alias("session_id")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(part("input_text", F.col("text")), part("image", F.lit("x")))
    item = F.struct(F.when(F.col("conv_id") % 7 == 3, "turn_context").otherwise("response_item").alias("type"), at, sid, F.struct(F.lit("message").alias("type"), "role", content.alias("content")).alias("payload"))
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("token_count")
    used = F.struct(F.struct((F.col("turn") * 10).alias("input_tokens"), F.lit(2).alias("output_tokens")).alias("total_token_usage"))
    event = F.struct(F.lit("event_msg").alias("type"), at, sid, F.struct(kind.alias("type"), F.col("text").alias("message"), used.alias("info")).alias("payload"))
    v = F.when(F.col("turn") % 3 == 0, F.to_variant_object(event)).otherwise(F.to_variant_object(item))
    return c.select(F.lit("codex").alias("source"), F.lit("a.jsonl").alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), v.alias("v"))


@query(r"""WITH r AS (SELECT conv_id * 1000 + turn AS ordinal, 'c-' || conv_id AS explicit, turn, text, turn % 3 = 0 AS is_fallback,
    CASE WHEN turn % 3 <> 0 OR role IN ('user', 'assistant') THEN role END AS role, turn % 3 = 0 AND role NOT IN ('user', 'assistant') AS counted
  FROM conversations WHERE turn % 3 = 0 OR conv_id % 7 <> 3),
t AS (SELECT *, CASE WHEN role IS NULL THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS said FROM r),
m AS (SELECT *, coalesce(role IN ('user', 'assistant') AND said <> '', false) AS message FROM t)
SELECT ordinal, explicit, (1700000000 + turn) * 1000 AS ts, role, said AS text, message, is_fallback, CASE WHEN counted THEN turn * 10 END::DOUBLE AS input, CASE WHEN counted THEN 2 END::DOUBLE AS output,
  message OR counted AS recognized FROM m""")
def dialect_a_records(spark, sf):
    from tallywood.operators.records import dialect_a

    r = dialect_a(records_a(spark, sf))
    return r.select("ordinal", "explicit", "ts", "role", "text", "message", "is_fallback", F.expr("get(usages, 0).input").alias("input"), F.expr("get(usages, 0).output").alias("output"), "recognized")


def records_b(spark, sf):
    """Conversations as records of dialect B: system turns are summaries, every fifth conversation is a side chain."""
    c = table(spark, sf, "conversations")
    tool = F.when(F.col("turn") % 2 == 1, "tool_use").otherwise("thinking")
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(tool.alias("type"), F.lit("hidden").alias("text")))
    used = F.struct((F.col("turn") + 1).alias("input_tokens"), F.lit(2).alias("output_tokens"))
    message = F.struct("role", F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), used.alias("usage"), content.alias("content"))
    kind = F.when(F.col("role") == "system", "summary").otherwise(F.col("role"))
    whole = F.struct(kind.alias("type"), F.concat(F.lit("c-"), "conv_id").alias("sessionId"), (F.col("conv_id") % 5 == 0).alias("isSidechain"), (F.lit(1_700_000_000_000) + F.col("turn") * 1000).alias("timestamp"), message.alias("message"))
    return c.select(F.lit("claude_code").alias("source"), F.lit("b.jsonl").alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.to_variant_object(whole).alias("v"))


B = r"""WITH r AS (SELECT conv_id * 1000 + turn AS ordinal, 'c-' || conv_id AS explicit, 1700000000000 + turn * 1000 AS ts, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
  (role = 'assistant' AND turn % 2 = 1)::INT AS tools, 'm' || (conv_id % 3) AS model, turn + 1 AS input, 2 AS output FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 5 <> 0)"""


@query(B + " SELECT ordinal, explicit, ts, role, text, tools, model, input::DOUBLE AS input, output::DOUBLE AS output, text <> '' AS message, true AS recognized FROM r")
def dialect_b_records(spark, sf):
    from tallywood.operators.records import dialect_b

    r = dialect_b(records_b(spark, sf))
    return r.select("ordinal", "explicit", "ts", "role", "text", "tools", F.array_join("models", ",").alias("model"), F.expr("usages[0].input").alias("input"), F.expr("usages[0].output").alias("output"), "message", "recognized")


S = B + r""", s AS (SELECT explicit AS session, count(*) FILTER (text <> '') AS message_count, count(*) FILTER (text <> '' AND role = 'user') AS user_count, sum(tools)::BIGINT AS tool_count,
  CASE WHEN count(*) < 2 THEN 0 ELSE max(ts) - min(ts) END AS elapsed, strftime(make_timestamp(min(ts) * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS started_at, any_value(model) AS models,
  sum(input)::DOUBLE AS input, sum(output)::DOUBLE AS output, min(ordinal) AS first_ordinal FROM r GROUP BY explicit HAVING count(*) FILTER (text <> '' AND role = 'user') > 0)"""


def session_table(spark, sf):
    from tallywood.operators import facts

    rows = staged(facts.normalized(records_b(spark, sf)), "rows")
    return rows, facts.session_rows(rows, facts.message_rows(rows), ["codex", "claude_code"])


@query(S + " SELECT *, row_number() OVER (ORDER BY first_ordinal) - 1 AS session_order FROM s")
def session_facts(spark, sf):
    found = session_table(spark, sf)[1]
    return found.select("session", "message_count", "user_count", "tool_count", "elapsed", "started_at", F.array_join("models", ",").alias("models"), "input", "output", "first_ordinal", "session_order")


@query(S + """ SELECT 'claude_code' AS source, count(*) AS sessions, sum(message_count)::BIGINT AS messages, sum(user_count)::BIGINT AS turns, sum(tool_count)::BIGINT AS tools, sum(input)::BIGINT AS input_tokens,
  (sum(input) + sum(output))::BIGINT AS total_tokens, quantile_disc(user_count, 0.95)::BIGINT AS turns_p95, (SELECT count(*) FROM conversations) AS parsed, (SELECT count(*) FROM r) AS recognized FROM s""")
def metric_set_document(spark, sf):
    from tallywood.operators import facts

    raw = records_b(spark, sf)
    rows, found = session_table(spark, sf)
    files = raw.select("source", "path").distinct().withColumn("bytes", F.lit(1))
    m = facts.metric_sets(files, raw, rows, staged(found, "sessions"), {})["claude_code"]
    row = ("claude_code", m["sessionCount"], m["messageCount"], m["turnCount"], m["toolCallCount"], m["inputTokens"], m["totalTokens"], m["turnsPerSession"]["p95"], m["parsedRecordCount"], m["recognizedRecordCount"])
    return spark.createDataFrame([row], "source string, sessions long, messages long, turns long, tools long, input_tokens long, total_tokens long, turns_p95 long, parsed long, recognized long")


@query(C + """ SELECT source, session, (least(user_count, 20) * 3 + least(assistant_count, 20) * 2 + least(session % 5, 20))::BIGINT AS score,
  CASE WHEN session % 5 > 0 THEN 'agentic' ELSE 'conversation' END AS kind FROM c""")
def activity_score(spark, sf):
    c = sessions.counts(messages(spark, sf)).withColumn("tools", F.col("session") % 5)
    return c.select("source", "session", sessions.activity_score(F.col("user_count"), F.col("assistant_count"), F.col("tools")).alias("score"), sessions.session_type(F.col("tools")).alias("kind"))


@query("SELECT user_id, CASE WHEN count(ts) < 2 THEN 0 ELSE (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) END AS elapsed_ms FROM events GROUP BY user_id")
def elapsed_per_session(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.groupBy("user_id").agg(F.when(F.count("ms") < 2, 0).otherwise(F.max("ms") - F.min("ms")).cast("long").alias("elapsed_ms"))


def rated(spark, sf):
    c = sessions.counts(messages(spark, sf)).withColumn("session_order", F.col("session"))  # the pick compares them only
    c = c.withColumns({"tool_count": F.col("session") % 11, "elapsed": (F.col("session") * 7919) % 1009, "source_order": (F.col("source") == "claude_code").cast("long")})
    return c.withColumn("activity", sessions.activity_score(F.col("user_count"), F.col("assistant_count"), F.col("tool_count")))


RATED = C + """, s AS (SELECT source, session, user_count, session % 11 AS tool_count, (session * 7919) % 1009 AS elapsed, (source = 'claude_code')::BIGINT AS source_order,
  row_number() OVER (PARTITION BY source ORDER BY session) - 1 AS session_order,
  least(user_count, 20) * 3 + least(assistant_count, 20) * 2 + least(session % 11, 20) AS activity FROM c),
p1 AS (SELECT session, 1 AS pick FROM s WHERE source_order = 0 ORDER BY activity DESC, session_order LIMIT 1),
p2 AS (SELECT session, 2 AS pick FROM s WHERE source_order = 1 ORDER BY activity DESC, session_order LIMIT 1),
q2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
p3 AS (SELECT session, 3 AS pick FROM s WHERE session NOT IN (SELECT session FROM q2) ORDER BY user_count DESC, source_order, session_order LIMIT 1),
q3 AS (SELECT * FROM q2 UNION ALL SELECT * FROM p3),
p4 AS (SELECT session, 4 AS pick FROM s WHERE session NOT IN (SELECT session FROM q3) ORDER BY elapsed DESC, source_order, session_order LIMIT 1),
q4 AS (SELECT * FROM q3 UNION ALL SELECT * FROM p4),
p5 AS (SELECT session, 5 AS pick FROM s WHERE session NOT IN (SELECT session FROM q4) ORDER BY tool_count DESC, source_order, session_order LIMIT 1),
q5 AS (SELECT * FROM q4 UNION ALL SELECT * FROM p5),
p6 AS (SELECT session, 5 + row_number() OVER (ORDER BY activity DESC, source_order, session_order) AS pick FROM s WHERE session NOT IN (SELECT session FROM q5) ORDER BY pick LIMIT 3)
SELECT source, session, pick, 'candidate-' || lpad(pick::VARCHAR, 2, '0') AS evidence_ref FROM (SELECT * FROM q5 UNION ALL SELECT * FROM p6) JOIN s USING (session)"""


@query(RATED)
def representative_top8(spark, sf):
    few = [r.asDict() for r in sessions.shortlist(rated(spark, sf)).collect()]  # 8 of each measure and one a source at most
    rows = [(r["source"], r["session"], k, f"candidate-{k:02d}") for k, r in enumerate(sessions.greedy_pick(few), 1)]
    return spark.createDataFrame(rows, "source string, session long, pick long, evidence_ref string")


@query()
def excerpt_assembly(spark, sf):
    from tallywood.operators.samples import excerpts

    return excerpts(spread(messages(spark, sf)).select("source", "session", "role", "text", "ordinal"))


FILES = """WITH r AS (SELECT event_id AS ordinal, user_id % 13 AS file, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (user_id * 31 + event_id // 100) % 37 END AS explicit FROM events),
seen AS (SELECT explicit, arg_min(file, ordinal) AS file, min(ordinal) AS c FROM r WHERE explicit IS NOT NULL GROUP BY explicit),
born AS (SELECT file, min(c) AS c, arg_min(explicit, c) AS id FROM seen GROUP BY file),
bare AS (SELECT file, min(ordinal) AS n FROM r WHERE explicit IS NULL GROUP BY file)
SELECT r.ordinal, coalesce(explicit::VARCHAR, CASE WHEN born.c < bare.n THEN born.id::VARCHAR END, 'file-' || r.file) AS session
FROM r LEFT JOIN born ON r.file = born.file LEFT JOIN bare ON r.file = bare.file"""


@query(FILES)
def idless_record_assignment(spark, sf):
    from tallywood.operators.records import assign_sessions

    e = table(spark, sf, "events")
    explicit = F.when(F.col("event_id") % 4 != 0, F.expr("(user_id * 31 + event_id div 100) % 37").cast("string"))
    r = e.select(F.lit("codex").alias("source"), F.concat(F.lit("file-"), F.col("user_id") % 13).alias("path"), F.col("event_id").alias("ordinal"), explicit.alias("explicit"))
    return assign_sessions(r).select("ordinal", "session")


LOG_EVENTS = 1000  # events in one written log file


def written_logs(spark, sf):
    """A folder of log files made of events: lines or an array, hidden or in a folder within, some records malformed."""
    import uuid

    from tallywood.sources.staging import folder

    e = table(spark, sf, "events").withColumns({"part": F.expr(f"event_id div {LOG_EVENTS}"), "k": F.col("event_id") % 10}).repartition("part")
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    twice = F.concat(F.lit('{"id": -1, "id": '), "event_id", F.lit(', "type": "'), "event_type", F.lit('"}'))
    good = F.when(F.col("k") == 5, twice).otherwise(whole)
    bad = [F.substring(whole, 1, 9), F.concat(whole, F.lit("] [")), F.concat(F.lit("["), "event_id", F.lit("]")), F.replace(whole, F.lit('"'), F.lit("'"))]
    line = F.when(F.col("k") == 4, "  ")
    for k, b in enumerate(bad):
        line = line.when(F.col("k") == k, b)
    in_lines = e.filter("part % 4 <> 3").withColumn("value", line.otherwise(good)).sortWithinPartitions("part", "event_id").select("part", "value")
    element = F.struct("event_id", F.when(F.col("k") < 4, F.col("event_id").cast("string")).otherwise(good).alias("value"))
    arrays = e.filter("part % 4 = 3 AND k <> 4").groupBy("part").agg(F.array_sort(F.collect_list(element)).alias("all"))  # at most LOG_EVENTS
    arrays = arrays.select("part", F.concat(F.lit("["), F.array_join("all.value", ",\n"), F.lit("]")).alias("value"))
    at = f"{folder(spark)}/logs-{uuid.uuid4().hex}"
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    found = []
    for name, df in (("lines", in_lines), ("arrays", arrays)):
        df.write.partitionBy("part").text(f"{at}/raw/{name}")
        found += [(int(d.getPath().getName()[5:]), d.getPath(), name) for d in fs.listStatus(jvm.Path(f"{at}/raw/{name}")) if d.isDirectory()]
    fs.mkdirs(jvm.Path(f"{at}/logs/sub"))
    for k, (part, d, name) in enumerate(sorted(found, key=lambda f: f[0])):  # Spark's writer can't name files itself
        (one,) = [f.getPath() for f in fs.listStatus(d) if not f.getPath().getName().startswith(".")]
        label = ("Log" if part % 2 else "log") + f"-{part:09d}." + ("json" if name == "arrays" else "ndjson" if part % 8 == 0 else "jsonl")
        fs.rename(one, jvm.Path(f"{at}/logs/." + label if k == 0 else f"{at}/logs/sub/{label}" if part % 3 == 1 else f"{at}/logs/{label}"))
    return fs.resolvePath(jvm.Path(f"{at}/logs")).toString()


@query("""WITH e AS (SELECT event_id, event_id // 1000 AS part, CASE WHEN event_id % 10 >= 5 THEN event_id END AS id, CASE WHEN event_id % 10 >= 5 THEN event_type END AS type FROM events WHERE event_id % 10 <> 4)
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY event_id) AS n, id, type, id IS NULL AS malformed,
    part = (SELECT min(part) FROM e) AS in_first_file, part = (SELECT coalesce(max(part) FILTER (part % 3 = 1 AND part > (SELECT min(part) FROM e)), max(part)) FROM e) AS in_last_file FROM e""")
def log_records(spark, sf):
    """Events written as log files, found by listing two overlapping roots and read back in order."""
    from pyspark.sql import Window

    from tallywood.sources.logs import SourceInput, listing, records

    at = written_logs(spark, sf)
    files, _, _ = listing(spark, [SourceInput("codex", at), SourceInput("codex", f"{at}/sub")])
    ends = files.agg(F.min("file_rank").alias("first"), F.max("file_rank").alias("last"))
    in_file = Window.partitionBy("path").orderBy("ordinal")  # LOG_EVENTS rows at most
    return records(spark, files).crossJoin(F.broadcast(ends)).select(
        F.regexp_extract("path", "-0*([0-9]+)[.][a-z]+$", 1).cast("long").alias("part"), F.row_number().over(in_file).cast("long").alias("n"),
        F.expr("try_variant_get(v, '$.id', 'bigint')").alias("id"), F.expr("try_variant_get(v, '$.type', 'string')").alias("type"), F.col("v").isNull().alias("malformed"),
        (F.col("ordinal.rank") == F.col("first")).alias("in_first_file"), (F.col("ordinal.rank") == F.col("last")).alias("in_last_file"),
    )


@query("""SELECT f.source, f.files, coalesce(a.active, 0) AS active, f.files - coalesce(a.active, 0) AS skipped FROM
  (SELECT source, count(*) AS files FROM documents GROUP BY source) f LEFT JOIN
  (SELECT source, count(*) AS active FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source) a USING (source)""")
def file_activity_left_join(spark, sf):
    from tallywood.operators.records import skipped_files

    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("path"))
    active = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("path"))
    return skipped_files(d, active)


@query("""SELECT source, text_hash AS path, min(doc_id) AS file_rank, count(*) AS copies FROM (SELECT source, doc_id, md5(text) AS text_hash FROM documents) GROUP BY source, text_hash""")
def overlap_dedup(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("path"))
    return d.groupBy("source", "path").agg(F.min("doc_id").alias("file_rank"), F.count("*").alias("copies"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


RE2 = {
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "IPV4": r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b",
    "RAW_UUID": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
}


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{RE2['EMAIL']}'))::BIGINT AS email, len(regexp_extract_all(text, '{RE2['IPV4']}'))::BIGINT AS ipv4,
  len(regexp_extract_all(text, '{RE2['RAW_UUID']}'))::BIGINT AS raw_uuid,
  sha256(regexp_replace(regexp_replace(regexp_replace(text, '{RE2['EMAIL']}', '[REDACTED_EMAIL]', 'g'), '{RE2['IPV4']}', '[REDACTED_IP]', 'g'), '{RE2['RAW_UUID']}', '[REDACTED_ID]', 'g')) AS redacted FROM documents""")
def redact_email_ipv4_uuid(spark, sf):
    from tallywood.functions.redaction import count_rule, replace_rules

    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", *[count_rule(F.col("text"), c).cast("long").alias(c.lower()) for c in RE2], F.sha2(replace_rules(F.col("text"), tuple(RE2)), 256).alias("redacted"))


OWN = "SELECT doc_id, text AS t FROM documents"


def planted(spark, sf):
    """Each document with one of the planted texts in front and one behind; null where that is null."""
    d = table(spark, sf, "documents")
    cases = F.array(*[F.lit(p) for p in redaction_sql.PLANTED])
    p = F.element_at(cases, F.pmod(F.col("doc_id"), F.lit(len(redaction_sql.PLANTED))).cast("int") + 1)
    one = F.concat(F.replace(p, F.lit("#"), F.col("doc_id").cast("string")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(" "), F.replace(p, F.lit("#"), F.lit("x")))
    return d.select("doc_id", one.alias("text"))


def counted(redactions):
    """CODE=n, joined by commas, in the order of the codes."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(redactions)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


COUNTED = "coalesce(array_to_string(list_transform(list_sort(counts), lambda c: c.code || '=' || c.n), ','), '')"


@query(redaction_sql.redact_sql(OWN) + " SELECT c.code, sum(c.n)::BIGINT AS n FROM (SELECT unnest(counts) AS c FROM done) GROUP BY c.code")
def redaction_counts(spark, sf):
    from tallywood.functions.redaction import with_redactions

    r = with_redactions(spread(table(spark, sf, "documents").select("text")))
    return r.select(F.explode_outer("redacted.redactions").alias("code", "n")).filter("code is not null").groupBy("code").agg(F.sum("n").alias("n"))


@query(redaction_sql.redact_sql(OWN) + f" SELECT doc_id, sha256(t) AS sha256, CASE WHEN t IS NOT NULL THEN {COUNTED} END AS redactions FROM done")
def redact_full(spark, sf):
    from tallywood.functions.redaction import with_redactions

    return with_redactions(spread(table(spark, sf, "documents").select("doc_id", "text"))).select("doc_id", F.sha2("redacted.text", 256).alias("sha256"), counted("redacted.redactions").alias("redactions"))


@query(redaction_sql.redact_sql(redaction_sql.planted_sql()) + f" SELECT doc_id, sha256(t) AS sha256, CASE WHEN t IS NOT NULL THEN {COUNTED} END AS redactions FROM done")
def redact_planted(spark, sf):
    from tallywood.functions.redaction import with_redactions

    return with_redactions(spread(planted(spark, sf))).select("doc_id", F.sha2("redacted.text", 256).alias("sha256"), counted("redacted.redactions").alias("redactions"))


@query(redaction_sql.detect_sql(OWN))
def detect_positions(spark, sf):
    from tallywood.functions.redaction import detections

    return detections(spread(table(spark, sf, "documents").select("doc_id", "text")), ["doc_id"])


@query(redaction_sql.detect_sql(redaction_sql.planted_sql()))
def detect_planted(spark, sf):
    from tallywood.functions.redaction import detections

    return detections(spread(planted(spark, sf)), ["doc_id"])


@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(?:https?|ftp|file|s3|mailto):[^>]+>', ' [REMOVED_RESOURCE] ', 'g'), '(?i)\b(?:https?|ftp|file|s3)://[^\s<>()\[\]{}]+', ' [REMOVED_RESOURCE] ', 'g'), '</?[A-Za-z][^>]*>', ' ', 'g'))::BIGINT AS stripped FROM pages""")
def strip_resources(spark, sf):
    from tallywood.functions.excerpts import strip_links

    return spread(table(spark, sf, "pages")).select("page_id", F.length(strip_links(F.col("html"))).cast("long").alias("stripped"))


@query(redaction_sql.excerpt_sql(OWN) + " SELECT doc_id, excerpt FROM shown")
def excerpt_normalize(spark, sf):
    from tallywood.functions.excerpts import with_excerpts

    return with_excerpts(spread(table(spark, sf, "documents").select("doc_id", "text"))).select("doc_id", "excerpt")


@query(redaction_sql.excerpt_sql(redaction_sql.planted_sql()) + " SELECT doc_id, excerpt FROM shown")
def excerpt_planted(spark, sf):
    from tallywood.functions.excerpts import with_excerpts

    return with_excerpts(spread(planted(spark, sf))).select("doc_id", "excerpt")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(text, '\p{Latin}', '', 'g'), '\p{L}')")
def non_latin_filter(spark, sf):
    from tallywood.functions.textrules import has_non_latin

    return table(spark, sf, "documents").filter(has_non_latin(F.col("text"))).select("doc_id")


@query(r"SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE regexp_replace(substr(text, 1, 279), '\s+$', '') || '…' END AS cut FROM documents")
def codepoint_truncate(spark, sf):
    from tallywood.functions.textrules import cut_points

    return table(spark, sf, "documents").select("doc_id", cut_points(F.col("text"), 280).alias("cut"))


TOPIC_CASE = "CASE quality * 2 + toxic WHEN 2 THEN 'backend' WHEN 0 THEN 'frontend' WHEN 3 THEN 'security' ELSE 'other' END"
TOPIC_ROWS = "(VALUES ('frontend'), ('backend'), ('devops_infra'), ('data_science_ml'), ('mobile'), ('security'), ('developer_tooling'), ('general_coding'), ('mixed'), ('other'), ('unknown')) t(topic)"


@query(f"""WITH a AS (SELECT d.source, {TOPIC_CASE} AS topic FROM documents d JOIN labels USING (doc_id)) SELECT source, topic, count(*) AS n FROM a GROUP BY ALL""")
def label_bind_counts(spark, sf):
    return topic_labels(spark, sf).groupBy("source", "topic").agg(F.count("*").alias("n"))


def topic_labels(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.expr(TOPIC_CASE).alias("topic"))
    return table(spark, sf, "documents").select("doc_id", "source").join(labels, "doc_id")


@query(f"""WITH a AS (SELECT {TOPIC_CASE} AS topic FROM labels JOIN documents USING (doc_id)) SELECT t.topic, count(a.topic) AS n, 100.0::DOUBLE * count(a.topic) / (SELECT count(*) FROM a) AS share
  FROM {TOPIC_ROWS} LEFT JOIN a ON a.topic = t.topic GROUP BY t.topic""")
def taxonomy_zero_fill(spark, sf):
    from tallywood.operators.topics import topic_counts

    return topic_counts(topic_labels(spark, sf))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unbound(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def semi_bound(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").filter("lang = 'en'"), "doc_id", "left_semi").select("doc_id")


@query("""WITH a AS (SELECT doc_id AS pos, 'topic-' || lpad(doc_id::VARCHAR, 6, '0') AS ref FROM labels), b AS (SELECT pos, CASE WHEN pos % 10 = 0 THEN ref || 'x' ELSE ref END AS ref FROM a WHERE pos % 17 <> 0)
SELECT count(*) FILTER (a.ref IS NOT NULL AND b.ref IS NOT NULL AND a.ref = b.ref) AS equal, count(*) FILTER (b.pos IS NULL) AS only_left, count(*) FILTER (a.pos IS NULL) AS only_right,
  count(*) FILTER (a.ref <> b.ref) AS different FROM a FULL JOIN b ON a.pos = b.pos""")
def positional_binding_check(spark, sf):
    from tallywood.operators.topics import compare_refs

    a = table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.concat(F.lit("topic-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("ref"))
    b = a.filter("pos % 17 <> 0").withColumn("ref", F.when(F.col("pos") % 10 == 0, F.concat("ref", F.lit("x"))).otherwise(F.col("ref")))
    return compare_refs(a, b)


@query("""WITH g AS (SELECT event_type, count(*) AS n, sum(value > 50)::BIGINT AS high, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY event_type),
o AS (SELECT count(*) AS n, sum(value > 50)::BIGINT AS high, min(ts) AS lo, max(ts) AS hi FROM events)
SELECT (SELECT n FROM o) = sum(n) AS n_ok, (SELECT high FROM o) = sum(high) AS high_ok, (SELECT lo FROM o) = min(lo) AND (SELECT hi FROM o) = max(hi) AS range_ok FROM g""")
def additive_invariants(spark, sf):
    from tallywood.operators.validation import additive

    e = table(spark, sf, "events").withColumn("high", (F.col("value") > 50).cast("int"))
    rows = metrics.by_source_and_overall(e, "event_type", F.count("*").alias("n"), F.sum("high").alias("high"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return additive(rows, "event_type", ["n", "high"], "lo", "hi")


@query(C + """, d AS (SELECT source, count(*) AS n, quantile_disc(user_count, 0.5) AS p50, quantile_disc(user_count, 0.95) AS p95, avg(user_count) AS mean, max(user_count) AS mx, sum(user_count) AS total FROM c GROUP BY source)
SELECT source, p50 <= p95 AND p95 <= mx AS ordered, mean <= mx AS mean_ok, abs(round(mean, 2) * n - total) <= n * 0.005 + 1e-9 AS sum_ok FROM d""")
def distribution_invariants(spark, sf):
    from tallywood.operators.validation import distribution_checks

    d = metrics.distribution(sessions.counts(messages(spark, sf)), ["source"], "turn_count", F.sum("turn_count").alias("total"))
    return distribution_checks(d).select("source", "ordered", "mean_ok", "sum_ok")


@query()
def markdown_section_check(spark, sf):
    from tallywood.operators.document import document_issues

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("---\nformat_version: 1\n---\n## Summary\n"), F.col("text")).cast("binary").alias("content"))
    return document_issues(docs)


@query(facts_sql.SQL)
def facts_breaches(spark, sf):
    from tallywood.operators.breaches import breaches

    return breaches(facts_sql.planted_facts(table(spark, sf, "documents"), table(spark, sf, "labels")))


@query(cards_sql.SQL)
def sample_card_bindings(spark, sf):
    """Cards without a candidate, candidates without a card and quotes that no excerpt of their candidate and role says."""
    from tallywood.operators.quotes import binding_issues, cards, unused

    docs, pool = cards_sql.planted_cards(table(spark, sf, "conversations"))
    pool, found = staged(pool, "candidates"), staged(cards(docs), "cards")
    rest = unused(found, pool).select("path", "ref", F.lit("UNUSED_CANDIDATE").alias("code"), F.lit(0).alias("line"))
    return binding_issues(found, pool).unionByName(rest)


@query(C + rf""", w AS (SELECT source, session, ordinal, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '{cards_sql.BLANK}', ' ', 'g'), ' ') AS t
  FROM m WHERE role = 'user'),
e AS (SELECT *, row_number() OVER (PARTITION BY source, session ORDER BY ordinal) AS r FROM w WHERE t <> ''),
v AS (SELECT source, session, list(rtrim(substr(t, 1, 600), ' ') ORDER BY ordinal) AS evidence FROM e WHERE r <= 3 GROUP BY source, session),
h AS (SELECT sha256('{{"nonce":"n","members":[' || string_agg('"' || source || '\u0000' || session || '"', ',' ORDER BY source, session::VARCHAR) || ']}}') AS population_sha256 FROM c)
SELECT 'topic-' || left(sha256('n'), 12) || '-' || lpad((row_number() OVER (ORDER BY source = 'claude_code', first_ordinal, session))::VARCHAR, 6, '0') AS evidence_ref,
  source, coalesce(evidence, []) AS evidence, population_sha256 FROM c LEFT JOIN v USING (source, session), h""")
def review_artifact(spark, sf):
    """The topic review of all conversations, written as one JSON file by executors and read back line by line."""
    from tallywood.operators import artifact, topics

    told = messages(spark, sf)
    found = sessions.order(sessions.counts(told)).withColumn("source_order", (F.col("source") == "claude_code").cast("long"))
    found = staged(found.select("source", "session", "source_order", "session_order"), "sessions")
    review = staged(topics.create_review(found, told.filter(sessions.is_user()).join(found.select("source", "session"), ["source", "session"], "left_semi"), "n"), "review")
    sha = topics.population_sha256(found.select("source", "session"), "n")
    at = artifact.own_place(spark)
    artifact.write_review(review, at, {"formatVersion": "topic-review.v1", "populationSha256": sha})
    return artifact.review_sessions(spark, at).select(F.col("evidenceRef").alias("evidence_ref"), "source", F.col("userEvidence").alias("evidence"), F.lit(sha).alias("population_sha256"))
