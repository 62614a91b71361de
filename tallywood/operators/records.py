"""Records of session logs: typed reads of untyped JSON, session assignment, two dialects to long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywood.functions.textrules import js_trim

_NUMBERS = "('BIGINT', 'DOUBLE', 'DECIMAL', 'FLOAT')"


def kind(v: str, path: str = "$") -> Column:
    """The JSON type's name: OBJECT, ARRAY, STRING, BOOLEAN, a number type, VOID; null where the path is missing."""
    return F.expr(f"regexp_extract(schema_of_variant(try_variant_get({v}, '{path}', 'variant')), '^[A-Z]+', 0)")


def numeric(v: str, path: str) -> Column:
    """A finite number of at least 0, given as a JSON number; else null."""
    value = F.expr(f"try_variant_get({v}, '{path}', 'double')")
    return F.when(kind(v, path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT") & (value >= 0), value)


def text_field(v: str, path: str) -> Column:
    """A string that isn't empty; else null."""
    return F.when(kind(v, path) == "STRING", F.nullif(F.expr(f"try_variant_get({v}, '{path}', 'string')"), F.lit("")))


def is_true(v: str, path: str) -> Column:
    return F.coalesce((kind(v, path) == "BOOLEAN") & F.expr(f"try_variant_get({v}, '{path}', 'boolean')"), F.lit(False))


def first_of(v: str, *paths: str) -> Column:
    """The first path that isn't missing or null, as a variant; a wrong type blocks later ones."""
    get = lambda p: F.expr(f"try_variant_get({v}, '{p}', 'variant')")
    out = F.lit(None).cast("variant")
    for p in reversed(paths):
        out = F.when(F.coalesce(kind(v, p), F.lit("VOID")) != "VOID", get(p)).otherwise(out)
    return out


def epoch_millis(v: str, path: str = "$") -> Column:
    """Numbers under 1e10 are seconds, others milliseconds; strings are ISO dates; else null."""
    number = F.expr(f"try_variant_get({v}, '{path}', 'double')")
    millis = F.when(number < 1e10, number * 1000).otherwise(number)
    said = F.expr(f"try_variant_get({v}, '{path}', 'string')")
    return (
        F.when(kind(v, path).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT") & (F.abs(millis) <= 8.64e15), millis.cast("long"))
        .when(kind(v, path) == "STRING", F.unix_millis(F.try_to_timestamp(said)))
    )


def assign_sessions(records: DataFrame) -> DataFrame:
    """session of each record (source, path, ordinal, explicit): its own id, else its file's.

    A file's records without an id belong to the first session that the file created: the
    first id that is new in the source, if it comes before the file's first record without
    one; else the file is a session by its path.  Both are minima, so no order is kept.
    """
    new = records.filter("explicit is not null").groupBy("source", "explicit").agg(F.min(F.struct("ordinal", "path")).alias("m"))
    born = new.groupBy("source", F.col("m.path").alias("path")).agg(F.min(F.struct(F.col("m.ordinal").alias("ordinal"), "explicit")).alias("born"))
    bare = records.filter("explicit is null").groupBy("source", "path").agg(F.min("ordinal").alias("bare"))
    owner = bare.join(born, ["source", "path"], "left").select("source", "path", F.when(F.col("born.ordinal") < F.col("bare"), F.col("born.explicit")).otherwise(F.col("path")).alias("owner"))
    return records.join(owner, ["source", "path"], "left").withColumn("session", F.coalesce("explicit", "owner")).drop("owner")


def skipped_files(files: DataFrame, active: DataFrame) -> DataFrame:
    """Per source: files, files with activity and files without; empty files count."""
    a = active.select("path").distinct().withColumn("_a", F.lit(1))
    return files.join(a, "path", "left").groupBy("source").agg(F.count("*").alias("files"), F.count("_a").alias("active"), (F.count("*") - F.count("_a")).alias("skipped"))


PARTS = "array<variant>"


def content_text(v: str, path: str, ignored: tuple[str, ...] = ()) -> Column:
    """Text of a message's content: a string, or the text blocks of an array joined by line ends."""
    drop = ", ".join(f"'{i}'" for i in ignored) or "''"
    field = lambda n: f"if(schema_of_variant(try_variant_get(p, '$.{n}', 'variant')) = 'STRING', nullif(try_variant_get(p, '$.{n}', 'string'), ''), null)"
    block = f"""transform(try_variant_get({v}, '{path}', 'array<variant>'), p -> CASE
      WHEN schema_of_variant(p) = 'STRING' THEN cast(p AS string)
      WHEN schema_of_variant(p) NOT LIKE 'OBJECT%' THEN ''
      WHEN coalesce(try_variant_get(p, '$.type', 'string'), '') IN ({drop}) AND coalesce(try_variant_get(p, '$.type', 'string'), '') <> '' THEN ''
      WHEN coalesce(try_variant_get(p, '$.type', 'string'), '') NOT IN ('', 'text', 'input_text', 'output_text') THEN ''
      ELSE coalesce({field('text')}, {field('input_text')}, {field('output_text')}, '') END)"""
    return (
        F.when(kind(v, path) == "STRING", F.expr(f"try_variant_get({v}, '{path}', 'string')"))
        .when(kind(v, path) == "ARRAY", F.expr(f"array_join(filter({block}, t -> t <> ''), '\\n')"))
        .otherwise("")
    )


def usage_of(v: str, path: str) -> Column:
    """input, output and total tokens of a usage object, snake or camel case; null without any."""
    def one(snake: str, camel: str) -> Column:
        chosen = F.when(F.coalesce(kind(v, f"{path}.{snake}"), F.lit("VOID")) != "VOID", numeric(v, f"{path}.{snake}")).otherwise(numeric(v, f"{path}.{camel}"))
        return chosen

    i, o, t = one("input_tokens", "inputTokens"), one("output_tokens", "outputTokens"), one("total_tokens", "totalTokens")
    return F.when(i.isNotNull() | o.isNotNull() | t.isNotNull(), F.struct(i.alias("input"), o.alias("output"), t.alias("total")))


def blocks_of(v: str, path: str, what: str) -> Column:
    return F.coalesce(F.expr(f"size(filter(try_variant_get({v}, '{path}', 'array<variant>'), p -> try_variant_get(p, '$.type', 'string') = '{what}'))"), F.lit(-1))


def _said(v: str, path: str) -> Column:
    return F.coalesce(F.when(kind(v, path) == "STRING", F.expr(f"try_variant_get({v}, '{path}', 'string')")), F.lit(""))


COMMON = ["source", "path", "ordinal", "explicit", "ts", "role", "text", "is_fallback", "tools", "usage", "cumulative", "models", "recognized"]


def dialect_a(records: DataFrame) -> DataFrame:
    """The dialect with typed payloads (session_meta, response_item, event_msg); unsupported records go."""
    kind_, has = _said("v", "$.type"), kind("v", "$.payload") == "OBJECT"
    r = records.withColumns({"type": kind_, "ptype": F.when(has, _said("v", "$.payload.type")), "has": F.coalesce(has, F.lit(False))})
    r = r.filter((F.col("type") == "session_meta") | (F.col("type").isin("response_item", "event_msg") & F.col("has")))
    meta = F.col("type") == "session_meta"
    explicit = F.coalesce(text_field("v", "$.session_id"), text_field("v", "$.sessionId"), F.when(meta, text_field("v", "$.payload.id")))
    item, event = F.col("type") == "response_item", F.col("type") == "event_msg"
    is_item = item & (F.col("ptype") == "message")
    spoken = F.coalesce(text_field("v", "$.payload.message"), content_text("v", "$.payload.content"))
    role = F.when(is_item, _said("v", "$.payload.role")).when(event & (F.col("ptype") == "user_message"), "user").when(event & (F.col("ptype") == "agent_message"), "assistant")
    text = F.when(is_item, content_text("v", "$.payload.content")).when(event & F.col("ptype").isin("user_message", "agent_message"), spoken)
    counted = F.when(event & (F.col("ptype") == "token_count"), usage_of("v", "$.payload.info.total_token_usage"))
    plain = F.when(kind("v", "$.payload.usage") == "OBJECT", usage_of("v", "$.payload.usage")).otherwise(F.when(kind("v", "$.usage") == "OBJECT", usage_of("v", "$.usage")))
    r = r.withColumns({
        "explicit": explicit, "tv": first_of("v", "$.timestamp", "$.created_at", "$.payload.timestamp"), "role": role, "text": js_trim(F.coalesce(text, F.lit(""))),
        "is_fallback": event, "tools": (item & F.col("ptype").isin("function_call", "custom_tool_call", "local_shell_call")).cast("int"),
        "counted": counted, "plain": plain, "models": F.array_compact(F.array(text_field("v", "$.model"), text_field("v", "$.payload.model"), text_field("v", "$.payload.model_info.model"))),
    })
    return _finished(r, meta)


def dialect_b(records: DataFrame) -> DataFrame:
    """The dialect with messages (user, assistant); side chains, subagents, meta and service records go."""
    apart = is_true("v", "$.isSidechain") | is_true("v", "$.is_sidechain") | is_true("v", "$.isMeta") | is_true("v", "$.is_meta")
    for p in ("agentId", "agent_id", "parentToolUseID", "parent_tool_use_id"):
        apart = apart | F.coalesce(kind("v", f"$.{p}") == "STRING", F.lit(False))
    r = records.withColumn("type", _said("v", "$.type")).filter(~apart & ~F.col("type").isin("system", "summary", "progress", "queue-operation"))
    r = r.withColumn("role", F.when(F.col("type").isin("user", "assistant"), F.col("type")).otherwise(_said("v", "$.message.role"))).filter(F.col("role").isin("user", "assistant"))
    at = F.coalesce(kind("v", "$.message.content"), F.lit("VOID")) != "VOID"
    user = F.col("role") == "user"
    pick = lambda f: F.when(at, f("$.message.content")).otherwise(f("$.content"))
    text = F.when(user, pick(lambda p: content_text("v", p, ("tool_result",)))).otherwise(pick(lambda p: content_text("v", p, ("thinking", "redacted_thinking", "tool_use", "tool_result"))))
    tools = F.when(user, 0).otherwise(F.greatest(pick(lambda p: blocks_of("v", p, "tool_use")), F.lit(0)))
    results = user & (pick(lambda p: blocks_of("v", p, "tool_result")) > 0)
    plain = F.when(kind("v", "$.message.usage") == "OBJECT", usage_of("v", "$.message.usage")).otherwise(F.when(kind("v", "$.usage") == "OBJECT", usage_of("v", "$.usage")))
    r = r.withColumns({
        "explicit": F.coalesce(text_field("v", "$.sessionId"), text_field("v", "$.session_id")), "tv": first_of("v", "$.timestamp", "$.createdAt", "$.message.timestamp"),
        "text": js_trim(text), "is_fallback": F.lit(False), "tools": tools.cast("int"), "counted": F.lit(None).cast("struct<input:double,output:double,total:double>"), "plain": plain,
        "models": F.array_compact(F.array(text_field("v", "$.model"), text_field("v", "$.message.model"))), "results": results,
    })
    return _finished(r, F.col("results"))


def _finished(r: DataFrame, also: Column) -> DataFrame:
    message = F.coalesce(F.col("role").isin("user", "assistant") & (F.col("text") != ""), F.lit(False))
    use = F.array_compact(F.array(F.when(F.col("counted").isNotNull(), F.struct("counted.*", F.lit(True).alias("cumulative"))), F.when(F.col("plain").isNotNull(), F.struct("plain.*", F.lit(False).alias("cumulative")))))
    r = r.withColumns({"ts": epoch_millis("tv"), "message": message, "usages": use})
    return r.select("source", "path", "ordinal", "explicit", "ts", "role", "text", "message", "is_fallback", "tools", "usages", "models", (message | (F.col("tools") > 0) | (F.size("usages") > 0) | also).alias("recognized"))
