"""Representative sessions: ordered excerpts and a bounded pick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.functions.excerpts import no_controls, trim, with_excerpts
from tallywood.functions.redaction import detect_text
from tallywood.operators import sessions as S
from tallywood.sources.staging import staged


def excerpts(messages: DataFrame) -> DataFrame:
    """source, session and up to five excerpts (role, position, text) of each session with a user message.

    With a middle turn: opening, the assistant before it, it, the assistant after it, and
    the assistant after the last user turn or else that turn.  Without one: opening and
    closing, each with the next assistant message.  Excerpts that normalize to nothing go.
    Texts are normalized once, before the windows, and only chosen ones are carried on.
    """
    clean = with_excerpts(messages, "text", "clean")
    plan = staged(clean.select("source", "session", "role", "ordinal", "clean"), "clean")  # read three times
    ends = plan.filter(S.is_user()).groupBy(*S.KEY).agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    after = S.assistant_after(plan)
    replies = after.join(ends, S.KEY).groupBy(*S.KEY).agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.max(F.when(F.col("ordinal") == F.col("lo"), F.col("reply"))).alias("first_reply"), F.max(F.when(F.col("ordinal") == F.col("hi"), F.col("reply"))).alias("last_reply"))
    middle = S.best_middle(plan, F.length("clean")).select(*S.KEY, F.col("ordinal").alias("mid"), F.col("before").alias("mid_before"), F.col("after").alias("mid_after"))
    p = replies.join(middle, S.KEY, "left")
    slot = lambda c, position: F.struct(c.alias("ordinal"), F.lit(position).alias("position"))
    c = F.col
    with_middle = F.array(slot(c("lo"), "opening"), slot(c("mid_before"), "middle"), slot(c("mid"), "middle"), slot(c("mid_after"), "middle"), slot(F.coalesce("last_reply", "hi"), "closing"))
    two = c("hi") != c("lo")
    without = F.array(slot(c("lo"), "opening"), slot(c("first_reply"), "opening"), slot(F.when(two, c("hi")), "closing"), slot(F.when(two, c("last_reply")), "closing"))
    chosen = p.select(*S.KEY, F.posexplode(F.when(c("mid").isNotNull(), with_middle).otherwise(without)).alias("place", "s")).select(*S.KEY, "place", "s.ordinal", "s.position").filter("ordinal is not null")
    chosen = chosen.groupBy(*S.KEY, "ordinal").agg(F.min(F.struct("place", "position")).alias("m"))
    texts = chosen.join(plan.filter("clean is not null"), [*S.KEY, "ordinal"])
    listed = texts.groupBy(*S.KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("m.place").alias("place"), "role", F.col("m.position").alias("position"), F.col("clean").alias("text")))).alias("e"))
    return listed.select(*S.KEY, F.expr("transform(e, x -> named_struct('role', x.role, 'position', x.position, 'text', x.text))").alias("excerpts"))


def eligible(with_excerpts: DataFrame) -> DataFrame:
    """Sessions with an excerpt of the user."""
    return with_excerpts.filter(F.expr("exists(excerpts, e -> e.role = 'user')"))


def safe_models(models) -> list[str] | None:
    """Names fit to show: no controls, bars or anything sensitive, 120 code points at most."""
    out = []
    for m in dict.fromkeys(models or ()):
        m = trim(no_controls(m, ""))
        if m and len(m) <= 120 and not any(c in m for c in "|\r\n") and not detect_text(m):
            out.append(m)
    return out or None


def candidates(sessions: DataFrame, messages: DataFrame, most: int = 8) -> list[dict]:
    """The picked sessions with excerpts and metrics, as candidate-01 and so on; at most 8 rows are collected in full.

    sessions has source, session, source_order, session_order, message_count, user_count,
    assistant_count, tool_count, elapsed, started_at, ended_at, models, input, output.
    """
    told = staged(eligible(excerpts(messages)), "excerpts")
    rated = sessions.join(told, ["source", "session"]).withColumn("activity", S.activity_score(F.col("user_count"), F.col("assistant_count"), F.col("tool_count")))
    few = [r.asDict(recursive=True) for r in S.shortlist(rated, most).collect()]  # at most 4 * most + sources rows
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    out = []
    for k, r in enumerate(S.greedy_pick(few, most), 1):
        both = r["input"] is not None and r["output"] is not None
        row = {
            "evidenceRef": f"candidate-{k:02d}", "source": r["source"], "startedAt": r["started_at"], "endedAt": r["ended_at"], "models": safe_models(r["models"]),
            "sessionType": "agentic" if r["tool_count"] > 0 else "conversation", "messageCount": r["message_count"], "userTurns": r["user_count"], "toolCalls": r["tool_count"],
            "inputTokens": r["input"], "outputTokens": r["output"], "totalTokens": r["input"] + r["output"] if both else None, "excerpts": r["excerpts"],
        }
        out.append({a: whole(b) for a, b in row.items() if b is not None})
    return out
