"""Sessions out of messages: canonical roles, windows over turns, counts, order, top-k.

A message table has session, source, role, text, ordinal and optionally ts and
is_fallback.  All of these are declarative plans; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywood.functions.textrules import js_trim
from tallywood.sources.staging import staged

KEY = ["source", "session"]


def is_user() -> Column:
    return F.col("role") == "user"


def is_assistant() -> Column:
    return F.col("role") == "assistant"


def human_messages(messages: DataFrame) -> DataFrame:
    """User and assistant messages whose text isn't blank, texts trimmed."""
    return messages.filter(F.col("role").isin("user", "assistant")).withColumn("text", js_trim("text")).filter("text <> ''")


def canonical(messages: DataFrame, dual_source: str = "codex") -> DataFrame:
    """Of a source that logs messages twice, fallback messages count only for roles without a primary one."""
    any_primary = F.max((~F.col("is_fallback")).cast("int")).over(Window.partitionBy(*KEY, "role")) == 1
    return messages.withColumn("_p", any_primary).filter((~F.col("is_fallback")) | ((F.col("source") == dual_source) & ~F.col("_p"))).drop("_p")


def counts(messages: DataFrame) -> DataFrame:
    """Messages, turns and first ordinal of each session; sessions without a user turn go."""
    out = messages.groupBy(*KEY).agg(
        F.count("*").alias("message_count"),
        F.count_if(is_user()).alias("user_count"),
        F.count_if(is_assistant()).alias("assistant_count"),
        F.min("ordinal").alias("first_ordinal"),
    )
    return out.filter("user_count > 0").withColumn("turn_count", F.col("user_count"))


def order(sessions: DataFrame, by: str = "first_ordinal") -> DataFrame:
    """session_order, from 0, within each source by first touch.

    Sorted ranges are numbered apart and start after those before them, so no source is one task.
    """
    ranged = staged(sessions.repartitionByRange("source", by, "session").withColumn("_range", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("source", "_range").agg(F.count("*").alias("n")).select("source", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("source", "_range").orderBy(by, "session"))
    numbered = ranged.withColumn("_row", inside).join(F.broadcast(starts), ["source", "_range"])  # a row for each source and range
    return numbered.withColumn("session_order", (F.col("_start") + F.col("_row") - 1).cast("long")).select(*sessions.columns, "session_order")


def neighbours(messages: DataFrame) -> DataFrame:
    """The previous and next message's ordinal where these are the assistant's, for each user message."""
    w = Window.partitionBy(*KEY).orderBy("ordinal")
    near = lambda f: F.when(f("role").over(w) == "assistant", f("ordinal").over(w))
    return messages.select("*", near(F.lag).alias("before"), near(F.lead).alias("after")).filter(is_user())


def edges(messages: DataFrame) -> DataFrame:
    """First and last user message of each session."""
    user = messages.filter(is_user())
    return user.groupBy(*KEY).agg(F.min("ordinal").alias("first_ordinal"), F.min_by("text", "ordinal").alias("first_text"), F.max("ordinal").alias("last_ordinal"), F.max_by("text", "ordinal").alias("last_text"))


def assistant_after(messages: DataFrame) -> DataFrame:
    """For each user message the ordinal of the first assistant message after it."""
    w = Window.partitionBy(*KEY).orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    return messages.withColumn("reply", F.first(F.when(is_assistant(), F.col("ordinal")), ignorenulls=True).over(w)).filter(is_user())


def best_middle(messages: DataFrame, length: Column | None = None) -> DataFrame:
    """Of each session the inner user turn with most assistant neighbours, then the longest, then the first."""
    size = F.length("text") if length is None else length
    w = Window.partitionBy(*KEY)
    inner = neighbours(messages).withColumns({"_lo": F.min("ordinal").over(w), "_hi": F.max("ordinal").over(w)}).filter("ordinal > _lo and ordinal < _hi")
    scored = inner.withColumns({"completeness": F.col("before").isNotNull().cast("long") + F.col("after").isNotNull().cast("long"), "length": size.cast("long")}).filter("length is not null")
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("completeness"), F.desc("length"), "ordinal"))
    return scored.withColumn("_r", best).filter("_r = 1").drop("_r", "_lo", "_hi")


def activity_score(users: Column, assistants: Column, tools: Column) -> Column:
    cap = lambda c: F.least(c, F.lit(20))
    return (cap(users) * 3 + cap(assistants) * 2 + cap(tools)).cast("long")


def session_type(tools: Column) -> Column:
    return F.when(tools > 0, "agentic").otherwise("conversation")


MEASURES = ("activity", "user_count", "elapsed", "tool_count")


def shortlist(sessions: DataFrame, most: int = 8) -> DataFrame:
    """The few sessions that a greedy pick of `most` can choose: each source's `most` most active and the first `most` by each measure.

    A pick takes one session from the pool at a time, so no more than `most - 1` of the
    best by any measure are gone when it is that measure's turn.  Each session stands once for each
    measure, and a task keeps the first `most` of each of its groups before these meet in one
    shuffle; ties go by source_order and session_order.
    """
    every = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(None).cast("string").alias("of"), F.col(m).cast("double").alias("size")) for m in MEASURES], F.struct(F.lit("source").alias("measure"), F.col("source").cast("string").alias("of"), F.col("activity").cast("double").alias("size"))))
    rated = sessions.select("*", every.alias("_m")).select(*sessions.columns, "_m.*")
    best = F.row_number().over(Window.partitionBy("measure", "of").orderBy(F.desc("size"), "source_order", "session_order"))
    top = rated.withColumn("_place", best).filter(F.col("_place") <= most)
    return top.select(*sessions.columns)


def greedy_pick(rows: list[dict], most: int = 8) -> list[dict]:
    """The representative sessions among a shortlist, which may name one more than once, in the order they are picked."""
    pool = sorted({(r["source"], r["session"]): r for r in rows}.values(), key=lambda r: (r["source_order"], r["session_order"]))
    chosen: list[dict] = []

    def first(measure: str, among: list[dict]) -> dict | None:
        return max(among, key=lambda r: (r[measure], -r["source_order"], -r["session_order"]), default=None)

    def take(row: dict | None) -> None:
        if row is not None and len(chosen) < most:
            chosen.append(row)
            pool.remove(row)

    for name in dict.fromkeys(r["source"] for r in pool):
        take(first("activity", [r for r in pool if r["source"] == name]))
    take(first("user_count", pool))
    longest = first("elapsed", pool)
    if longest is not None and longest["elapsed"] > 0:
        take(longest)
    take(first("tool_count", pool))
    while pool and len(chosen) < most:
        take(first("activity", pool))
    return chosen
