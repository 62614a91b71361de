"""Facts: from log files to metric sets and candidates."""

from __future__ import annotations

import datetime as dt
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.operators import artifact, metrics, records, samples, sessions, topics
from tallywood.operators.validation import artifact_problems, two_places
from tallywood.sources.logs import SourceInput, listing
from tallywood.sources.logs import records as read_records
from tallywood.sources.staging import staged

FORMAT = "facts.v1"


class EmptySource(ValueError):
    """A source without a session that has a user turn."""


def normalized(raw: DataFrame) -> DataFrame:
    """Both dialects' supported records in one shape, with their session."""
    good = raw.filter("v is not null")
    both = records.dialect_a(good.filter("source = 'codex'")).unionByName(records.dialect_b(good.filter("source = 'claude_code'")))
    return records.assign_sessions(both)


def message_rows(rows: DataFrame) -> DataFrame:
    return sessions.canonical(rows.filter("message").select("source", "session", "role", "text", "ordinal", "ts", "is_fallback"))


def session_rows(rows: DataFrame, messages: DataFrame, order: list[str]) -> DataFrame:
    """One row for each session that has a user turn, in order of first touch within its source."""
    touched = rows.groupBy("source", "session").agg(
        F.min("ordinal").alias("first_ordinal"), F.sum("tools").alias("tool_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("ts").alias("stamps"),
        F.array_sort(F.collect_list(F.when(F.size("models") > 0, F.struct("ordinal", "models")))).alias("m"),
    )
    counted = sessions.counts(messages).drop("first_ordinal")
    used = metrics.usage(rows.select("source", "session", F.explode("usages").alias("u")).select("source", "session", "u.*"), "source", "session")
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    place = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), F.lit(k))])
    out = touched.join(counted, ["source", "session"]).join(used, ["source", "session"], "left")
    out = out.select("*", iso("first_ts").alias("started_at"), iso("last_ts").alias("ended_at"), F.expr("array_distinct(flatten(transform(m, x -> x.models)))").alias("models"), F.when(F.col("stamps") < 2, 0).otherwise(F.col("last_ts") - F.col("first_ts")).alias("elapsed"), place[F.col("source")].cast("long").alias("source_order"))
    return sessions.order(out).drop("m")


def _distribution(r, name: str) -> dict:
    got = lambda k: r[f"{name}_{k}"] or 0
    return {"sampleSize": got("sample_size"), "p50": int(got("p50")), "p95": int(got("p95")), "mean": two_places(got("mean")), "max": got("max")}


def metric_sets(files: DataFrame, raw: DataFrame, rows: DataFrame, found: DataFrame, others: dict[str, int]) -> dict[str | None, dict]:
    """A metric set for each source and, under None, for all; every part is one aggregation with grouping sets."""
    keyed = lambda df, *aggs, wanted=None: {r.source: r for r in metrics.by_source_and_overall(df, "source", *aggs, wanted=wanted).collect()}  # one row a source
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    f = keyed(files, F.count("*").alias("n"), total("bytes").alias("bytes"))
    parsed = keyed(raw, F.count_if(F.col("v").isNotNull()).alias("parsed"), F.count_if(F.col("v").isNull()).alias("malformed"))
    known = keyed(rows, F.count_if("recognized").alias("n"))
    active = rows.filter("message or tools > 0").select("path")
    skipped = {r.source: r.skipped for r in records.skipped_files(files.select("source", "path"), active).collect()}
    dists = {"turns": "user_count", "tools": "tool_count", "tokens": "both"}
    s = found.withColumn("both", F.when(metrics.complete(), F.col("input") + F.col("output")))
    m = keyed(
        s, F.count("*").alias("n"), *[total(c).alias(c) for c in ("message_count", "user_count", "assistant_count", "tool_count")],
        F.sum(metrics.complete("input")).alias("input"), F.sum(metrics.complete("output")).alias("output"), F.sum("both").alias("total"),
        F.min("started_at").alias("first"), F.max("ended_at").alias("last"), metrics.mismatches(), *metrics.coverage()[1:],
        *[a for name, c in dists.items() for a in metrics.summary(c, f"{name}_")],
        wanted={k: w for name, c in dists.items() for k, w in metrics.halves(c, f"{name}_").items()},
    )
    stamps = rows.select("source", "session", "ts").join(found.select("source", "session"), ["source", "session"], "left_semi").withColumn("at", F.timestamp_millis("ts"))
    days = keyed(stamps, *metrics.active_days("at"))
    out = {}
    for name, r in m.items():
        get = lambda d, k, name=name: getattr(d[name], k) if name in d else 0
        one = {
            "fileCount": get(f, "n"), "totalBytes": get(f, "bytes"), "sessionCount": r.n, "messageCount": r.message_count, "userMessageCount": r.user_count,
            "assistantMessageCount": r.assistant_count, "turnCount": r.user_count, "toolCallCount": r.tool_count,
            "inputTokens": r.input, "outputTokens": r.output, "totalTokens": r.total, "earliestAt": r["first"], "latestAt": r["last"],
            "activeDays": get(days, "active_days"), "activeMonths": get(days, "active_months"), "parsedRecordCount": get(parsed, "parsed"), "recognizedRecordCount": get(known, "n"),
            "malformedRecordCount": get(parsed, "malformed"), "skippedFileCount": sum(skipped.values()) if name is None else skipped.get(name, 0),
            "unsupportedFileCount": sum(others.values()) if name is None else others.get(name, 0), "tokenArithmeticMismatchCount": r.mismatches,
            "tokenCoverage": {"sessionCount": r.n, "sessionsWithInputTokens": r.with_input, "sessionsWithOutputTokens": r.with_output, "sessionsWithTotalTokens": r.with_total},
            "turnsPerSession": _distribution(r, "turns"), "toolCallsPerSession": _distribution(r, "tools"), "tokensPerSession": _distribution(r, "tokens") if r.with_total else None,
        }
        whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
        out[name] = {k: whole(v) for k, v in one.items() if v is not None}
    return out


def facts(spark: SparkSession, inputs: list[SourceInput], now: dt.datetime | None = None, review: bool = False, nonce: str | None = None, review_to: str | None = None):
    """The facts document; with `review_to` the review is written there and bound to it.

    With `review` also the written review itself, whole on the driver: for few sessions.
    """
    files, others, order = listing(spark, inputs)
    raw = staged(read_records(spark, files), "records")
    rows = staged(normalized(raw), "rows")
    messages = staged(message_rows(rows), "messages")
    found = staged(session_rows(rows, messages, order), "sessions")
    sets = metric_sets(files, raw, rows, found, others)
    for name in order:
        if name not in sets or not sets[name]["sessionCount"]:
            raise EmptySource(f"no sessions with a user turn in source {name}")
    at = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{(now or dt.datetime.now()).microsecond // 1000:03d}Z"
    kept = messages.join(found.select("source", "session"), ["source", "session"], "left_semi")
    picked = samples.candidates(found, kept)
    out = {"formatVersion": FORMAT, "generatedAt": at, "overall": sets[None], "bySource": {s: sets[s] for s in order}}
    if picked:
        out["representativeCandidates"] = picked
    if review:
        review_to = review_to or artifact.own_place(spark)
    if review_to is None:
        return out
    nonce = nonce or secrets.token_hex(32)
    members = found.select("source", "session")
    bound = {"formatVersion": "topic-review.v1", "populationSha256": topics.population_sha256(members, nonce), "sessionCount": members.count()}
    table = staged(topics.create_review(found, kept.filter(sessions.is_user()), nonce), "review")
    artifact.write_review(table, review_to, {"formatVersion": bound["formatVersion"], "generatedAt": at, **{k: bound[k] for k in ("populationSha256", "sessionCount")}})
    # references follow from the nonce and the position; the facts list them all by contract
    out["topicReview"] = {**bound, "evidenceRefs": [topics.reference(nonce, k + 1) for k in range(bound["sessionCount"])]}
    return (out, artifact.read_review(spark, review_to)) if review else out


def apply_review(spark: SparkSession, base: dict, completed: dict) -> dict:
    """Facts with the labels of a completed review; raises where review and facts don't belong together."""
    bound = base.get("topicReview")
    if not bound or "topicClassification" in base:
        raise ValueError("the facts have no open review")
    if broken := artifact_problems(completed):
        raise ValueError(broken[0])
    for k, v in (("generatedAt", base["generatedAt"]), ("populationSha256", bound["populationSha256"]), ("sessionCount", bound["sessionCount"])):
        if completed.get(k) != v:
            raise ValueError(f"review and facts differ in {k}")
    rows = completed["sessions"]
    if [r["evidenceRef"] for r in rows] != bound["evidenceRefs"]:
        raise ValueError("review and facts differ in their references")
    kind = "pos long, evidence_ref string, source string, evidence array<string>, technical_signals array<string>, primary_topic string"
    review = spark.createDataFrame([(k, r["evidenceRef"], r["source"], r["userEvidence"], r.get("technicalSignals"), r["primaryTopic"]) for k, r in enumerate(rows)], kind)
    broken = topics.review_problems(review).limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0].evidence_ref}: {broken[0].problem}")
    good, problems = topics.bind_review(review, review.select("evidence_ref", "primary_topic"))
    if bad := problems.limit(1).collect():
        raise ValueError(f"{bad[0].evidence_ref}: {bad[0].problem}")
    counts = {r.topic: r.n for r in topics.topic_counts(good).collect()}  # the taxonomy
    assigned = [{"evidenceRef": r["evidenceRef"], "source": r["source"], "primaryTopic": r["primaryTopic"]} for r in rows]
    done = {"method": "agent_semantic_review_v1", "taxonomyVersion": "primary-topic-v1", "populationSha256": bound["populationSha256"], "denominator": bound["sessionCount"], "reviewedSessionCount": len(assigned), "assignments": assigned, "counts": {t: counts[t] for t in topics.TOPICS}}
    return {**base, "topicClassification": done}
