"""Invariants across aggregates, as rows of broken rules."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the metrics in facts documents.
ADDITIVE = (
    "fileCount", "totalBytes", "sessionCount", "messageCount", "userMessageCount", "assistantMessageCount", "turnCount", "toolCallCount",
    "parsedRecordCount", "recognizedRecordCount", "malformedRecordCount", "skippedFileCount", "unsupportedFileCount", "tokenArithmeticMismatchCount",
)
METRIC_KEYS = {*ADDITIVE, "activeDays", "activeMonths", "inputTokens", "outputTokens", "totalTokens", "earliestAt", "latestAt", "tokenCoverage", "turnsPerSession", "toolCallsPerSession", "tokensPerSession"}
COVERAGE = ("sessionCount", "sessionsWithInputTokens", "sessionsWithOutputTokens", "sessionsWithTotalTokens")
TOKENS = ("inputTokens", "outputTokens", "totalTokens")


def two_places(x: float) -> float:
    """Two decimals of the exact binary value, ties up."""
    return float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP))


def additive(rows: DataFrame, key: str, sums: list[str], low: str, high: str) -> DataFrame:
    """Whether the row with a null key equals the sum (and range) of the others."""
    whole, part = F.col(key).isNull(), F.col(key).isNotNull()
    checks = [(F.max(F.when(whole, F.col(c))) == F.sum(F.when(part, F.col(c)))).alias(f"{c}_ok") for c in sums]
    span = (F.max(F.when(whole, F.col(low))) == F.min(F.when(part, F.col(low)))) & (F.max(F.when(whole, F.col(high))) == F.max(F.when(part, F.col(high))))
    return rows.agg(*checks, span.alias("range_ok"))


def distribution_checks(d: DataFrame) -> DataFrame:
    """ordered, mean_ok and sum_ok for rows of sample_size, p50, p95, mean, max and the true total."""
    mean = F.round("mean", 2)
    return d.withColumns({
        "ordered": (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("max")),
        "mean_ok": F.col("mean") <= F.col("max"),
        "sum_ok": F.abs(mean * F.col("sample_size") - F.col("total")) <= F.col("sample_size") * 0.005 + 1e-9,
    })


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 2**53 - 1


def distribution_problems(d, path: str, size: int, total: int | None = None) -> list[str]:
    if not isinstance(d, dict) or set(d) != {"sampleSize", "p50", "p95", "mean", "max"}:
        return [f"{path}: not a distribution"]
    if not all(_whole(d[k]) for k in ("sampleSize", "p50", "p95", "max")) or not isinstance(d["mean"], (int, float)) or d["mean"] < 0:
        return [f"{path}: not numbers"]
    out = []
    if d["sampleSize"] != size:
        out.append(f"{path}: sample size isn't {size}")
    if not d["p50"] <= d["p95"] <= d["max"] or d["mean"] > d["max"]:
        out.append(f"{path}: values out of order")
    if size == 0 and any(d[k] for k in ("p50", "p95", "mean", "max")):
        out.append(f"{path}: values without a sample")
    if total is not None and abs(d["mean"] * size - total) > size * 0.005 + 1e-9:
        out.append(f"{path}: mean doesn't fit the total")
    return out


def metric_problems(m: dict, path: str) -> list[str]:
    """Broken rules of one metric set."""
    out = [f"{path}: unknown keys"] if not set(m) <= METRIC_KEYS else []
    out += [f"{path}.{k}: not a whole number" for k in (*ADDITIVE, "activeDays", "activeMonths") if not _whole(m.get(k))]
    if out:
        return out
    def need(ok, what):
        if not ok:
            out.append(f"{path}: {what}")

    need(m["messageCount"] == m["userMessageCount"] + m["assistantMessageCount"], "messages aren't user + assistant")
    need(m["turnCount"] == m["userMessageCount"], "turns aren't user messages")
    need(m["recognizedRecordCount"] <= m["parsedRecordCount"], "more recognized than parsed records")
    need(m["sessionCount"] == 0 or min(m["fileCount"], m["recognizedRecordCount"]) > 0, "sessions without a file or a recognized record")
    need(m["activeMonths"] <= m["activeDays"], "more active months than days")
    need(all(m.get(k) is None or _iso(m[k]) for k in ("earliestAt", "latestAt")), "a time of another form")
    given = [k for k in TOKENS if m.get(k) is not None]
    need(len(given) in (0, 3), "some token totals are absent")
    if len(given) == 3:
        need(all(_whole(m[k]) for k in TOKENS) and m["totalTokens"] == m["inputTokens"] + m["outputTokens"], "token totals don't add up")
    cov = m.get("tokenCoverage") or {}
    need(set(cov) == set(COVERAGE) and all(_whole(cov[k]) for k in COVERAGE), "no token coverage")
    if not out:
        need(cov["sessionCount"] == m["sessionCount"], "coverage has another session count")
        need(cov["sessionsWithTotalTokens"] <= min(cov["sessionsWithInputTokens"], cov["sessionsWithOutputTokens"]) and max(cov.values()) <= m["sessionCount"], "coverage out of bounds")
        need((cov["sessionsWithTotalTokens"] > 0) == (len(given) == 3), "coverage and totals disagree")
        need(m["tokenArithmeticMismatchCount"] <= cov["sessionsWithTotalTokens"], "more mismatches than sessions with tokens")
        out += distribution_problems(m.get("turnsPerSession"), f"{path}.turnsPerSession", m["sessionCount"], m["turnCount"])
        out += distribution_problems(m.get("toolCallsPerSession"), f"{path}.toolCallsPerSession", m["sessionCount"], m["toolCallCount"])
        tokens = m.get("tokensPerSession")
        need((tokens is not None) == (cov["sessionsWithTotalTokens"] > 0), "token distribution and coverage disagree")
        if tokens is not None:
            out += distribution_problems(tokens, f"{path}.tokensPerSession", cov["sessionsWithTotalTokens"], m.get("totalTokens"))
    need((m.get("earliestAt") is None) == (m.get("latestAt") is None), "half a time range")
    if m.get("earliestAt") is not None and m.get("latestAt") is not None:
        need(m["earliestAt"] <= m["latestAt"] and m["activeDays"] > 0 and m["activeMonths"] > 0, "time range and active days disagree")
    else:
        need(m["activeDays"] == 0 and m["activeMonths"] == 0, "active days without a time range")
    return out


# The keys of facts documents and what their parts may say.
CANDIDATE_KEYS = {"evidenceRef", "source", "startedAt", "endedAt", "models", "sessionType", "messageCount", "userTurns", "toolCalls", "inputTokens", "outputTokens", "totalTokens", "excerpts"}
EXCERPT_KEYS = {"role", "position", "text"}
ROLES, POSITIONS, SOURCES = {"user", "assistant"}, {"opening", "middle", "closing"}, {"codex", "claude_code"}
MOST_CANDIDATES, MOST_EXCERPTS, EXCERPT_POINTS = 8, 5, 280
METHOD, TAXONOMY = "agent_semantic_review_v1", "primary-topic-v1"
CLASSIFICATION_KEYS = {"method", "taxonomyVersion", "populationSha256", "denominator", "reviewedSessionCount", "assignments", "counts"}
ROOT_KEYS = {"formatVersion", "generatedAt", "overall", "bySource", "representativeCandidates", "topicReview", "topicClassification"}
REVIEW_KEYS = {"formatVersion", "generatedAt", "populationSha256", "sessionCount", "sessions"}
REVIEW_ROW_KEYS = {"evidenceRef", "source", "userEvidence", "technicalSignals", "primaryTopic"}
BINDING_KEYS = {"formatVersion", "populationSha256", "sessionCount", "evidenceRefs"}


def _sha(x) -> bool:
    return isinstance(x, str) and re.fullmatch("[0-9a-f]{64}", x) is not None


def _iso(x) -> bool:
    return isinstance(x, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{3})?Z", x) is not None


def binding_problems(b: dict, sessions: int) -> list[str]:
    """Broken rules of a review's binding in a facts document."""
    if not isinstance(b, dict) or set(b) != BINDING_KEYS:
        return ["topicReview: unknown or missing keys"]
    refs = b["evidenceRefs"]
    out = [] if _sha(b["populationSha256"]) else ["topicReview: no hash"]
    if b["formatVersion"] != "topic-review.v1":
        out.append("topicReview: another format")
    if any(re.fullmatch("topic-[0-9a-f]{12}-[0-9]{6,}", str(r)) is None for r in refs):
        out.append("topicReview: a reference of another form")
    if b["sessionCount"] != sessions or len(refs) != sessions:
        out.append("topicReview: another session count")
    if len(set(refs)) < len(refs):
        out.append("topicReview: doubled references")
    return out


def artifact_problems(a: dict) -> list[str]:
    """Broken rules of a review artifact's form; its evidence is checked by topics.review_problems."""
    if not isinstance(a, dict) or set(a) != REVIEW_KEYS:
        return ["review: unknown or missing keys"]
    rows = a["sessions"]
    out = [] if _sha(a["populationSha256"]) and _iso(a["generatedAt"]) else ["review: no hash or time"]
    if a["formatVersion"] != "topic-review.v1":
        out.append("review: another format")
    if not rows or len(rows) != a["sessionCount"]:
        out.append("review: another session count")
    if any(not isinstance(r, dict) or not set(r) <= REVIEW_ROW_KEYS or not {"evidenceRef", "source", "userEvidence", "primaryTopic"} <= set(r) for r in rows):
        return [*out, "review: a session with unknown or missing keys"]
    if len({r["evidenceRef"] for r in rows}) < len(rows):
        out.append("review: doubled references")
    return out


def classification_problems(c: dict, b: dict, by_source: dict) -> list[str]:
    """Broken rules of a topic classification: order, hash, denominator and counts that follow from its assignments."""
    from tallywood.operators.topics import TOPICS

    if set(c) != CLASSIFICATION_KEYS:
        return ["topicClassification: unknown or missing keys"]
    given = c["assignments"]
    counts = {t: sum(a["primaryTopic"] == t for a in given) for t in TOPICS}
    out = [] if (c["method"], c["taxonomyVersion"]) == (METHOD, TAXONOMY) else ["topicClassification: another method or taxonomy"]
    if any(set(a) != {"evidenceRef", "source", "primaryTopic"} for a in given):
        out.append("topicClassification: an assignment with unknown or missing keys")
    if [a["evidenceRef"] for a in given] != b["evidenceRefs"] or c["populationSha256"] != b["populationSha256"]:
        out.append("topicClassification: other sessions than the review's")
    if c["denominator"] != len(given) or c["reviewedSessionCount"] != len(given) or c["counts"] != counts:
        out.append("topicClassification: counts don't follow from the assignments")
    if {s: sum(a["source"] == s for a in given) for s in by_source} != {s: m["sessionCount"] for s, m in by_source.items()}:
        out.append("topicClassification: another number of sessions in a source")
    return out


def facts_problems(facts: dict) -> list[str]:
    """Broken rules of a facts document: its sets, that the whole is the sum of the sources, and its candidates."""
    from tallywood.functions.excerpts import normalized
    from tallywood.operators.samples import safe_models

    parts = facts.get("bySource") or {}
    out = [] if parts else ["no sources"]
    if not set(facts) <= ROOT_KEYS:
        out.append("unknown keys")
    if facts.get("formatVersion") != "facts.v1":
        out.append("another format")
    if not set(parts) <= SOURCES:
        out.append("unsupported source")
    if not _iso(facts.get("generatedAt")):
        out.append("no time")
    for name, m in {"overall": facts.get("overall") or {}, **parts}.items():
        out += metric_problems(m, name)
    if out:
        return out
    whole = facts["overall"]
    for k in ADDITIVE:
        if whole[k] != sum(m[k] for m in parts.values()):
            out.append(f"overall.{k} isn't the sum of the sources")
    for k in COVERAGE:
        if whole["tokenCoverage"][k] != sum(m["tokenCoverage"][k] for m in parts.values()):
            out.append(f"overall.tokenCoverage.{k} isn't the sum of the sources")
    for k in TOKENS:
        have = [m[k] for m in parts.values() if m.get(k) is not None]
        if whole.get(k) != (sum(have) if have else None):
            out.append(f"overall.{k} isn't the sum of the sources")
    for k, best in (("earliestAt", min), ("latestAt", max)):
        have = [m[k] for m in parts.values() if m.get(k)]
        if whole.get(k) != (best(have) if have else None):
            out.append(f"overall.{k} isn't that of the sources")
    if (bound := facts.get("topicReview")) is not None:
        out += binding_problems(bound, whole["sessionCount"])
    if (done := facts.get("topicClassification")) is not None:
        out += ["topicClassification without a review"] if bound is None else classification_problems(done, bound, parts)
    if len(facts.get("representativeCandidates") or ()) > MOST_CANDIDATES:
        out.append("too many candidates")
    for n, c in enumerate(facts.get("representativeCandidates") or (), 1):
        at = f"candidate {n}"
        if not set(c) <= CANDIDATE_KEYS or any(not set(e) == EXCERPT_KEYS for e in c.get("excerpts") or ()):
            out.append(f"{at}: unknown or missing keys")
            continue
        if not all(_whole(c.get(k)) for k in ("messageCount", "userTurns", "toolCalls")):
            out.append(f"{at}: no whole number of messages, turns or tool calls")
            continue
        if c["userTurns"] == 0:
            out.append(f"{at}: no user turn")
        if c.get("models") is not None and not c["models"]:
            out.append(f"{at}: an empty list of models")
        if c.get("startedAt") and c.get("endedAt") and c["startedAt"] > c["endedAt"]:
            out.append(f"{at}: ends before it starts")
        if c["userTurns"] > c["messageCount"]:
            out.append(f"{at}: more turns than messages")
        if c.get("models") is not None and (safe_models(c["models"]) or []) != list(c["models"]):
            out.append(f"{at}: an unsafe model name")
        if any(e["role"] not in ROLES or e["position"] not in POSITIONS or len(e["text"]) > EXCERPT_POINTS for e in c.get("excerpts") or ()):
            out.append(f"{at}: an excerpt's role, position or length")
        if c.get("evidenceRef") != f"candidate-{n:02d}":
            out.append(f"{at}: reference out of sequence")
        m = parts.get(c.get("source"))
        if m is None:
            out.append(f"{at}: unknown source")
        elif c["messageCount"] > m["messageCount"] or c["userTurns"] > m["turnCount"] or c["toolCalls"] > m["toolCallCount"]:
            out.append(f"{at}: more than its source has")
        if c.get("sessionType") != ("agentic" if c.get("toolCalls") else "conversation"):
            out.append(f"{at}: type and tool calls disagree")
        tokens = [c.get(k) for k in ("inputTokens", "outputTokens", "totalTokens")]
        if None not in tokens and tokens[2] != tokens[0] + tokens[1]:
            out.append(f"{at}: tokens don't add up")
        texts = c.get("excerpts") or ()
        if not 1 <= len(texts) <= MOST_EXCERPTS or not any(e["role"] == "user" for e in texts):
            out.append(f"{at}: bad number of excerpts")
        if any(normalized(e["text"]) != e["text"] for e in texts):
            out.append(f"{at}: an excerpt isn't normalized")
    return out
