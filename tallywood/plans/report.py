"""The report document of a facts document, and its generated parts."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from tallywood.operators.topics import TOPICS

FORMAT = "data-summary.v1"
TITLE = "# Coding Session Data Summary"
SAMPLES = "## Representative Session Samples"
NO_SAMPLES = "No representative samples were included."
HEADINGS = (TITLE, "## Executive Summary", "### Why This Data Is Valuable", "## Key Highlights", "## Descriptive Statistics", "### Overall", "### By Source", SAMPLES)
NAMES = {"codex": "Codex", "claude_code": "Claude Code"}

# The rows of each table, label and key.
SCALE = (
    ("Source files", "fileCount"), ("Source bytes", "totalBytes"), ("Sessions", "sessionCount"), ("Messages", "messageCount"), ("User turns", "turnCount"),
    ("Tool calls", "toolCallCount"), ("Input tokens (available Sessions)", "inputTokens"), ("Output tokens (available Sessions)", "outputTokens"),
    ("Total tokens (available Sessions)", "totalTokens"),
)
RANGE = (
    ("Earliest activity", "earliestAt"), ("Latest activity", "latestAt"), ("Active days", "activeDays"), ("Active months", "activeMonths"),
    ("Parsed JSON records", "parsedRecordCount"), ("Recognized source records", "recognizedRecordCount"), ("Malformed records", "malformedRecordCount"),
    ("Skipped supported files", "skippedFileCount"), ("Unsupported files", "unsupportedFileCount"), ("Token arithmetic mismatches", "tokenArithmeticMismatchCount"),
)
COVERED = (("Sessions with input tokens", "sessionsWithInputTokens"), ("Sessions with output tokens", "sessionsWithOutputTokens"), ("Sessions with total tokens", "sessionsWithTotalTokens"))
SPREAD = (("Turns per session", "turnsPerSession"), ("Tool calls per session", "toolCallsPerSession"), ("Tokens per session", "tokensPerSession"))


def shown(value) -> str:
    if value is None:
        return "unavailable"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def some(n: int, what: str) -> str:
    return f"{n} {what}" + "s" * (n != 1)


def rows(*cells: tuple, align: str = "--- | ---:", head: str = "Metric | Value") -> str:
    return "\n".join(f"| {c} |" for c in (head, align, *(" | ".join(map(str, r)) for r in cells)))


def metric_tables(m: dict, level: int) -> str:
    mark, cover = "#" * level, m["tokenCoverage"]
    spread = []
    for label, key in SPREAD:
        d = m.get(key)
        empty = not d or not d["sampleSize"]
        spread.append((label, 0, *["unavailable"] * 4) if empty else (label, *(shown(d[k]) for k in ("sampleSize", "p50", "p95", "mean", "max"))))
    coverage = rows(*[(a, shown(m.get(k))) for a, k in RANGE], *[(a, f"{cover[k]} / {cover['sessionCount']}") for a, k in COVERED])
    return "\n\n".join([
        f"{mark} Population and Scale", rows(*[(a, shown(m.get(k))) for a, k in SCALE]),
        f"{mark} Data Range and Coverage", coverage,
        f"{mark} Core Session Metrics", rows(*spread, align="--- | ---: | ---: | ---: | ---: | ---:", head="Metric | Sample size | p50 | p95 | Mean | Max"),
    ])


def share(n: int, whole: int) -> str:
    return str(Decimal(n / whole * 100).quantize(Decimal("0.01"), ROUND_HALF_UP))


def statistics(facts: dict) -> str:
    parts = ["### Overall", metric_tables(facts["overall"], 4), "### By Source"]
    for name, m in facts["bySource"].items():
        parts += [f"#### {NAMES.get(name, name)}", metric_tables(m, 5)]
    if done := facts.get("topicClassification"):
        whole = done["denominator"]
        parts += [
            "#### Primary Topic Distribution", f"Method `{done['method']}`, taxonomy `{done['taxonomyVersion']}`, over all {some(whole, 'session')}.",
            rows(*[(t, done["counts"][t], share(done["counts"][t], whole) + "%") for t in TOPICS], align="--- | ---: | ---:", head="Primary topic | Sessions | Share"),
        ]
    return "\n\n".join(parts)


def render(facts: dict) -> str:
    """The whole document, not yet reviewed for privacy and without samples."""
    if facts.get("topicReview") and not facts.get("topicClassification"):
        raise ValueError("the topic review hasn't been applied")
    o = facts["overall"]
    tokens = "No token totals are known." if o.get("totalTokens") is None else f"{shown(o['totalTokens'])} tokens are known for {o['tokenCoverage']['sessionsWithTotalTokens']} of {some(o['sessionCount'], 'session')}."
    held = "Excerpts may be quoted only from the redacted candidates below." if facts.get("representativeCandidates") else "It quotes no dialogue."
    topic = "Topics appear as counts and shares only." if facts.get("topicClassification") else "Topics aren't included."
    front = ["---", f"format_version: {FORMAT}", "privacy_reviewed: false", "sources:", *[f"  - {s}" for s in facts["bySource"]], f"generated_at: {facts['generatedAt']}", "---"]
    body = [
        TITLE, HEADINGS[1],
        f"{some(o['sessionCount'], 'coding session')} from {' and '.join(NAMES.get(s, s) for s in facts['bySource'])}, from {shown(o.get('earliestAt'))} to {shown(o.get('latestAt'))}. {tokens}",
        HEADINGS[2],
        f"- **Scale:** {some(o['turnCount'], 'human turn')} in real sessions.\n- **Tools:** {some(o['toolCallCount'], 'tool call')}, as counts and not as traces.\n- **Privacy:** {held} {topic} Paths and raw identifiers aren't included.",
        HEADINGS[3],
        f"- **Coverage:** {some(o['sessionCount'], 'session')} from {some(len(facts['bySource']), 'source')} in {some(o['fileCount'], 'file')}.\n"
        f"- **Interaction:** {some(o['turnCount'], 'human turn')}, {some(o['assistantMessageCount'], 'assistant message')}, median {o['turnsPerSession']['p50']} turns a session.\n"
        f"- **Tool use:** {some(o['toolCallCount'], 'tool call')}, median {o['toolCallsPerSession']['p50']} and at most {o['toolCallsPerSession']['max']} a session.",
        HEADINGS[4], statistics(facts), SAMPLES, NO_SAMPLES,
    ]
    return "\n".join(front) + "\n\n" + "\n\n".join(body) + "\n"
