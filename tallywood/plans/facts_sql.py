"""Facts documents made from `documents` and `labels`, one for each row, a rule broken in most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.operators.topics import TOPICS
from tallywood.sources.staging import spread

KINDS = 24  # doc_id modulo this says which rule is broken; 0 breaks none

#: What each kind adds to, or puts in place of, a part of the document.
CODEX = {"messageCount": "if(k = 4, 1, 0)", "fileCount": "if(k = 23, -2, 0)", "mean": "if(k = 8, -0.1D, 0D)"}
WHOLE = {"activeMonths": "if(k = 5, 1, 0)", "p95": "if(k = 7, -b, 0)", "totalTokens": "if(k = 21, 1, 0)"}


def _distribution(n: str, low: str, high: str, total: str, p95: str = "0", mean: str = "0D") -> str:
    return f"named_struct('sampleSize', {n}, 'p50', {low}, 'p95', {high} + {p95}, 'mean', ({total}) / {n} + {mean}, 'max', {high})"


def _set(n: int, low: str, high: str, total: str, size: str, more: dict, turns: str, first: str) -> str:
    add = lambda k: more.get(k, "0")
    tens = lambda x: f"11 * ({x})"
    p95 = add("p95").replace("-b", f"-({high})")
    return f"""named_struct('fileCount', {n} + {add('fileCount')}, 'totalBytes', {size}, 'sessionCount', {n}, 'messageCount', 2 * ({total}) + {add('messageCount')},
      'userMessageCount', {total}, 'assistantMessageCount', {total}, 'turnCount', {turns}, 'toolCallCount', {total}, 'parsedRecordCount', 3 * ({total}),
      'recognizedRecordCount', 2 * ({total}), 'malformedRecordCount', 0, 'skippedFileCount', 0, 'unsupportedFileCount', 0, 'tokenArithmeticMismatchCount', 0,
      'activeDays', 1, 'activeMonths', 1 + {add('activeMonths')}, 'inputTokens', 10 * ({total}), 'outputTokens', {total}, 'totalTokens', {tens(total)} + {add('totalTokens')},
      'earliestAt', {first}, 'latestAt', '2026-01-01T10:00:00Z',
      'tokenCoverage', named_struct('sessionCount', {n}, 'sessionsWithInputTokens', {n}, 'sessionsWithOutputTokens', {n}, 'sessionsWithTotalTokens', {n}),
      'turnsPerSession', {_distribution(str(n), low, high, total, p95, more.get('mean', '0D'))}, 'toolCallsPerSession', {_distribution(str(n), low, high, total)},
      'tokensPerSession', {_distribution(str(n), tens(low), tens(high), tens(total))})"""


def planted_facts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc and json of a facts document for each row: two sources of two sessions, sizes from the text, topics from the label."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = documents.join(good, "doc_id", "left").selectExpr(
        "doc_id AS doc", f"doc_id % {KINDS} AS k", "1 + doc_id % 5 AS t", "1 + doc_id % 5 + coalesce(length(text), 0) % 7 AS u", "coalesce(length(text), 0) AS n",
        "coalesce(quality, 0) AS q", "sha2(cast(doc_id AS string), 256) AS sha",
    )
    time = "'2026-01-01T09:00:00Z'"
    codex = _set(2, "t", "u", "t + u", "n", CODEX, "if(k = 6, null, t + u)", time)
    claude = _set(2, "u", "u + 1", "2 * u + 1", "n", {}, "2 * u + 1", time)
    overall = _set(4, "u", "u + 1", "t + 3 * u + 1", "2 * n", WHOLE, "t + 3 * u + 1", f"if(k = 22, '2026-01-01 09:00', {time})")
    refs = "transform(sequence(1, 4), i -> concat('topic-', left(sha, 12), '-', lpad(i, 6, '0')))"
    seen = f"transform({refs}, (r, i) -> if(k = 15 AND i = 1, concat('topic-', left(sha, 12), '-000001'), r))"
    topic = f"if(i = 0 AND q = 1, '{TOPICS[1]}', if(k = 16 AND i = 1, '{TOPICS[2]}', '{TOPICS[0]}'))"
    given = f"transform({refs}, (r, i) -> named_struct('evidenceRef', r, 'source', if(i < if(k = 18, 3, 2), 'codex', 'claude_code'), 'primaryTopic', {topic}))"
    counts = ", ".join([f"'{TOPICS[0]}', 4 - q", f"'{TOPICS[1]}', q", *[f"'{t}', 0" for t in TOPICS[2:]]])
    excerpt = "array(named_struct('role', if(k = 14, 'system', 'user'), 'position', 'opening', 'text', if(k = 13, ' hello there', 'hello there')))"
    card = f"""named_struct('evidenceRef', if(k = 9, 'candidate-02', 'candidate-01'), 'source', if(k = 11, 'other', 'codex'), 'sessionType', 'agentic',
      'messageCount', if(k = 12, 1000000, 2 * t), 'userTurns', if(k = 10, 0, t), 'toolCalls', t, 'models', array('model-a'), 'excerpts', {excerpt})"""
    whole = f"""named_struct('formatVersion', if(k = 2, 'facts.v0', 'facts.v1'), 'generatedAt', if(k = 3, '2026-01-01', {time}), 'overall', {overall},
      'bySource', named_struct('codex', {codex}, 'claude_code', {claude}), 'representativeCandidates', array({card}),
      'topicReview', named_struct('formatVersion', 'topic-review.v1', 'populationSha256', sha, 'sessionCount', 4, 'evidenceRefs', {seen}),
      'topicClassification', named_struct('method', 'agent_semantic_review_v1', 'taxonomyVersion', 'primary-topic-v1', 'populationSha256', if(k = 17, reverse(sha), sha),
        'denominator', 4, 'reviewedSessionCount', 4, 'assignments', {given}, 'counts', named_struct({counts})), 'more', if(k = 1, 1, null))"""
    return spread(d).selectExpr("doc", f"CASE k WHEN 19 THEN '[]' WHEN 20 THEN null ELSE to_json({whole}) END AS json")


#: (kind, path, rule) of every breach, for the SQL; `sum` rows follow from a part that differs.
PLANTED = [
    (1, "$.more", "unknown key"), (2, "$", "another format"), (3, "$", "no time"),
    (4, "$.bySource.codex", "messages aren't user + assistant"), (4, "$.overall.messageCount", "doesn't follow from the sources"),
    (5, "$.overall", "more active months than days"), (6, "$.bySource.codex.turnCount", "missing key"), (6, "$.overall.turnCount", "doesn't follow from the sources"),
    (7, "$.overall.turnsPerSession", "values out of order"), (8, "$.bySource.codex.turnsPerSession", "mean doesn't fit the total"),
    (9, "$.representativeCandidates[0]", "reference out of sequence"), (10, "$.representativeCandidates[0]", "no user turn"), (11, "$.representativeCandidates[0]", "unknown source"),
    (12, "$.representativeCandidates[0]", "more than its source has"), (13, "$.representativeCandidates[0].excerpts[0]", "isn't normalized"),
    (14, "$.representativeCandidates[0].excerpts[0]", "unknown role"), (14, "$.representativeCandidates[0]", "bad number of excerpts"),
    (15, "$.topicReview.evidenceRefs: <ref>", "doubled reference"), (15, "$.topicClassification.assignments[1]", "another session than the review's"),
    (16, f"$.topicClassification.counts.{TOPICS[0]}", "doesn't follow from the assignments"), (16, f"$.topicClassification.counts.{TOPICS[2]}", "doesn't follow from the assignments"),
    (17, "$.topicClassification", "another hash than the review's"),
    (18, "$.bySource.codex", "another number of assignments than sessions"), (18, "$.bySource.claude_code", "another number of assignments than sessions"),
    (19, "$", "no object"), (20, "$", "no object"),
    (21, "$.overall", "token totals don't add up"), (21, "$.overall.tokensPerSession", "mean doesn't fit the total"), (21, "$.overall.totalTokens", "doesn't follow from the sources"),
    (22, "$.overall", "a time of another form"), (22, "$.overall.earliestAt", "doesn't follow from the sources"),
    (23, "$.bySource.codex", "sessions without a file or a recognized record"), (23, "$.overall.fileCount", "doesn't follow from the sources"),
]
_VALUES = ", ".join("({}, '{}', '{}')".format(k, p, r.replace("'", "''")) for k, p, r in PLANTED)
SQL = f"""SELECT doc_id AS doc, replace(path, '<ref>', 'topic-' || left(sha256(doc_id::VARCHAR), 12) || '-000001') AS path, rule
  FROM documents JOIN (VALUES {_VALUES}) AS p(k, path, rule) ON doc_id % {KINDS} = k"""
