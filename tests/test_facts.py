import datetime as dt
import json
import os

import pytest

from tallywood.operators import document, facts
from tallywood.operators.validation import facts_problems
from tallywood.plans import report
from tallywood.sources import logs
from tallywood.sources.logs import SourceInput, listing

NOW = dt.datetime(2026, 8, 1, tzinfo=dt.timezone.utc)


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def a(kind, at=None, **payload):
    return {"type": kind, "payload": payload, **({"timestamp": at} if at else {})}


def said(role, text, at=None):
    return a("response_item", at, type="message", role=role, content=[{"type": "input_text", "text": text}])


def b(role, content, at="2026-07-01T10:00:00Z", session="s1", **more):
    return {"type": role, "sessionId": session, "timestamp": at, "message": {"role": role, "content": content, **more}}


@pytest.fixture()
def both(tmp_path):
    one = lines(
        tmp_path / "a.jsonl", a("session_meta", "2026-06-30T23:00:00Z", id="x1", model="m-1"), said("user", "Please fix the parser now", "2026-06-30T23:01:00Z"),
        said("assistant", "The parser is fixed", "2026-07-01T00:01:00Z"), a("response_item", type="function_call", name="f", arguments="{}"),
        a("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": 100, "output_tokens": 40, "total_tokens": 140}}), "{broken",
    )
    two = lines(tmp_path / "b.jsonl", b("user", "Explain this module please"), b("assistant", [{"type": "text", "text": "It reads files"}, {"type": "tool_use", "id": "t", "name": "g", "input": {}}], model="m-2", usage={"input_tokens": 200, "output_tokens": 80}))
    return [SourceInput("codex", one), SourceInput("claude_code", two)]


def test_whole_set(spark, both):
    f = facts.facts(spark, both, NOW)
    o = f["overall"]
    assert [o[k] for k in ("fileCount", "sessionCount", "messageCount", "turnCount", "toolCallCount")] == [2, 2, 4, 2, 2]
    assert [o[k] for k in ("inputTokens", "outputTokens", "totalTokens")] == [300, 120, 420]
    assert [o[k] for k in ("parsedRecordCount", "recognizedRecordCount", "malformedRecordCount", "activeMonths")] == [7, 7, 1, 2]
    assert o["turnsPerSession"] == {"sampleSize": 2, "p50": 1, "p95": 1, "mean": 1.0, "max": 1}
    assert o["tokensPerSession"] == {"sampleSize": 2, "p50": 140, "p95": 280, "mean": 210.0, "max": 280}
    assert len(f["representativeCandidates"]) == 2 and f["representativeCandidates"][0]["models"] == ["m-1"]
    assert facts_problems(f) == []
    worse = json.loads(json.dumps(f))
    worse["overall"]["turnCount"] += 1
    assert facts_problems(worse)


def test_each_breach_is_named(spark, both):
    import copy

    from tallywood.operators.validation import artifact_problems, metric_problems

    f, artifact = facts.facts(spark, both, NOW, review=True, nonce="n")
    good = f["overall"]
    assert metric_problems(good, "x") == []
    for change, said in (
        ({"fileCount": 0}, "sessions without a file or a recognized record"), ({"recognizedRecordCount": 0}, "sessions without a file or a recognized record"),
        ({"activeMonths": good["activeDays"] + 1}, "more active months than days"), ({"earliestAt": "2024-01-01"}, "a time of another form"),
    ):
        assert f"x: {said}" in metric_problems({**good, **change}, "x")
    for change, said in (({"userTurns": 0}, "no user turn"), ({"models": []}, "an empty list of models"), ({"toolCalls": None}, "no whole number of messages, turns or tool calls")):
        worse = copy.deepcopy(f)
        worse["representativeCandidates"][0] |= change
        assert f"candidate 1: {said}" in facts_problems(worse)
    partial = copy.deepcopy(f)
    for k in ("inputTokens", "outputTokens"):
        partial["representativeCandidates"][0].pop(k, None)
    partial["representativeCandidates"][0]["totalTokens"] = 5
    assert facts_problems(partial) == []
    assert "review: another format" in artifact_problems({**artifact, "formatVersion": "other"})


def test_report_and_contract(spark, both):
    f = facts.facts(spark, both, NOW)
    text = report.render(f)
    ready = text.replace("privacy_reviewed: false", "privacy_reviewed: true")
    assert document.validate(ready.encode(), f)[1] == []
    assert ("PRIVACY_REVIEW_REQUIRED", 1) in document.validate(text.encode(), f)[1]
    assert ("FACTS_FILE_REQUIRED", 1) in document.validate(ready.encode())[1]
    codes = lambda t: {c for c, _ in document.validate(t.encode(), f)[1]}
    assert "GENERATED_STATISTICS_CHANGED" in codes(ready.replace("| Sessions | 2 |", "| Sessions | 3 |"))
    assert "LINK_NOT_ALLOWED" in codes(ready.replace(report.NO_SAMPLES, "see https://example.org"))
    assert "EMAIL" in codes(ready.replace(report.NO_SAMPLES, "ask a@example.org"))
    assert "INVALID_UTF8" in {c for c, _ in document.validate(b"\xff", f)[1]}
    assert "FILE_TOO_LARGE" in {c for c, _ in document.validate(b"a" * (document.MOST_BYTES + 1), f)[1]}
    c = f["representativeCandidates"][0]
    card = "\n".join([
        "### Example 1. A parser", "", "| Field | Value |", "| --- | --- |", f"| Evidence ref | {c['evidenceRef']} |", f"| Source | {report.NAMES[c['source']]} |", "| Model | m-1 |",
        f"| Session type | {c['sessionType']} |", f"| Total tokens | {c['totalTokens']} |", f"| User turns | {c['userTurns']} |", "", "**Tags:** one, two, three", "**Context:** c",
        "**Workflow and outcome:** w", "**Why it is valuable:** v", "**Data-governance note:** d", "**Representative quote:**", "> User: " + c["excerpts"][0]["text"],
    ])
    assert codes(ready.replace(report.NO_SAMPLES, card)) == set()
    assert "SAMPLE_QUOTE_MISMATCH" in codes(ready.replace(report.NO_SAMPLES, card + " indeed"))
    assert codes(ready.replace(report.NO_SAMPLES, card.replace("parser now", "[REDACTED] now"))) == set()
    assert "SAMPLE_TAGS" in codes(ready.replace(report.NO_SAMPLES, card.replace("one, two, three", "one, two")))
    assert "SAMPLE_FACT_MISMATCH" in codes(ready.replace(report.NO_SAMPLES, card.replace("| User turns | 1 |", "| User turns | 9 |")))


def test_review(spark, both):
    f, artifact = facts.facts(spark, both, NOW, review=True, nonce="n")
    assert [len(s["userEvidence"]) for s in artifact["sessions"]] == [1, 1]
    with pytest.raises(ValueError, match="incomplete"):
        facts.apply_review(spark, f, artifact)
    for s in artifact["sessions"]:
        s["primaryTopic"] = "backend"
    done = facts.apply_review(spark, f, artifact)
    assert facts_problems(done) == [] and facts_problems({**done, "extra": 1}) == ["unknown keys"]
    wrong = json.loads(json.dumps(done))
    wrong["topicClassification"]["counts"]["mobile"] = 1
    assert facts_problems(wrong) == ["topicClassification: counts don't follow from the assignments"]
    with pytest.raises(ValueError, match="keys"):
        facts.apply_review(spark, f, {**artifact, "extra": 1})
    assert done["topicClassification"]["counts"]["backend"] == 2 and "| backend | 2 | 100.00% |" in report.render(done)
    with pytest.raises(ValueError):
        report.render(f)
    artifact["populationSha256"] = "0" * 64
    with pytest.raises(ValueError, match="populationSha256"):
        facts.apply_review(spark, f, artifact)


def test_tokens_partial_and_absent(spark, tmp_path):
    p = lines(tmp_path / "b.jsonl", b("user", "first question here"), b("assistant", "x", usage={"input_tokens": 10, "output_tokens": 5, "total_tokens": 99}), b("user", "second one here", session="s2"))
    o = facts.facts(spark, [SourceInput("claude_code", p)], NOW)["overall"]
    assert (o["totalTokens"], o["tokensPerSession"]["sampleSize"], o["tokenArithmeticMismatchCount"]) == (15, 1, 1)
    p = lines(tmp_path / "c.jsonl", b("user", "no usage at all"))
    o = facts.facts(spark, [SourceInput("claude_code", p)], NOW)["overall"]
    assert "totalTokens" not in o and o["tokenCoverage"]["sessionsWithInputTokens"] == 0


def test_fallback_roles_and_exclusions(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", a("session_meta", id="q"), said("user", "hello there friend"), a("event_msg", type="user_message", message="hello there friend"), a("event_msg", type="agent_message", message="hi"))
    o = facts.facts(spark, [SourceInput("codex", p)], NOW)["overall"]
    assert (o["messageCount"], o["turnCount"], o["assistantMessageCount"]) == (2, 1, 1)
    p = lines(tmp_path / "b.jsonl", b("user", "a real question"), b("user", [{"type": "tool_result", "content": "r"}]), {**b("user", "side"), "isSidechain": True}, b("assistant", [{"type": "thinking", "text": "t"}, {"type": "text", "text": "answer"}]))
    o = facts.facts(spark, [SourceInput("claude_code", p)], NOW)["overall"]
    assert (o["parsedRecordCount"], o["recognizedRecordCount"], o["turnCount"]) == (4, 3, 1)


def test_files(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    lines(d / ".hidden.jsonl", b("user", "hidden but counted", session="h"))
    (d / "empty.jsonl").write_text("")
    (d / "w.json").write_text(json.dumps([b("user", "whole file record", session="w"), 5]))
    (d / "note.txt").write_text("x")
    p = lines(d / "z.jsonl", b("user", "last file", session="z"), "", '{"a":1} x')
    files, others, _ = listing(spark, [SourceInput("claude_code", str(d)), SourceInput("claude_code", p)])
    assert files.count() == 4 and others == {"claude_code": 1}
    o = facts.facts(spark, [SourceInput("claude_code", str(d))], NOW)["overall"]
    assert (o["fileCount"], o["sessionCount"], o["skippedFileCount"], o["malformedRecordCount"], o["unsupportedFileCount"]) == (4, 3, 1, 2, 1)
    with pytest.raises(ValueError, match="twice"):
        listing(spark, [SourceInput("claude_code", p), SourceInput("claude_code", p)])
    with pytest.raises(ValueError, match="unsupported"):
        listing(spark, [SourceInput("other", p)])
    lines(d / "z.jsonl", {"type": "system"})
    with pytest.raises(facts.EmptySource):
        facts.facts(spark, [SourceInput("claude_code", p)], NOW)


def test_evidence_is_trimmed_after_the_cut(spark):
    from tallywood.operators.topics import first_segments

    text = "a" * 599 + " b" + "c" * 50
    got = first_segments(spark.createDataFrame([("s", "x", 1, text)], "source string, session string, ordinal long, text string")).first()
    assert got.evidence == ["a" * 599]


def test_references_stay_whole(spark):
    from tallywood.operators.topics import padded

    rows = spark.createDataFrame([(7,), (1234567,)], "pos long").select(padded("pos", 6).alias("r")).collect()
    assert [r.r for r in rows] == ["000007", "1234567"]


def test_population_hash_is_over_json(spark):
    import hashlib
    import json

    from tallywood.operators.topics import population_sha256

    members = spark.createDataFrame([("b", "2"), ("a", "x\"y")], "source string, session string")
    said = json.dumps({"nonce": "n", "members": ["a\x00x\"y", "b\x002"]}, separators=(",", ":"), ensure_ascii=False)
    assert population_sha256(members, "n") == hashlib.sha256(said.encode()).hexdigest()
    assert population_sha256(members.limit(0), "n") == hashlib.sha256(b'{"nonce":"n","members":[]}').hexdigest()


def test_order_numbers_each_source(spark):
    from tallywood.operators.sessions import order

    rows = [("a", f"s{i:03d}", (i * 37) % 101) for i in range(101)] + [("b", "t", 5)]
    got = order(spark.createDataFrame(rows, "source string, session string, first_ordinal long")).collect()
    want = {("b", "t"): 0} | {(s, k): n for n, (s, k, _) in enumerate(sorted((r for r in rows if r[0] == "a"), key=lambda r: r[2]))}
    assert {(r.source, r.session): r.session_order for r in got} == want


def test_listing_finds_each_file_once(spark, tmp_path):
    root = tmp_path / ".root"
    for d in (root / "b" / ".deep", root / "[x]*"):
        d.mkdir(parents=True)
    lines(root / "b" / ".deep" / "one.jsonl", {"n": 1}, {"n": 2})
    lines(root / "b" / "Two.NDJSON", {"n": 3})
    lines(root / "[x]*" / "a b+%41.jsonl", {"n": 4})
    (root / "_w.json").write_text('[{"n":5},7]')
    (root / "_a=b.jsonl").write_text('{"n":6}\r\n\n{"n":8}')
    (root / "link.jsonl").symlink_to(root / "b" / "Two.NDJSON")
    (root / "no.txt").write_text("x")
    (tmp_path / "way").symlink_to(root)
    found, others, order = listing(spark, [SourceInput("codex", str(tmp_path / "way")), SourceInput("claude_code", str(root / "b" / ".deep")), SourceInput("codex", str(root / "b")), SourceInput("codex", str(root / "absent"))])
    assert others == {"codex": 1, "claude_code": 0} and order == ["codex", "claude_code"]
    assert sorted((r.source, os.path.relpath(r.path, root)) for r in found.collect()) == [
        ("claude_code", "b/.deep/one.jsonl"), ("codex", "[x]*/a b+%41.jsonl"), ("codex", "_a=b.jsonl"), ("codex", "_w.json"), ("codex", "b/.deep/one.jsonl"), ("codex", "b/Two.NDJSON")]
    got = logs.records(spark, found).selectExpr("source", "ordinal", "try_variant_get(v, '$.n', 'int') n").collect()
    by_rank = [r.n for r in sorted((r for r in got if r.source == "codex"), key=lambda r: r.ordinal)]
    assert by_rank == [6, 8, 5, None, 4, 1, 2, 3] and sorted(r.n for r in got if r.source == "claude_code") == [1, 2]
    assert sorted(logs.remote_entries(f"file://{root}/b")) == [(f"file://{root}/b/.deep", 0, "folder"), (f"file://{root}/b/Two.NDJSON", 9, "file")]
    assert logs.remote_entries(f"file://{root}/none") == []


def test_json_is_strict(spark):
    good = ["{}", ' {"a":1}\r', '{"a":1,"a":2}', '{"a":"\\ud800"}', '{"a":1e999,"b":[1,{"c":null}]}']
    bad = ["{'a':1}", '{"a":1} x', '{"a":1}{}', '{"a":1}] [', '{"a":1}} {', '{"a":1},{"b":2}', '{"a":1},"b":2', '{"a":01}', '{"a":NaN}', '{"a":1,}', '{"a":"\t"}', "[1]", "5", "null", '"{}"', '{"a":1} ', "{", "//x", '{"a":1} //x', '{"a":1} #x']
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad + ["", " \t \r"])], "k int, value string")
    got = {r.k: r.ok for r in logs.objects(frame, False).selectExpr("k", "v is not null ok").collect()}
    assert got == {k: k < len(good) for k in range(len(good + bad))}
    frame = spark.createDataFrame([(0, "[]"), (1, '[{"a":1}, 2, null, [{}]]'), (2, '{"a":1}'), (3, "[1] x"), (4, " "), (5, "[{}],[]")], "k int, value string")
    got = sorted((r.k, r.pos, r.ok) for r in logs.objects(frame, True).selectExpr("k", "pos", "v is not null ok").collect())
    assert got == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False), (2, 0, True), (3, 0, False), (4, 0, False), (5, 0, False)]


def test_hidden_lines_cross_blocks(tmp_path, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(logs, "CHUNK", 3)
    p = tmp_path / ".h.jsonl"
    p.write_bytes("é12345\n\n\r\nlast".encode())
    rows = pd.concat(logs._read(iter([pd.DataFrame({"path": [str(p)]})])))
    assert list(rows["value"]) == ["é12345", "", "\r", "last"] and list(rows["seq"]) == [0, 1, 2, 3]


def test_breaches_of_many_documents(spark):
    from tallywood.operators.breaches import breaches
    from tallywood.plans import facts_sql

    docs = spark.createDataFrame([(0, "some text", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    (base,) = [json.loads(r.json) for r in facts_sql.planted_facts(docs, labels).collect()]
    half = json.loads(json.dumps(base))
    half["overall"] |= {"fileCount": "4", "sessionCount": 4.0, "activeDays": 1.5}
    del half["overall"]["latestAt"]
    half["overall"]["tokenCoverage"]["sessionsWithTotalTokens"] = -1
    half["topicReview"]["evidenceRefs"].append("topic-x")
    short = json.loads(json.dumps(base))
    short["topicClassification"]["assignments"].pop()
    short["representativeCandidates"][0] |= {"models": [], "excerpts": [], "toolCalls": 0}
    rows = [(1, json.dumps(base)), (2, json.dumps(half)), (3, json.dumps(short)), (4, json.dumps(base) + " {"), (5, None), (6, "{}")]
    found = {(r.doc, r.path, r.rule) for r in breaches(spark.createDataFrame(rows, "doc int, json string")).collect()}
    assert not [f for f in found if f[0] == 1]
    assert {f[1:] for f in found if f[0] in (4, 5)} == {("$", "no object")} and len([f for f in found if f[0] in (4, 5)]) == 2
    assert {f[1] for f in found if f[0] == 6 and f[2] == "missing key"} == {"$.formatVersion", "$.generatedAt", "$.overall", "$.bySource"}
    assert {("$.overall.fileCount", "no whole number"), ("$.overall.activeDays", "no whole number"), ("$.overall", "half a time range"), ("$.topicReview", "another session count"),
            ("$.overall.tokenCoverage.sessionsWithTotalTokens", "no whole number"), ("$.topicReview.evidenceRefs[4]", "a reference of another form"),
            ("$.topicClassification.assignments[4]", "another session than the review's")} <= {f[1:] for f in found if f[0] == 2}
    assert ("$.overall.sessionCount", "no whole number") not in {f[1:] for f in found}
    card = "$.representativeCandidates[0]"
    assert {(card, "an empty list of models"), (card, "bad number of excerpts"), (card, "type and tool calls disagree"), ("$.topicClassification.assignments[3]", "another session than the review's"),
            ("$.topicClassification", "another number of sessions"), ("$.bySource.claude_code", "another number of assignments than sessions")} <= {f[1:] for f in found if f[0] == 3}


def test_breaches_read_each_number_once(spark):
    """No kind of number is told by looking a member up again and again."""
    from tallywood.operators import breaches as b

    odd = ["5", "5.0", "5.5", "-1", "\"5\"", "\"NaN\"", "true", "null", "9007199254740991", "9007199254740992", "1e3", "1e999", "[5]", "{\"a\": 5}", "123456789012345678901234567890", "-0"]
    whole = [5, 5, None, None, None, None, None, None, 9007199254740991, None, 1000, None, None, None, None, 0]
    sets = [f'{{"messageCount": {x}, "userMessageCount": 1, "tokenCoverage": {{"sessionCount": {x}}}, "turnsPerSession": {{"p50": {x}, "p95": 2}}, "toolCallsPerSession": {x}}}' for x in odd]
    docs = spark.createDataFrame([(k, f'{{"overall": {s}, "bySource": {{"codex": [{s}]}}}}') for k, s in enumerate(sets)], "doc int, json string").selectExpr("doc", "parse_json(json) AS v")
    got = b.measured(b.objects(docs, "set"))
    rows = {(r.doc, r.source): r for r in got.collect()}
    for k, n in enumerate(whole):
        r, none = rows[k, None], rows[k, "codex"]
        assert [r.messageCount, r.c_sessionCount, r.turnsPerSession_p50, r.userMessageCount, r.turnsPerSession_p95] == [n, n, n, 1, 2], odd[k]
        assert none.messageCount is None and none.userMessageCount is None
    assert got._jdf.queryExecution().optimizedPlan().toString().count("schema_of_variant") <= 8
