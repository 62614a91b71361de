"""Sample cards bound by joins, against the document contract's own check and by hand."""

import random

from tallywood.operators import document, quotes

CODES = {
    "SAMPLE_EVIDENCE_REF", "DUPLICATE_SAMPLE_EVIDENCE", "SAMPLE_QUOTE_FORMAT", "SAMPLE_QUOTE_REQUIRED", "SAMPLE_TRANSLATION_ROLE", "SAMPLE_TRANSLATION_ENGLISH",
    "UNBOUND_SAMPLE_TRANSLATION", "SAMPLE_QUOTE_MISMATCH", "NON_ENGLISH_ORIGINAL_NOT_ALLOWED",
}
DOCS = "path string, text string"
POOL = "path string, evidence_ref string, excerpts array<struct<role:string,text:string>>"
PIECES = ["[REDACTED]", "fix", "the build", "it", "a.b", "\\E", "да", "é", " ", "2"]


def card(k: int, ref: str, said: list[str]) -> list[str]:
    fields = {"Evidence ref": ref, "Source": "Codex", "Model": "m", "Session type": "agentic", "Total tokens": "unavailable", "User turns": "1"}
    table = ["| Field | Value |", "| --- | --- |", *[f"| {f} | {v} |" for f, v in fields.items()]]
    return [f"### Example {k}. A title", *table, "**Tags:** a, b, c", *[f"**{label}:** x" for label in document.LABELS[1:-1]], f"**{document.LABELS[-1]}:**", *said]


def some_text(r: random.Random) -> str:
    return " ".join(r.choice(PIECES) for _ in range(r.randint(1, 5))).strip()


def made(seed: int):
    r = random.Random(seed)
    pool = [{"evidenceRef": f"candidate-0{k}", "source": "codex", "models": ["m"], "sessionType": "agentic", "userTurns": 1, "excerpts": [{"role": r.choice(["user", "assistant"]), "text": some_text(r)} for _ in range(3)]} for k in (1, 2)]
    told = [e for c in pool for e in c["excerpts"]]
    lines = ["# Title", "```", "## Representative Session Samples", "```", "## Representative Session Samples"]
    for k in range(1, r.randint(2, 4)):
        said = []
        for _ in range(r.randint(0, 5)):
            e = r.choice(told)
            words = r.choice([e["text"], e["text"].replace("the", "[REDACTED]"), e["text"].replace(" ", "[REDACTED]", 1), some_text(r)])
            tail = r.choice(["", "", "", " (user, translated)", " (Assistant, translated)"])
            said.append(r.choice(["> ", ">", "> ", "~ "]) + r.choice(["User: ", "Assistant: ", "User:  ", "Nobody: "]) + words + tail)
        lines += card(k, f"candidate-0{r.randint(1, 3)}", [*said, "", ">"])
    return (r.choice(["\n", "\r\n"]).join([*lines, "## End", "> User: not a quote of a card"]), pool)


def test_same_as_the_contract(spark):
    all_ = [made(k) for k in range(120)]
    want = set()
    for k, (text, pool) in enumerate(all_):
        lines, _ = document.scan(text)
        want |= {(str(k), c, n) for c, n in document.sample_issues(lines, {"representativeCandidates": pool})[1] if c in CODES}
    docs = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(all_)], DOCS)
    pool = spark.createDataFrame([(str(k), c["evidenceRef"], [(e["role"], e["text"]) for e in c["excerpts"]]) for k, (_, p) in enumerate(all_) for c in p], POOL)
    found = quotes.cards(docs)
    got = {(r.path, r.code, r.line) for r in quotes.binding_issues(found, pool).collect()}
    assert got == want
    assert {c for _, c, _ in want} == CODES


def test_hidden_spans(spark):
    r = random.Random(7)
    pairs = [("", ""), ("abc", "[REDACTED]"), ("abcd", "abc[REDACTED]"), ("abc", "abc[REDACTED]"), ("xabcx", "[REDACTED]abc[REDACTED]"), ("abcab", "[REDACTED][REDACTED]cab"), ("abab", "ab[REDACTED]ab"), ("aXbaXb1", "a[REDACTED]b[REDACTED]1")]
    pairs += [(document.one_line("".join(r.choice(["a", "b", "ab", "1", "😀"]) for _ in range(r.randint(1, 9)))), "".join(r.choice(["a", "b", "ab", "[REDACTED]", "1", "😀"]) for _ in range(r.randint(1, 7)))) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "e string, q string")
    for row in df.select("e", "q", quotes.matches(df.e, df.q).alias("m")).collect():
        assert row.m == document.quote_matches(row.e, row.q), row


def test_nulls_and_empty(spark):
    good = "\n".join(["## Representative Session Samples", *card(1, "candidate-01", ["> User: fix it now"])])
    docs = spark.createDataFrame([("a", good, 1), ("b", None, 2), (None, good, 3), ("c", "", 4), ("d", good, 5)], DOCS + ", ref int")
    pool = spark.createDataFrame([("a", "candidate-01", [("user", "fix it now"), ("user", None), (None, "x")], 1), ("a", "candidate-01", None, 2), (None, "candidate-01", [("user", "fix it now")], 3), ("d", "candidate-01", None, 4), ("d", "candidate-02", [], 5)], POOL + ", top int")
    found = quotes.cards(docs)
    got = sorted((str(r.path), r.code) for r in quotes.binding_issues(found, pool).collect())
    assert got == [("None", "SAMPLE_EVIDENCE_REF"), ("d", "SAMPLE_QUOTE_MISMATCH")]
    assert [(r.path, r.ref) for r in quotes.unused(found, pool).filter("path is not null").collect()] == [("d", "candidate-02")]
    assert quotes.binding_issues(quotes.cards(docs.limit(0)), pool.limit(0)).count() == 0


def test_two_refs_in_a_table_are_left_to_its_own_rule(spark):
    text = "\n".join(["## Representative Session Samples", "### Example 1. A title", "| Evidence ref | candidate-01 |", "| Evidence ref | candidate-02 |"])
    assert quotes.cards(spark.createDataFrame([("a", text)], DOCS)).count() == 0
