"""Contract of the report document: every breach is a row (path, code, line), none stops the others."""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.functions.excerpts import trim
from tallywood.functions.redaction import detect_text, redact_text
from tallywood.functions.textrules import SPACE
from tallywood.plans import report
from tallywood.sources.logs import SOURCES

MOST_BYTES = 16 * 1024 * 1024
FIELDS = ("Evidence ref", "Source", "Model", "Session type", "Total tokens", "User turns")
LABELS = ("Tags", "Context", "Workflow and outcome", "Why it is valuable", "Data-governance note", "Representative quote")
HIDDEN = "[REDACTED]"
_HTML = re.compile(r"</?[a-z][a-z0-9-]*(?:\s[^>]*)?>", re.I)
_LINKS = re.compile(r"!?\[[^\]\n]*\](?:\([^\n)]*\)|\[[^\]\n]*\])|^\s{0,3}\[[^\]\n]+\]:\s*\S+|<(?:https?|ftp|file|s3|mailto):[^>]+>|\b(?:https?|ftp|file|s3)://|(?:^|[\s(])//[A-Za-z0-9]", re.I | re.M)


class Line:
    """A line with its number from 1, start offset and whether it belongs to a fence."""

    __slots__ = ("at", "fenced", "n", "text")

    def __init__(self, text: str, n: int, at: int, fenced: bool):
        self.text, self.n, self.at, self.fenced = text, n, at, fenced


def scan(text: str) -> tuple[list[Line], list[int]]:
    """All lines and the numbers of those that open or close a fence."""
    out, marks, mark, at = [], [], None, 0
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.removesuffix("\r")
        m = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        inside = mark is not None
        if m:
            marks.append(n)
            if mark is None:
                mark = m[1]
            elif m[1][0] == mark[0] and len(m[1]) >= len(mark):
                mark = None
        out.append(Line(line, n, at, inside or m is not None))
        at += len(raw) + 1
    return out, marks


def front_matter(text: str) -> tuple[dict, list[tuple[str, int]]]:
    """Scalars and lists of the block between the first two `---` lines."""
    lines = re.split(r"\r?\n", text)
    if lines[0] != "---":
        return {}, [("MISSING_FRONT_MATTER", 1)]
    if "---" not in lines[1:]:
        return {}, [("INVALID_FRONT_MATTER", 1)]
    bare = lambda s: re.sub(r"^['\"]|['\"]$", "", s)
    out, issues, current = {}, [], None
    for n, line in enumerate(lines[1 : lines.index("---", 1)], 2):
        if m := re.fullmatch(r"([a-z0-9_]+):(?:\s*(.*))?", line):
            value = bare((m[2] or "").strip())
            current = None if value else m[1]
            out[m[1]] = value or []
        elif (m := re.fullmatch(r"\s+-\s+(.+?)\s*", line)) and current:
            out[current].append(bare(m[1]))
        elif line.strip():
            issues.append(("INVALID_FRONT_MATTER", n))
    return out, issues


def headings(lines: list[Line], text: str) -> list[Line]:
    return [x for x in lines if not x.fenced and x.text == text]


def sample_range(text: str, lines: list[Line]) -> tuple[int, int, int] | None:
    """Start and end offsets of the sample section and its heading's line."""
    head = headings(lines, report.SAMPLES)
    if not head:
        return None
    after = [x for x in lines if x.n > head[0].n and not x.fenced and re.match(r"##\s", x.text)]
    return head[0].at + len(head[0].text), after[0].at if after else len(text), head[0].n


def _without_tables(text: str) -> tuple[str, dict[str, str]]:
    """Table rows give way to marks that no rule matches."""
    kept: dict[str, str] = {}

    def put(m):
        k = len(kept)
        while f"HELDTABLEROW{k}END" in text:
            k += 1_000_003
        kept[f"HELDTABLEROW{k}END"] = m[0]
        return f"HELDTABLEROW{k}END"

    return re.sub(r"^\|[^\r\n]*\|[ \t]*$", put, text, flags=re.M), kept


def redact_samples(text: str) -> tuple[str, dict[str, int]]:
    """The document with only its sample section redacted, table rows left alone."""
    lines, _ = scan(text)
    span = sample_range(text, lines)
    if span is None:
        return text, {}
    a, b, _ = span
    bare, kept = _without_tables(text[a:b])
    clean, counts = redact_text(bare)
    for mark, row in kept.items():
        clean = clean.replace(mark, row, 1)
    return text[:a] + clean + text[b:], counts


def one_line(text: str) -> str:
    return trim(re.sub(f"[{SPACE}]+", " ", text))


def quote_matches(excerpt: str, quote: str) -> bool:
    """Equal, or equal but for hidden spans, with three letters or digits left to see."""
    excerpt, quote = one_line(excerpt), one_line(quote)
    if excerpt == quote:
        return True
    parts = quote.split(HIDDEN)
    if len(parts) < 2 or sum(c.isalnum() for c in " ".join(parts)) < 3:
        return False
    return re.fullmatch(".+?".join(map(re.escape, parts)), excerpt) is not None


def non_latin(text: str) -> bool:
    """Whether there is a letter of another script than Latin."""
    import regex

    return regex.search(r"[\p{L}--\p{Script=Latin}]", text, flags=regex.V1) is not None


def cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip()[1:-1].split("|")]


def card_issues(card: list[Line], pool: dict[str, dict], used: set[str]) -> list[tuple[str, int]]:
    """Breaches of one sample card; its heading is the first line."""
    top = card[0].n
    blocks: list[list[Line]] = []
    for k, x in enumerate(card):
        if not x.fenced and re.fullmatch(r"\|.*\|\s*", x.text):
            if k and blocks and blocks[-1][-1].n == x.n - 1:
                blocks[-1].append(x)
            else:
                blocks.append([x])
    if len(blocks) != 1:
        return [("SAMPLE_METADATA_TABLE", top)]
    table = blocks[0]
    ruler = cells(table[1].text) if len(table) > 1 else []
    if cells(table[0].text) != ["Field", "Value"] or len(ruler) != 2 or not all(re.fullmatch(":?-{3,}:?", c) for c in ruler):
        return [("SAMPLE_METADATA_TABLE", table[0].n)]
    pairs = [(x.n, cells(x.text)) for x in table[2:]]
    out = [("SAMPLE_METADATA_TABLE", n) for n, c in pairs if len(c) != 2]
    values: dict[str, list[str]] = {}
    for _, c in pairs:
        if len(c) == 2:
            values.setdefault(c[0], []).append(c[1])
    out += [("SAMPLE_METADATA_FIELD", top) for f in FIELDS if len(values.get(f, ())) != 1]
    out += [("SAMPLE_METADATA_FIELD", top) for f in values if f not in FIELDS]
    if out:
        return out
    ref = values["Evidence ref"][0]
    c = pool.get(ref)
    if c is None:
        return [("SAMPLE_EVIDENCE_REF", top)]
    if ref in used:
        out.append(("DUPLICATE_SAMPLE_EVIDENCE", top))
    used.add(ref)
    told = {"Source": report.NAMES.get(c["source"], c["source"]), "Model": ", ".join(c["models"]) if c.get("models") else "unavailable", "Session type": c["sessionType"], "Total tokens": report.shown(c.get("totalTokens")), "User turns": str(c["userTurns"])}
    out += [("SAMPLE_FACT_MISMATCH", top) for f, v in told.items() if values[f][0] != v]
    if any(r != ref for r in re.findall(r"\bcandidate-\d{2}\b", "\n".join(x.text for x in card))):
        out.append(("MIXED_SAMPLE_EVIDENCE", top))
    places = []
    for label in LABELS:
        found = [(k, m) for k, x in enumerate(card) if not x.fenced and (m := re.fullmatch(rf"\*\*{re.escape(label)}:\*\*(?:\s+(.*))?", x.text))]
        if len(found) != 1:
            out.append(("SAMPLE_REQUIRED_CONTENT", top))
        elif label != LABELS[-1] and not one_line(found[0][1][1] or ""):
            out.append(("SAMPLE_REQUIRED_CONTENT", card[found[0][0]].n))
        places.append(next((k for k, x in enumerate(card) if x.text.startswith(f"**{label}:**")), -1))
    if min(places) < 0 or any(b <= a for a, b in zip(places, places[1:])):
        out.append(("SAMPLE_CONTENT_ORDER", top))
    if places[0] >= 0:
        tags = [t.strip().lower() for t in card[places[0]].text[len("**Tags:**") :].split(",") if t.strip()]
        if not 3 <= len(tags) <= 6 or len(set(tags)) < len(tags):
            out.append(("SAMPLE_TAGS", card[places[0]].n))
    quotes = []
    start = next((k for k, x in enumerate(card) if x.text == f"**{LABELS[-1]}:**"), len(card))
    for x in card[start + 1 :]:
        if not x.text.startswith(">"):
            if x.text.strip():
                out.append(("SAMPLE_QUOTE_FORMAT", x.n))
            continue
        said = re.sub(r"^>\s?", "", x.text).strip()
        if not said:
            continue
        m = re.fullmatch(r"(User|Assistant):\s+(.+)", said)
        if not m:
            out.append(("SAMPLE_QUOTE_FORMAT", x.n))
            continue
        role, words = m[1].lower(), m[2]
        t = re.search(r"\s+\((user|assistant), translated\)$", words, re.I)
        if t and t[1].lower() != role:
            out.append(("SAMPLE_TRANSLATION_ROLE", x.n))
        quotes.append((role, one_line(words[: t.start()] if t else words), bool(t), x.n))
    if not quotes:
        out.append(("SAMPLE_QUOTE_REQUIRED", top))
    for role, words, translated, n in quotes:
        own = [e["text"] for e in c["excerpts"] if e["role"] == role]
        if translated:
            if not re.search("[A-Za-z]", words) or non_latin(words):
                out.append(("SAMPLE_TRANSLATION_ENGLISH", n))
            if not any(map(non_latin, own)):
                out.append(("UNBOUND_SAMPLE_TRANSLATION", n))
        else:
            hits = [e for e in own if quote_matches(e, words)]
            if not hits:
                out.append(("SAMPLE_QUOTE_MISMATCH", n))
            if non_latin(words) or any(map(non_latin, hits)):
                out.append(("NON_ENGLISH_ORIGINAL_NOT_ALLOWED", n))
    return out


def sample_issues(lines: list[Line], facts: dict | None) -> tuple[int, list[tuple[str, int]]]:
    """Number of sample cards and the section's breaches."""
    out, allowed = [], set()
    head = headings(lines, report.SAMPLES)
    example = lambda x: not x.fenced and re.match(r"###\s+(?:Example|Sample)\b", x.text, re.I)
    first = lines.index(head[0]) if head else len(lines)
    last = next((k for k in range(first + 1, len(lines)) if not lines[k].fenced and re.match(r"##\s", lines[k].text)), len(lines))
    section = lines[first + 1 : last]
    cards = [x for x in section if example(x)]
    if head:
        other = [x for x in section if not x.fenced and re.match(r"###\s", x.text) and not example(x)]
        out += [("SAMPLE_HEADING", x.n) for x in other[:1]]
        stray = [x for k, x in enumerate(lines) if example(x) and not first < k < last]
        out += [("SAMPLE_OUTSIDE_SECTION", x.n) for x in stray[:1]]
        out += [("TOO_MANY_SAMPLES", x.n) for x in cards[3:4]]
        pool = {c["evidenceRef"]: c for c in (facts or {}).get("representativeCandidates") or ()}
        if cards and not pool:
            out.append(("SAMPLE_CANDIDATES_REQUIRED", cards[0].n))
        good = []
        for x in cards:
            m = re.fullmatch(r"### Example (\d+)\.\s+(.+\S)\s*", x.text)
            if m:
                good.append((x, int(m[1])))
            else:
                out.append(("SAMPLE_HEADING", x.n))
        out += [("SAMPLE_NUMBERING", x.n) for k, (x, n) in enumerate(good, 1) if n != k]
        used: set[str] = set()
        starts = [section.index(x) for x, _ in good]
        for a, b in zip(starts, [*starts[1:], len(section)]):
            card = section[a:b]
            quote = next((k for k, x in enumerate(card) if x.text == f"**{LABELS[-1]}:**"), len(card))
            allowed.update(x.n for x in card[quote + 1 :] if x.text.startswith(">"))
            out += card_issues(card, pool, used)
    loose = [x for x in lines if not x.fenced and re.match(r"\s{0,3}>", x.text) and x.n not in allowed]
    return len(cards), out + [("UNBOUND_BLOCK_QUOTE", x.n) for x in loose[:1]]


def binding_issues(text: str, lines: list[Line], sources: list[str], reviewed: bool, facts: dict | None) -> list[tuple[str, int]]:
    """Everything but the sample section must be what the facts render to."""
    if facts is None:
        return [("FACTS_FILE_REQUIRED", 1)]
    out = [] if sorted(sources) == sorted(facts["bySource"]) else [("FACTS_SOURCE_MISMATCH", 1)]
    want = report.render(facts).replace("privacy_reviewed: false", f"privacy_reviewed: {str(reviewed).lower()}", 1)
    head, _, tail = want.partition(report.NO_SAMPLES)
    if not (text.startswith(head) and text.endswith(tail) and len(text) >= len(head) + len(tail)):
        out.append(("GENERATED_CONTENT_CHANGED", 1))
    spots = [headings(lines, h) for h in ("## Descriptive Statistics", "### Overall", report.SAMPLES)]
    if not all(spots):
        out.append(("MISSING_GENERATED_STATISTICS", 1))
    elif not spots[0][0].n < spots[1][0].n < spots[2][0].n:
        out.append(("GENERATED_STATISTICS_LOCATION", 1))
    elif text[spots[1][0].at : spots[2][0].at].rstrip() != report.statistics(facts):
        out.append(("GENERATED_STATISTICS_CHANGED", 1))
    return out


def validate(content: bytes, facts: dict | None = None) -> tuple[dict, list[tuple[str, int]]]:
    """Metadata and all breaches (code, line) of one document."""
    out: list[tuple[str, int]] = []
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = ""
        out.append(("INVALID_UTF8", 1))
    if len(content) > MOST_BYTES:
        out.append(("FILE_TOO_LARGE", 1))
    if b"\0" in content:
        out.append(("BINARY_CONTENT", 1))
    lines, fences = scan(text)
    meta, broken = front_matter(text)
    out += broken
    named = meta.get("sources") if isinstance(meta.get("sources"), list) else []
    version, at, reviewed = meta.get("format_version"), meta.get("generated_at"), meta.get("privacy_reviewed") == "true"
    if version != report.FORMAT:
        out.append(("UNSUPPORTED_FORMAT_VERSION", 1))
    if not named:
        out.append(("MISSING_SOURCES", 1))
    out += [("UNSUPPORTED_SOURCE", 1) for s in named if s not in SOURCES]
    if len(set(named)) < len(named):
        out.append(("DUPLICATE_SOURCE", 1))
    try:
        ok = isinstance(at, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z", at) and datetime.fromisoformat(at.replace("Z", "+00:00"))
    except ValueError:
        ok = False
    if not ok:
        out.append(("INVALID_GENERATED_AT", 1))
    if not reviewed:
        out.append(("PRIVACY_REVIEW_REQUIRED", 1))
    before = -1
    for h in report.HEADINGS:
        found = headings(lines, h)
        if not found:
            out.append(("MISSING_SECTION", 1))
            continue
        if len(found) > 1:
            out.append(("DUPLICATE_SECTION", found[1].n))
        if found[0].n <= before:
            out.append(("SECTION_ORDER", found[0].n))
        before = found[0].n
    out += [("CODE_FENCE_NOT_ALLOWED", n) for n in fences[:1]]
    cards, broken = sample_issues(lines, facts)
    out += broken
    if version == report.FORMAT:
        out += binding_issues(text, lines, named, reviewed, facts)
    if _HTML.search(text):
        out.append(("HTML_NOT_ALLOWED", 1))
    if _LINKS.search(text):
        out.append(("LINK_NOT_ALLOWED", 1))
    if re.search(r"\b(?:attachment|cid):\s*\S+", text, re.I):
        out.append(("ATTACHMENT_NOT_ALLOWED", 1))
    if span := sample_range(text, lines):
        bare, _ = _without_tables(text[span[0] : span[1]])
        out += [(code, line + span[2] - 1) for line, _, code in detect_text(bare)]
    return {"formatVersion": version, "sources": named, "generatedAt": at, "privacyReviewed": reviewed, "sampleCount": cards, "sizeBytes": len(content)}, out


def document_issues(docs: DataFrame, facts: dict | None = None) -> DataFrame:
    """path, code, line of every breach of documents (path, content binary), in Arrow batches."""

    @F.pandas_udf("array<struct<code:string,line:int>>")
    def check(content: pd.Series) -> pd.Series:
        return pd.Series([[{"code": c, "line": n} for c, n in validate(bytes(b or b""), facts)[1]] for b in content])

    return docs.select("path", F.explode(check("content")).alias("i")).select("path", "i.code", "i.line")
