"""Excerpts fit to show: code and resources out, controls to blanks, redacted, collapsed, cut.

`with_excerpts` does this in the JVM (Python only for texts that may hold a URL with a query,
as in redaction); `normalized` is the same for single texts on the driver.
"""

from __future__ import annotations

import itertools
import re

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywood.functions.redaction import detect_text, holds_any, let, redact_text, with_redactions
from tallywood.functions.textrules import SPACE, collapse, cut_points, expand

MOST_POINTS = 280
_FENCE = re.compile(f"[{SPACE}]{{0,3}}(`{{3,}}|~{{3,}})")
_SPACES = re.compile(f"[{SPACE}]+")
_EDGE_SPACE = re.compile(f"^[{SPACE}]+|[{SPACE}]+$(?![\\s\\S])")
# Marks that stand for what is gone, and what is stripped, in order.
_MARKS = r"\[(?:REDACTED|REMOVED|HOME|LOCAL_PATH)[^\]]*\]"
_STRIP = (
    (r"!\[([^\]\n]*)\](?:\([^\n)]*\)|\[[^\]\n]*\])", r" \1 ", re.A),
    (r"\[([^\]\n]+)\](?:\([^\n)]*\)|\[[^\]\n]*\])", r" \1 ", re.A),
    (r"^<space>{0,3}\[[^\]\n]+\]:<space>*[^<s>][^\n\r  ]*$", " ", re.A | re.M),
    (r"<(?:https?|ftp|file|s3|mailto):[^>]+>", " [REMOVED_RESOURCE] ", re.A | re.I),
    (r"<edge>(?:https?|ftp|file|s3)://[^<s><>()\[\]{}]+", " [REMOVED_RESOURCE] ", re.A | re.I),
    (r"(^|[<s>(])//[A-Za-z0-9][^<s><>()\[\]{}]*", r"\1[REMOVED_RESOURCE]", re.A),
    (r"</?[A-Za-z][^>]*>", " ", re.A),
    (r"`([^`\n]+)`", r"\1", re.A),
)
_PLACEHOLDER = re.compile(_MARKS, re.I)
_SPELLED = [(p if p.startswith(("<(?:", "</?")) else expand(p), by, f) for p, by, f in _STRIP]
_STRIPPERS = [(re.compile(p, f), by) for p, by, f in _SPELLED]
#: The same for Java, where lines end at \n only.
_JAVA_STRIPPERS = [(("(?i)" if f & re.I else "") + ("(?md)" if f & re.M else "") + p, re.sub(r"\\([0-9])", r"$\1", by)) for p, by, f in _SPELLED]
#: What a text must hold for each of these to match.
_LITERALS = ("![", "[", "]:", "<", "://", "//", "<", "`")
_OPENS = f"^[{SPACE}]{{0,3}}(`{{3,}}|~{{3,}})"


def trim(text: str) -> str:
    return _EDGE_SPACE.sub("", text)


def without_fences(text: str) -> str:
    """Fenced code gives way to one mark; an open fence runs to the end."""
    out, mark = [], None
    for line in re.split(r"\r?\n", text):
        m = _FENCE.match(line)
        if mark is None:
            if m:
                mark = m[1]
                out.append("[REMOVED_CODE]")
            else:
                out.append(line)
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark):
            mark = None
    return "\n".join(out)


def without_resources(text: str) -> str:
    text = without_fences(text)
    for pattern, by in _STRIPPERS:
        text = pattern.sub(by, text)
    return text


def strip_links(text: Column) -> Column:
    """Autolinks, URLs and tags out of a text, natively."""
    text = F.regexp_replace(text, "(?i)<(?:https?|ftp|file|s3|mailto):[^>]+>", " [REMOVED_RESOURCE] ")
    text = F.regexp_replace(text, "(?i)" + expand(r"<edge>(?:https?|ftp|file|s3)://[^<s>") + r"<>()\[\]{}]+", " [REMOVED_RESOURCE] ")
    return F.regexp_replace(text, "</?[A-Za-z][^>]*>", " ")


def has_language(text: str) -> bool:
    """At least three letters or digits outside of placeholders."""
    found = _SEEN.finditer(_PLACEHOLDER.sub(" ", text))
    return sum(1 for _ in itertools.islice(found, 3)) == 3


_CONTROL = regex.compile(r"\p{C}")
_SEEN = regex.compile(r"[\p{L}\p{N}]")


def no_controls(text: str, by: str) -> str:
    return _CONTROL.sub(by, text)



def normalized(text: str | None) -> str | None:
    """The excerpt, or None where nothing fit to show is left."""
    if text is None:
        return None
    clean = trim(_SPACES.sub(" ", redact_text(no_controls(without_resources(text), " "))[0]))
    if not clean or not has_language(clean):
        return None
    if len(clean) > MOST_POINTS:
        clean = _EDGE_SPACE.sub("", clean[: MOST_POINTS - 1]) + "…"
    return None if detect_text(clean) else clean


def fenced_ranges(lines: Column) -> Column:
    """a and b (from 0) of the opening and closing lines of each fence, by a fold over the lines that may open or close one; an open one ends at the number of lines."""
    marks = F.filter(F.transform(lines, lambda line, k: F.struct(k.alias("at"), F.regexp_extract(line, _OPENS, 1).alias("run"))), lambda m: m["run"] != "")
    state = lambda at, run, ranges: F.struct(at.alias("at"), run.alias("run"), ranges.alias("ranges"))
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))

    def step(s: Column, m: Column) -> Column:
        closed = state(F.lit(-1), F.lit(""), F.concat(s["ranges"], span(s["at"], m["at"])))
        return F.when(s["run"] == "", state(m["at"], m["run"], s["ranges"])).when(F.startswith(m["run"], s["run"]), closed).otherwise(s)

    def ranges(size: Column):
        return lambda s: F.when(s["run"] == "", s["ranges"]).otherwise(F.concat(s["ranges"], span(s["at"], size)))

    none = F.array().cast("array<struct<a:int,b:int>>")
    return F.aggregate(marks, state(F.lit(-1), F.lit(""), none), step, ranges(F.size(lines)))


def fences_out(text: Column) -> Column:
    """`without_fences` natively: the lines of fenced ranges give way to one mark."""
    lines = F.split(text, "\r?\n", -1)
    fenced = fenced_ranges(lines)

    def rest(r: Column) -> Column:
        before = F.transform(r, lambda x, k: let(F.when(k == 0, -1).otherwise(F.get(r, k - 1)["b"]), lambda last: F.concat(F.slice(lines, last + 2, x["a"] - last - 1), F.array(F.lit("[REMOVED_CODE]")))))
        after = F.when(F.size(r) == 0, lines).otherwise(let(F.element_at(r, -1)["b"] + 1, lambda at: F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))))
        return F.array_join(F.concat(F.flatten(before), after), "\n")

    some = F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))
    return F.when(some, let(fenced, rest)).otherwise(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def resources_out(text: Column) -> Column:
    """`without_resources` natively."""
    text = fences_out(text)
    for (pattern, by), literal in zip(_JAVA_STRIPPERS, _LITERALS):
        text = let(text, _stripped(pattern, by, literal))
    return text


def _stripped(pattern: str, by: str, literal: str):
    return lambda t: F.when(F.contains(t, F.lit(literal)), F.regexp_replace(t, F.lit(pattern), F.lit(by))).otherwise(t)


#: Three letters or digits, the search ends with the third.
_SPOKEN = r"[\p{L}\p{N}](?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){2}"
#: The start of a text that says its first 280 code points once blanks are collapsed, and whether more follow: two points more, as the last may be a blank.
_HEAD = rf"\A[{SPACE}]*+(?:[^{SPACE}]|[{SPACE}]++(?=[^{SPACE}])){{0,{MOST_POINTS + 2}}}"


def with_excerpts(df: DataFrame, text: str = "text", into: str = "excerpt") -> DataFrame:
    """df with a column `into` of the excerpt of each text, null where nothing fit to show is left."""
    may = F.contains(F.col(text), F.lit("/")) & F.contains(F.col(text), F.lit("?"))  # stripping makes neither
    bare = with_redactions(df, F.regexp_replace(resources_out(F.col(text)), r"\p{C}", " "), into, may)

    def shown(t: Column) -> Column:
        plain = F.when(F.contains(t, F.lit("[")), F.regexp_replace(t, "(?i)" + _MARKS, " ")).otherwise(t)
        return F.when(plain.rlike(_SPOKEN), let(cut_points(collapse(F.regexp_extract(t, _HEAD, 0)), MOST_POINTS), lambda c: F.when(~holds_any(c), c)))

    return bare.withColumn(into, let(F.col(f"{into}.text"), shown))
