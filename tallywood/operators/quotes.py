"""Sample cards bound to their candidates by joins: cards, quotes and excerpts are rows.

`cards` reads the sample section of report documents (path, text) in the JVM: one row a card
whose table names one reference.  `binding_issues` says what is wrong with them against a
pool of candidates (path, evidence_ref, excerpts array<struct<role, text>>), with the codes
of the document contract:

* a card whose reference no candidate has (an anti-join; nothing else is said of it), and a
  reference that an earlier card of the document has;
* lines below the quote label that aren't quotes, cards without any quote, translations
  that name another role than their speaker;
* quotes, by an equi-join with the excerpts of the same reference and role: an original
  must equal one of them but for hidden spans (`matches`) and stand in Latin letters, a
  translation must be English and have an excerpt of another script.

Nulls: a null text has no card, a null path equals no other; null excerpts match nothing.
Candidates that repeat a reference within a path count as one with all their excerpts.
Documents that repeat a path are told apart by nothing, so give them paths of their own.
An empty table gives no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywood.functions.excerpts import fenced_ranges
from tallywood.functions.textrules import SPACE, collapse, has_non_latin, js_trim
from tallywood.operators.document import HIDDEN, LABELS
from tallywood.plans.report import SAMPLES
from tallywood.sources.staging import staged

_CARD = f"^### Example [0-9]+\\.[{SPACE}]+.+[^{SPACE}][{SPACE}]*\\z"
_REF = f"^\\|[{SPACE}]*Evidence ref[{SPACE}]*\\|[{SPACE}]*([^|]*?)[{SPACE}]*\\|[{SPACE}]*\\z"
_SAID = f"^(User|Assistant):[{SPACE}]+(.+)\\z"
_TRANSLATED = f"(?i)[{SPACE}]+\\((user|assistant), translated\\)\\z"


def cards(docs: DataFrame) -> DataFrame:
    """path, top (line of the heading), ref and said (n, t of the lines below the quote label) of every sample card."""
    lines = F.split("text", "\r?\n", -1)
    d = docs.filter(F.contains("text", F.lit(SAMPLES))).select("path", lines.alias("raw"), fenced_ranges(lines).alias("fenced"))
    d = d.withColumn("lines", F.transform("raw", lambda t, k: F.struct((k + 1).alias("n"), t.alias("t"))))
    bare = lambda x: ~F.exists("fenced", lambda r: (x["n"] > r["a"]) & (x["n"] <= r["b"] + 1))
    d = d.withColumn("heads", F.filter("lines", lambda x: x["t"].rlike(f"^###?[{SPACE}]") & bare(x)))
    d = d.withColumn("first", F.array_min(F.transform(F.filter("heads", lambda x: x["t"] == SAMPLES), lambda x: x["n"])))
    below = F.filter("heads", lambda x: (x["n"] > F.col("first")) & x["t"].rlike(f"^##[{SPACE}]"))
    d = d.withColumn("end", F.coalesce(F.get(below, F.lit(0))["n"], F.size("lines") + 1))
    d = d.withColumn("tops", F.filter("heads", lambda x: (x["n"] > F.col("first")) & (x["n"] < F.col("end")) & x["t"].rlike(_CARD)))
    spans = F.transform("tops", lambda x, k: F.struct(x["n"].alias("top"), F.coalesce(F.get("tops", k + 1)["n"], F.col("end")).alias("stop")))
    d = d.select("path", "lines", "fenced", F.explode(spans).alias("c")).withColumn("body", F.slice("lines", F.col("c.top"), F.col("c.stop") - F.col("c.top")))
    d = d.withColumn("refs", F.transform(F.filter("body", lambda x: x["t"].rlike(_REF) & bare(x)), lambda x: F.regexp_extract(x["t"], _REF, 1)))
    label = F.get(F.filter("body", lambda x: x["t"] == f"**{LABELS[-1]}:**"), F.lit(0))["n"]
    said = F.filter("body", lambda x: (x["n"] > label) & (js_trim(x["t"]) != ""))
    return d.filter(F.size("refs") == 1).select("path", F.col("c.top").alias("top"), F.col("refs")[0].alias("ref"), F.coalesce(said, F.array().cast("array<struct<n:int,t:string>>")).alias("said"))


def matches(excerpt: Column, quote: Column) -> Column:
    """Whether two collapsed texts are equal, or equal but for hidden spans of one or more characters, with three letters or digits left to see.

    Each part between hidden spans is looked for behind the one before it, leftmost first, so
    the work grows with the text however many spans are hidden.
    """
    parts = F.split(quote, "\\Q" + HIDDEN + "\\E", -1)
    first, last = parts[0], F.element_at(parts, -1)

    def behind(at: Column, part: Column) -> Column:
        found = F.nullif(F.position(part, excerpt, at + 1), F.lit(0))
        return F.when(at.isNull(), None).when(part == "", at + 1).otherwise(found + F.length(part))

    free = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.length(first) + 1, behind)
    hidden = (F.size(parts) > 1) & (F.regexp_count(F.array_join(parts, " "), F.lit(r"[\p{L}\p{N}]")) >= 3) & F.startswith(excerpt, first) & F.endswith(excerpt, last)
    return F.coalesce((excerpt == quote) | (hidden & (F.length(excerpt) - F.length(last) >= free)), F.lit(False))


def _spoken(known: DataFrame) -> DataFrame:
    """path, top, ref, n, kind (format or quote), role, words, translated and as (the role that the translation names) of the lines below the labels."""
    rows = known.select("path", "top", "ref", F.explode("said").alias("x")).select("path", "top", "ref", "x.n", F.startswith("x.t", F.lit(">")).alias("quoted"), js_trim(F.regexp_replace("x.t", f"^>[{SPACE}]?", "")).alias("t"))
    rows = rows.filter("not quoted or t <> ''").withColumn("good", F.col("quoted") & F.col("t").rlike(_SAID))
    words = F.regexp_extract("t", _SAID, 2)
    rows = rows.select("path", "top", "ref", "n", "good", F.lower(F.regexp_extract("t", _SAID, 1)).alias("role"), words.alias("w"), F.lower(F.regexp_extract(words, _TRANSLATED, 1)).alias("as"))
    return rows.select("path", "top", "ref", "n", "good", "role", collapse(F.regexp_replace("w", _TRANSLATED, "")).alias("words"), (F.col("as") != "").alias("translated"), "as")


def _issue(df: DataFrame, code, line: str) -> DataFrame:
    return df.select("path", "ref", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.col(line).alias("line"))


def binding_issues(found: DataFrame, pool: DataFrame) -> DataFrame:
    """path, ref, code and line of what is wrong with cards (as `cards` gives them) against a pool of candidates; both are read more than once, so give tables."""
    pool = pool.select("path", F.col("evidence_ref").alias("ref"), "excerpts")
    keys = pool.select("path", "ref")
    known = found.join(keys, ["path", "ref"], "left_semi")
    unbound = _issue(found.join(keys, ["path", "ref"], "left_anti"), "SAMPLE_EVIDENCE_REF", "top")
    place = Window.partitionBy("path", "ref").orderBy("top")  # the cards of one document with one reference
    doubled = _issue(known.select("path", "ref", "top").withColumn("k", F.row_number().over(place)).filter("k > 1"), "DUPLICATE_SAMPLE_EVIDENCE", "top")
    spoken = staged(_spoken(known), "spoken")
    quotes = spoken.filter("good")
    form = _issue(spoken.filter("not good"), "SAMPLE_QUOTE_FORMAT", "n")
    mute = _issue(known.select("path", "ref", "top").join(quotes.select("path", "ref", "top"), ["path", "ref", "top"], "left_anti"), "SAMPLE_QUOTE_REQUIRED", "top")
    crossed = _issue(quotes.filter(F.col("translated") & (F.col("as") != F.col("role"))), "SAMPLE_TRANSLATION_ROLE", "n")

    own = pool.select("path", "ref", F.explode("excerpts").alias("e")).select("path", "ref", F.col("e.role").alias("role"), collapse(F.col("e.text")).alias("excerpt"))
    own = own.filter("excerpt is not null").withColumn("foreign", has_non_latin(F.col("excerpt")))
    both = quotes.join(own, ["path", "ref", "role"], "left").withColumn("hit", ~F.col("translated") & matches(F.col("excerpt"), F.col("words")))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    judged = both.groupBy("path", "ref", "n", "translated", "words").agg(some(F.col("hit")).alias("hit"), some(F.col("hit") & F.col("foreign")).alias("hit_foreign"), some(F.col("foreign")).alias("any_foreign"))
    strange = has_non_latin(F.col("words"))
    wrong = lambda when, code: F.when(when, code)
    codes = F.array_compact(F.array(
        wrong(F.col("translated") & (~F.col("words").rlike("[A-Za-z]") | strange), "SAMPLE_TRANSLATION_ENGLISH"),
        wrong(F.col("translated") & ~F.col("any_foreign"), "UNBOUND_SAMPLE_TRANSLATION"),
        wrong(~F.col("translated") & ~F.col("hit"), "SAMPLE_QUOTE_MISMATCH"),
        wrong(~F.col("translated") & (strange | F.col("hit_foreign")), "NON_ENGLISH_ORIGINAL_NOT_ALLOWED"),
    ))
    said = judged.select("path", "ref", F.explode(codes).alias("code"), F.col("n").alias("line"))
    out = unbound
    for more in (doubled, form, mute, crossed, said):
        out = out.unionByName(more)
    return out


def unused(found: DataFrame, pool: DataFrame) -> DataFrame:
    """path and ref of candidates that no card shows."""
    return pool.select("path", F.col("evidence_ref").alias("ref")).distinct().join(found.select("path", "ref"), ["path", "ref"], "left_anti")
