"""Topic review: evidence for an outside labeller, and labels bound back and counted over a closed taxonomy."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywood.functions.excerpts import trim
from tallywood.functions.redaction import detect_text, redact_text
from tallywood.functions.textrules import SPACE

# The taxonomy, in order.
TOPICS = ("frontend", "backend", "devops_infra", "data_science_ml", "mobile", "security", "developer_tooling", "general_coding", "mixed", "other", "unknown")
SEGMENTS, POINTS, SIGNALS, SIGNAL_CHARS = 3, 600, 32, 64
_SPACES = re.compile(f"[{SPACE}]+")
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def evidence_text(text: str) -> str:
    """Composed, on one line and redacted."""
    text = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFC", text))
    return trim(redact_text(trim(_SPACES.sub(" ", _CONTROLS.sub(" ", text))))[0])


@F.pandas_udf(T.StringType())
def evidence(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else evidence_text(t) for t in text], dtype=object)


@F.pandas_udf(T.BooleanType())
def is_clean(text: pd.Series) -> pd.Series:
    return pd.Series([t is None or not detect_text(t) for t in text])


def first_segments(user: DataFrame, text: str = "text") -> DataFrame:
    """evidence of each session: its first three messages that aren't empty, up to 600 code points each, trimmed after the cut."""
    r = user.filter(F.col(text) != "").withColumn("_r", F.row_number().over(Window.partitionBy("source", "session").orderBy("ordinal"))).filter(F.col("_r") <= SEGMENTS)
    cut = F.regexp_replace(F.substring(text, 1, POINTS), f"[{SPACE}]+\\z", "")
    got = r.groupBy("source", "session").agg(F.array_sort(F.collect_list(F.struct("ordinal", cut.alias("t")))).alias("e"))
    return got.select("source", "session", F.expr("transform(e, x -> x.t)").alias("evidence"))


def padded(number: str, width: int):
    """A number with zeros before it up to `width` digits; a longer one stays whole."""
    digits = F.col(number).cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def topic_counts(labels: DataFrame) -> DataFrame:
    """n and share in per cent of every topic of the taxonomy, zeros included."""
    spark = labels.sparkSession
    every = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    got = labels.groupBy("topic").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("t")).scalar()
    return every.join(got, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(100.0) * F.coalesce("n", F.lit(0)) / total).alias("share"))


def compare_refs(left: DataFrame, right: DataFrame) -> DataFrame:
    """How two sequences (pos, ref) agree: equal, only in one, different."""
    both = left.withColumnRenamed("ref", "l").join(right.withColumnRenamed("ref", "r"), "pos", "full")
    return both.agg(F.count_if(F.col("l") == F.col("r")).alias("equal"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l") != F.col("r")).alias("different"))


def _prefix(nonce: str) -> str:
    return f"topic-{hashlib.sha256(nonce.encode()).hexdigest()[:12]}-"


def reference(nonce: str, pos: int) -> str:
    """The reference of the session at a position from 1."""
    return f"{_prefix(nonce)}{pos:06d}"


def create_review(sessions: DataFrame, user_messages: DataFrame, nonce: str) -> DataFrame:
    """pos, evidence_ref, source, evidence, clean and primary_topic (null) of every session, in their order.

    sessions has source, session, source_order, session_order.  References come from the
    nonce and the position.  `clean` is false where evidence still holds something
    sensitive; such a review must not be given away.
    """
    seen = first_segments(user_messages.withColumn("text", evidence("text")))
    # positions: sources are few, each starts after the sessions of those before it
    starts, at = {}, 0
    for r in sessions.groupBy("source_order").count().orderBy("source_order").collect():
        starts[r.source_order] = at
        at += r["count"]
    base = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v))]) if starts else F.create_map(F.lit(0), F.lit(0))
    out = sessions.join(seen, ["source", "session"], "left").withColumn("pos", (base[F.col("source_order")] + F.col("session_order") + 1).cast("long"))
    return out.select(
        "pos", F.concat(F.lit(_prefix(nonce)), padded("pos", 6)).alias("evidence_ref"), "source", "session",
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        is_clean(F.array_join("evidence", "\n")).alias("clean"), F.lit(None).cast("string").alias("primary_topic"),
    )


def population_sha256(members: DataFrame, nonce: str) -> str:
    """Hash over the JSON {"nonce", "members"} with the sorted members (source, session), streamed: no list is kept whole."""
    ordered = members.select(F.concat_ws("\x00", "source", F.col("session").cast("string")).alias("m")).orderBy(F.expr("m COLLATE UNICODE"))
    digest = hashlib.sha256(f'{{"nonce":{json.dumps(nonce)},"members":['.encode())
    for k, row in enumerate(ordered.toLocalIterator()):
        digest.update(("," * (k > 0) + json.dumps(row.m, ensure_ascii=False)).encode("utf-8", "surrogatepass"))
    digest.update(b"]}")
    return digest.hexdigest()


def bind_review(review: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, problems): labels (evidence_ref, primary_topic) bound to a review.

    Problems: references that are unknown, missing, doubled, without a topic or with one outside of the taxonomy.
    """
    given = labels.groupBy("evidence_ref").agg(F.count("*").alias("times"), F.first("primary_topic", ignorenulls=True).alias("topic"))
    both = review.select("pos", "evidence_ref", "source").join(given, "evidence_ref", "full")
    problem = (
        F.when(F.col("pos").isNull(), "unknown reference")
        .when(F.col("times").isNull(), "missing reference")
        .when(F.col("times") > 1, "doubled reference")
        .when(F.col("topic").isNull(), "incomplete")
        .when(~F.col("topic").isin(*TOPICS), "unknown topic")
    )
    both = both.withColumn("problem", problem)
    return both.filter("problem is null").select("pos", "evidence_ref", "source", "topic"), both.filter("problem is not null").select("evidence_ref", "problem")


def review_problems(review: DataFrame) -> DataFrame:
    """evidence_ref and problem of every row of a review that breaks a rule on evidence, signals or topic."""
    @F.pandas_udf("string")
    def check(evidence: pd.Series, signals: pd.Series, topic: pd.Series) -> pd.Series:
        out = []
        for e, s, t in zip(evidence, signals, topic):
            why = None
            e = [] if e is None else list(e)
            if len(e) > SEGMENTS:
                why = "too many segments"
            elif any(not x for x in e):
                why = "empty segment"
            elif any(len(x) > POINTS for x in e):
                why = "segment too long"
            elif any(evidence_text(x) != x for x in e):
                why = "not normalized and redacted"
            elif any(detect_text(x) for x in e):
                why = "sensitive content"
            elif s is not None and (len(s) > SIGNALS or len(set(s)) < len(s) or any(len(x) > SIGNAL_CHARS or not re.fullmatch("[a-z0-9_.:+-]+", x) for x in s)):
                why = "bad technical signals"
            elif t is not None and t not in TOPICS:
                why = "unknown topic"
            out.append(why)
        return pd.Series(out, dtype=object)

    signals = F.col("technical_signals") if "technical_signals" in review.columns else F.lit(None).cast("array<string>")
    return review.select("evidence_ref", check("evidence", signals, "primary_topic").alias("problem")).filter("problem is not null")
