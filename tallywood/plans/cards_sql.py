"""Report documents with sample cards made from `conversations`, breaches planted by turn, and the SQL that names them.

A document is up to 16 turns of a conversation (turn // 16).  Its first card quotes each turn, as
turn modulo 6 says: word for word, with its second word hidden, with a word more, by the other
role, as a translation, wholly hidden.  The second card has an unknown reference, a repeated
one without quotes, or a line that isn't a quote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.functions.textrules import collapse
from tallywood.plans.report import SAMPLES
from tallywood.sources.staging import spread

_TABLE = "| Field | Value |\n| --- | --- |\n| Evidence ref | "
_LABEL = " |\n**Representative quote:**"


def planted_cards(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, candidates): path and text, and path, evidence_ref and excerpts."""
    c = conversations.filter("role in ('user', 'assistant')").select("conv_id", F.expr("turn div 16").alias("block"), "turn", "role", collapse(F.col("text")).alias("words"))
    c = spread(c.filter("words <> ''")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "words"))).alias("x"))
    c = c.withColumn("path", F.concat_ws("-", "conv_id", "block"))
    quote = """transform(x, q -> concat('\n> ', CASE WHEN (q.role = 'user') = (q.turn % 6 <> 3) THEN 'User: ' ELSE 'Assistant: ' END,
      CASE q.turn % 6 WHEN 1 THEN array_join(transform(split(q.words, ' '), (w, k) -> if(k = 1, '[REDACTED]', w)), ' ') WHEN 2 THEN concat(q.words, ' indeed')
        WHEN 4 THEN concat('Said in English (', q.role, ', translated)') WHEN 5 THEN '[REDACTED]' ELSE q.words END))"""
    second = f"""CASE conv_id % 5 WHEN 0 THEN 'candidate-09{_LABEL}\n> User: some words' WHEN 1 THEN 'candidate-01{_LABEL}\n' ELSE 'candidate-02{_LABEL}\nno quote' END"""
    text = F.concat(F.lit(f"{SAMPLES}\n### Example 1. A session\n{_TABLE}candidate-01{_LABEL}"), F.array_join(F.expr(quote), ""), F.lit(f"\n### Example 2. Another one\n{_TABLE}"), F.expr(second))
    refs = F.expr("if(conv_id % 3 = 0, array('candidate-01', 'candidate-02', 'candidate-03'), array('candidate-01', 'candidate-02'))")
    pool = c.select("path", F.explode(refs).alias("evidence_ref"), F.expr("transform(x, q -> named_struct('role', q.role, 'text', q.words))").alias("excerpts"))
    return c.select("path", text.alias("text")), pool


BLANK = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
SQL = rf"""WITH w AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '{BLANK}', ' ', 'g'), ' ') AS words FROM conversations WHERE role IN ('user', 'assistant')),
t AS (SELECT *, conv_id || '-' || turn // 16 AS path, 6 + row_number() OVER (PARTITION BY conv_id, turn // 16 ORDER BY turn, role, words) AS n,
  regexp_matches(regexp_replace(words, '\p{{Latin}}', '', 'g'), '\p{{L}}') AS strange FROM w WHERE words <> ''),
d AS (SELECT path, conv_id, 7 + count(*) AS top FROM t GROUP BY path, conv_id),
q AS (SELECT path, n, turn % 6 AS k, CASE WHEN turn % 6 <> 3 THEN role WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS role,
  CASE turn % 6 WHEN 1 THEN array_to_string(list_transform(string_split(words, ' '), lambda x, i: CASE WHEN i = 2 THEN '[REDACTED]' ELSE x END), ' ')
    WHEN 2 THEN words || ' indeed' WHEN 4 THEN 'Said in English' WHEN 5 THEN '[REDACTED]' ELSE words END AS words FROM t),
p AS (SELECT *, string_split(words, '[REDACTED]') AS parts, regexp_matches(regexp_replace(words, '\p{{Latin}}', '', 'g'), '\p{{L}}') AS strange FROM q),
j AS (SELECT p.path, p.n, p.k, p.strange, coalesce(bool_or(t.strange), false) AS any_strange, coalesce(bool_or(t.strange) FILTER (p.k <> 4 AND (t.words = p.words OR (len(parts) > 1
    AND length(regexp_replace(array_to_string(parts, ' '), '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3
    AND regexp_full_match(t.words, array_to_string(list_transform(parts, lambda x: regexp_escape(x)), '.+?'))))), false) AS hit_strange,
  count(*) FILTER (t.words = p.words OR (len(parts) > 1 AND length(regexp_replace(array_to_string(parts, ' '), '[^\p{{L}}\p{{N}}]', '', 'g')) >= 3
    AND regexp_full_match(t.words, array_to_string(list_transform(parts, lambda x: regexp_escape(x)), '.+?')))) AS hits
  FROM p LEFT JOIN t ON p.path = t.path AND p.role = t.role GROUP BY p.path, p.n, p.k, p.strange)
SELECT path, 'candidate-01' AS ref, 'SAMPLE_QUOTE_MISMATCH' AS code, n::INTEGER AS line FROM j WHERE k <> 4 AND hits = 0
UNION ALL SELECT path, 'candidate-01', 'NON_ENGLISH_ORIGINAL_NOT_ALLOWED', n::INTEGER FROM j WHERE k <> 4 AND (strange OR hit_strange)
UNION ALL SELECT path, 'candidate-01', 'UNBOUND_SAMPLE_TRANSLATION', n::INTEGER FROM j WHERE k = 4 AND NOT any_strange
UNION ALL SELECT path, 'candidate-09', 'SAMPLE_EVIDENCE_REF', top::INTEGER FROM d WHERE conv_id % 5 = 0
UNION ALL SELECT path, 'candidate-01', unnest(['DUPLICATE_SAMPLE_EVIDENCE', 'SAMPLE_QUOTE_REQUIRED']), top::INTEGER FROM d WHERE conv_id % 5 = 1
UNION ALL SELECT path, 'candidate-02', 'SAMPLE_QUOTE_REQUIRED', top::INTEGER FROM d WHERE conv_id % 5 > 1
UNION ALL SELECT path, 'candidate-02', 'SAMPLE_QUOTE_FORMAT', (top + 5)::INTEGER FROM d WHERE conv_id % 5 > 1
UNION ALL SELECT path, 'candidate-02', 'UNUSED_CANDIDATE', 0 FROM d WHERE conv_id % 5 < 2
UNION ALL SELECT path, 'candidate-03', 'UNUSED_CANDIDATE', 0 FROM d WHERE conv_id % 3 = 0"""
