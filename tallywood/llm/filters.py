"""Filter interaction audit: what each of five filters removes in every order, and its Shapley share.

A document fails any of the filters A-E; its failures are a mask of five bits.  All
figures of all 120 orders follow from the number of documents with each mask, so a part
of the corpus is one vector of 32 x 3 counts (documents, good ones, toxic ones).

E, "the same text as a smaller doc_id", is found by a fingerprint-routed RDD.  Texts
whose xxhash64 is unique settle at once.  The others meet in chains under their
fingerprint, which hold each full text once with its smallest id: first within a map task,
which emits every row that isn't the smallest of its text there and routes one record
for each text, by fingerprint; then in the partition that the fingerprint belongs to,
which emits all but the smallest in the same way.  Different texts of one fingerprint
stand apart in its chain.  A text in a third of all rows is thus one record a map task.
A map task flushes its chains at `HELD` bytes, and partitions are as many as the distinct
repeated texts need.  `combineByKey` then merges the count vectors of each part.

Nulls: a null text is empty and a null source the part ''; a null doc_id neither fails E nor makes
others fail it.  Repeated rows count each; rows of the same doc_id don't fail each other.
A document is good or toxic if any of its label rows says so.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import drop_written, may_be_column, shuffle_partitions, table, written

LETTERS = "ABCDE"
E = 1 << LETTERS.index("E")
HELD = 32 << 20
CHUNK = 1 << 20
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words_of(data: bytes):
    """Runs of bytes other than 0x20 and 0x09-0x0D, a block of the text at a time."""
    if len(data) <= CHUNK:
        return data.split()
    return _in_blocks(data)


def _in_blocks(data: bytes):
    lo, rest = 0, b""
    while lo < len(data):
        block = rest + data[lo : lo + CHUNK]
        lo += CHUNK
        words = block.split()
        rest = b""
        if lo < len(data) and words and not block[-1:].isspace():
            rest = words.pop()
        yield from words
    if rest:
        yield rest


def failures(text: str) -> int:
    """The mask of the filters A-D that a text fails."""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = 0, set()
    words = words_of(data)
    if isinstance(words, list):
        n, distinct = len(words), set(words)
    else:
        for w in words:
            n += 1
            distinct.add(w)
    upper = len(data) - len(data.translate(None, _UPPER))
    marked = len(data.translate(None, _MARKS)) != len(data)
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * upper > 2 * len(text)) << 2 | marked << 3


class Chains:
    """Full texts by fingerprint, each with its smallest id and the rows of that id: {fingerprint: {text: [id, {(part, mask): rows}]}}."""

    def __init__(self):
        self.held: dict[int, dict[str, list]] = {}
        self.bytes = 0

    def meet(self, fingerprint: int, text: str, doc_id: int, rows: dict[tuple[str, int], int]):
        """Yields (id, part, mask, rows) of what is now known not to be the smallest id of its text."""
        chain = self.held.setdefault(fingerprint, {})
        own = chain.get(text)
        if own is None:
            chain[text] = [doc_id, dict(rows)]
            self.bytes += len(text) + 200
        elif own[0] == doc_id:
            for k, n in rows.items():
                own[1][k] = own[1].get(k, 0) + n
        else:
            larger, at = (doc_id, rows) if doc_id > own[0] else tuple(own)
            for (part, mask), n in at.items():
                yield larger, part, mask | E, n
            if doc_id < own[0]:
                own[:] = [doc_id, dict(rows)]

    def drain(self):
        for fingerprint, chain in self.held.items():
            for text, (doc_id, rows) in chain.items():
                yield fingerprint, text, doc_id, rows
        self.held, self.bytes = {}, 0


def _route(rows):
    """(key, record) of a map task: (id, part, mask, rows) where E is settled, else (text, id, {(part, mask): rows}) by fingerprint."""
    chains = Chains()
    for nth, (doc_id, part, fingerprint, near, text) in enumerate(rows):
        mask = failures(text)
        if not near or doc_id is None:
            yield nth, (doc_id, part, mask, 1)
            continue
        for done in chains.meet(fingerprint, text, doc_id, {(part, mask): 1}):
            yield nth, done
        if chains.bytes > HELD:
            for key, *record in chains.drain():
                yield key, tuple(record)
    for key, *record in chains.drain():
        yield key, tuple(record)


def _settle(records):
    chains = Chains()
    for key, record in records:
        if len(record) == 4:
            yield record
        else:
            yield from chains.meet(key, *record)
    for _, _, doc_id, rows in chains.drain():
        for (part, mask), n in rows.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, rows: the failures of every row of docs (doc_id, source, text); equal rows may be one with their number."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("fingerprint", F.xxhash64("text"))
    again = written(base.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")).filter("n > 1"), "repeated")
    size = again.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(shuffle_partitions(spark), int(size) // HELD + 1)
    rows = may_be_column(base, again.select("fingerprint"), "fingerprint", "near").select("doc_id", "part", "fingerprint", "near", "text")
    settled = rows.rdd.mapPartitions(_route).partitionBy(parts, lambda key: key % parts).mapPartitions(_settle)
    out = written(spark.createDataFrame(settled, "doc_id long, part string, mask int, rows long", verifySchema=False), "masks")
    drop_written(again)
    return out


def _vector(value) -> np.ndarray:
    return _add(np.zeros((3, 1 << len(LETTERS)), dtype=np.int64), value)


def _add(vector: np.ndarray, value) -> np.ndarray:
    mask, good, toxic, n = value
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def _audit(counted):
    """The rows of AUDIT for one (part, vector)."""
    part, vector = counted
    every = np.arange(vector.shape[1])
    rows, share = [], dict.fromkeys(LETTERS, 0)
    for order in itertools.permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, left = (every & bit) != 0, (every & before) == 0
            removed, good, toxic = vector[:, fails & left].sum(axis=1).tolist()
            before |= bit
            kept = int(vector[0, (every & before) == 0].sum())
            rows.append((part, "".join(order), step, kept, removed, int(vector[0, fails & ~left].sum()), int(vector[0, bit]), good, toxic, letter))
            share[letter] += removed
    return [(*r[:-1], share[r[-1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT: for every part, order of the filters and step what stays and goes there (docs: doc_id, source, text; labels: doc_id, quality, toxic)."""
    spark = docs.sparkSession
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    judged = masks(docs).join(marked, "doc_id", "left").select("part", "mask", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)), "rows")
    counted = judged.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _add, np.add, shuffle_partitions(spark))
    return spark.createDataFrame(counted.flatMap(_audit), AUDIT, verifySchema=False)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
v AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0)::INT AS before
  FROM o, range(1, 6) r(step)),
j AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM v, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM j
"""
