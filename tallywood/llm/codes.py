"""Vector code compression: integer product codes by weighted Lloyd over distinct parts.

Components become integers, a vector is cut into parts, and equal integer parts of one
position become one weighted row.  Each round of Lloyd's algorithm reads these distinct
rows, with the codebooks (a few thousand integers) in the task, and returns weighted sums
for each entry; sums and means are exact integers.  After the last round each distinct part
gets its code and error, which are joined back to the vectors; parts that many vectors
share are dealt over all tasks there.

Nulls: a null vector, or one with a null or non-finite component, is dropped; a null vec_id
is carried along and comes last in order, a null label is a label of its own.  The length is
that of the smallest vec_id's vector; vectors of other lengths are returned with a null code
and error and take part in nothing.  A length that `parts` doesn't divide is cut as evenly as
possible.  Repeated rows are rows each; rows that share a vec_id are ordered by their integers.
With fewer vectors than entries a codebook is that much smaller.  Integers are bounded by
2**62, errors by 2**63 - 1.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import drop_written, join_hot, table, written

MOST = 2**63 - 1
_LIMIT = float(2**62)


def integers(vectors: DataFrame, scale: int, embedding: str) -> DataFrame:
    """vec_id, label, v (integers) and a row number of every vector whose components are all finite."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-_LIMIT)), F.lit(_LIMIT))).cast("long"))
    return vectors.filter(F.col(embedding).isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), whole.alias("v")).withColumn("row", F.monotonically_increasing_id())


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of each part."""
    return [(i * length // parts, (i + 1) * length // parts - i * length // parts) for i in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (the lower of equals) and the squared distance, exactly."""
    top = max([0, *(abs(int(f(a))) for a in (x, book) if a.size for f in (np.min, np.max))])
    size = 4 * top * top * max(1, x.shape[1])
    if size < 2**52:  # every sum is an integer that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    else:
        kind = np.int64 if size < 2**62 else object
        a, b = x.astype(kind), book.astype(kind)
        d = np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(at)), at]


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray]):
    """(position, rows of the batch, their parts as a matrix)."""
    pos = batch.column(0).to_numpy()
    column = batch.column(1)
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for p in np.unique(pos).tolist():
        rows = np.flatnonzero(pos == p)
        width = books[p].shape[1]
        yield p, rows, flat[offsets[rows][:, None] + np.arange(width)[None, :]] if width else np.zeros((len(rows), 0), np.int64)


def moved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored weighted mean of its parts."""
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = held.value
        sums = [np.zeros((*b.shape,), dtype=object) for b in own]
        count = [np.zeros(len(b), dtype=object) for b in own]
        for batch in batches:
            w = batch.column(2).to_numpy()
            for p, rows, x in _by_position(batch, own):
                at, _ = nearest(x, own[p])
                safe = max(1, int(np.abs(x).max(initial=0))) * int(w[rows].sum()) < 2**62
                kind = np.int64 if safe else object
                for e in np.unique(at).tolist():
                    mine = at == e
                    sums[p][e] += (x[mine].astype(kind) * w[rows][mine].astype(kind)[:, None]).sum(axis=0)
                    count[p][e] += int(w[rows][mine].sum())
        out = [(p, e, j, str(s)) for p, book in enumerate(sums) for e, row in enumerate(book) if count[p][e] for j, s in enumerate(row.tolist())]
        out += [(p, e, -1, str(n)) for p, c in enumerate(count) for e, n in enumerate(c) if n]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["pos", "entry", "j", "s"])

    parts = distinct.select("pos", "part", "n").mapInArrow(run, "pos int, entry int, j int, s string")
    total = parts.groupBy("pos", "entry", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each component of the codebooks
    said = {(r.pos, r.entry, r.j): int(r.s) for r in total}
    after = [b.copy() for b in books]
    for p, e, j in said:
        if j >= 0:
            after[p][e][j] = said[p, e, j] // said[p, e, -1]
    return after


def assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """pos, part, n, entry, error of every distinct part."""
    held = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = held.value
        for batch in batches:
            entry, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, x in _by_position(batch, own):
                at, d = nearest(x, own[p])
                entry[rows] = at
                error[rows] = np.minimum(d, MOST).astype(np.int64) if d.dtype == object else d.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], names=["pos", "part", "n", "entry", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(run, "pos int, part array<long>, n long, entry int, error long")


def _bounded_sum(col: str):
    return F.least(F.sum(F.col(col).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, embedding: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vectors (vec_id, label, `embedding`)."""
    kept = written(integers(vectors, scale, embedding), "vectors")
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    first = kept.orderBy(*order).limit(1).collect()
    length = len(first[0].v) if first else 0
    cut = bounds(length, parts)
    seeds = [r.v for r in kept.filter(F.size("v") == length).select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    books = [np.asarray([v[s : s + n] for v in seeds], dtype=np.int64).reshape(len(seeds), n) for s, n in cut]
    pieces = kept.filter(F.size("v") == length).select("row", "vec_id", "label", F.posexplode(F.array(*[F.slice("v", s + 1, n) for s, n in cut])).alias("pos", "part"))
    distinct = written(pieces.groupBy("pos", "part").agg(F.count("*").alias("n")), "distinct")
    for _ in range(rounds):
        books = moved(distinct, books)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()
    coded = written(assigned(distinct, books), "coded")
    back = join_hot(pieces, coded, ["pos", "part"], ["row"])
    pair = F.struct("pos", F.lpad(F.lower(F.hex("entry")), 2, "0").alias("hex"))
    whole = back.groupBy("row", "vec_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["hex"]), "").alias("code"), _bounded_sum("error").alias("error"))  # `parts` rows each
    other = kept.filter(F.size("v") != length).select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    name = F.coalesce(F.col("label").cast("string"), F.lit(""))
    scored = written(whole.unionByName(other).select("row", "vec_id", "code", "error", name.alias("label"), F.col("label").isNull().alias("none")), "scored")
    drop_written(kept, distinct, coded)
    sums = written(scored.groupBy("label", "none").agg(F.count("*").alias("n"), F.coalesce(_bounded_sum("error"), F.lit(0).cast("long")).alias("label_error")), "sums")
    return join_hot(scored, sums, ["label", "none"], ["row"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 6) -> str:
    nearest_ = """SELECT p, x, w, min(({d}) * 16 + e) % 16 AS e, min({d}) AS dist FROM d JOIN c{r} USING (p) GROUP BY p, x, w"""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
y AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM k, range(8) t(p)),
d AS MATERIALIZED (SELECT p, x, count(*) AS w FROM y GROUP BY p, x),
c0 AS MATERIALIZED (SELECT p, x AS c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM y QUALIFY e < 16)"""
    for r in range(rounds):
        text += f""",
a{r} AS MATERIALIZED ({nearest_.format(d=distance, r=r)}),
s{r} AS (SELECT p, e, j, floor(sum(w * x[j + 1])::DOUBLE / sum(w))::BIGINT AS m FROM a{r}, range(len(x)) t(j) GROUP BY p, e, j),
n{r} AS (SELECT p, e, list(m ORDER BY j) AS c FROM s{r} GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM c{r} b LEFT JOIN n{r} n ON n.p = b.p AND n.e = b.e)"""
    return text + f""",
f AS MATERIALIZED ({nearest_.format(d=distance, r=rounds)}),
z AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', f.e), '' ORDER BY y.p) AS code, sum(f.dist)::BIGINT AS error FROM y JOIN f ON y.p = f.p AND y.x = f.x GROUP BY vec_id),
h AS (SELECT sha256(string_agg(u.m::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, j, c[j + 1] AS m FROM c{rounds}, range(len(c)) t(j)) u)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM z, h
"""


OP13_SQL = _sql()
