"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds the 64-bit hashes of its distinct `words`-word shingles (a
shorter document: its whole sequence).  Shingles fall into `buckets`; a register keeps
of its bucket's least hash the number of leading zeros (6 bits) and the next mantissa
bits (10): 16 bits a register.  Registers of empty buckets borrow from full ones in an
order that is the same for all documents.  Steps:

1. documents with equal sets collapse to a class, known by its set and with the text of
   one row of its least doc_id;
2. `bands` bands of `rows` registers are hashed; each class first meets the least class
   of each of its bands (a star, never all pairs).  The collision-corrected estimate from
   the registers discards pairs far below the threshold (sets of under 64 shingles skip it), the others are counted on
   full sets, and each link found is confirmed on the words of its shingles.  Links found make roots: classes known to be connected;
3. classes that share a band, in part through others, are a loose cluster; where its band
   groups are less work together than all its pairs, they are the clusters.  In each, blocks
   of `block` classes meet pairwise and are checked likewise, but never two blocks of one
   root; only a spanning forest of the links found leaves a task.  So a group of copies,
   however large, costs one comparison a class, and only what isn't connected yet is paired;
4. components of the links, brought back to every document.

A pair at the threshold shares a band with probability 1 - (1 - s**rows)**bands (0.99995
at 0.85 with 24 bands of 5); pairs above it more surely.  Links are exact: none below the
threshold is made.

Nulls: a null or word-less text has an empty set and links with nothing; a row with a
null doc_id has no links, component null and is kept.  Rows that repeat a doc_id are one
vertex; where their texts differ it has the links of each.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import among, bounded_batches, drop_written, join_hot, shuffle_partitions, table, written
from tallywood.llm.components import components
from tallywood.llm.kernels import U, mix, shingle_hashes, sliced, string_buffers, word_hashes, word_spans

MANTISSA = 10


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data, offsets = string_buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends, lower=True)
    w = shingle_hashes(h, words, 1)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(w[lo : hi - words + 1]))
        elif hi > lo:
            out.append(shingle_hashes(h[lo:hi], hi - lo, 1000 + hi - lo))
        else:
            out.append(np.zeros(0, U))
    return out


def registers(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """HyperMinHash registers of each set: (zeros << MANTISSA) | mantissa of the bucket's least hash; 0xFFFF where the set is empty."""
    sizes = np.asarray([len(s) for s in sets])
    flat = mix(np.concatenate(sets) if len(sets) else np.zeros(0, U), 77)
    bits = int(buckets).bit_length() - 1
    place = np.repeat(np.arange(len(sets)), sizes) * buckets + (flat >> U(64 - bits)).astype(np.int64)
    rest = (flat << U(bits)) | U(1 << (bits - 1))
    least = np.full(len(sets) * buckets, U(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, place, rest)
    empty = least == U(0xFFFFFFFFFFFFFFFF)
    top = np.where(empty, U(1), least)
    zeros = np.minimum(63 - np.floor(np.log2((top >> U(11)).astype(np.float64) + 0.5)).astype(np.int64) - 11, 50)
    after = (top << (zeros + 1).astype(U)) >> U(64 - MANTISSA)
    regs = ((zeros.astype(U) << U(MANTISSA)) | after).astype(np.uint16).reshape(len(sets), buckets)
    empty = empty.reshape(regs.shape)
    some = sizes > 0
    source = regs.copy()
    order = mix(np.arange(buckets * 64, dtype=U), 5).astype(np.int64) % buckets
    full = ~empty
    todo = empty & some[:, None]
    for t in range(64):  # borrow: the same attempts for every document
        if not todo.any():
            break
        i, j = np.nonzero(todo)
        k = order[j * 64 + t]
        ok = full[i, k]
        regs[i[ok], j[ok]] = source[i[ok], k[ok]]
        todo[i[ok], j[ok]] = False
    if todo.any():
        any_full = full.argmax(1)
        i, j = np.nonzero(todo)
        regs[i, j] = source[i, any_full[i]]
    regs[~some] = 0xFFFF
    return regs


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of all pairs of rows from the share of equal registers, less the share that collides by chance."""
    equal = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in range(a.shape[1]):
        equal += a[:, k, None] == b[None, :, k]
    chance = 2.0**-MANTISSA / 3
    return np.clip((equal / a.shape[1] - chance) / (1 - chance), 0, 1)


def signatures(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest as two longs, registers, hash of the text."""

    def run(batches):
        for batch in sliced(batches):
            sets = shingle_sets(batch.column(1), words)
            regs = registers(sets, buckets)
            one, two = np.frombuffer(b"".join([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), dtype="<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ascontiguousarray(one)), pa.array(np.ascontiguousarray(two)), pa.array([r.tobytes() for r in regs], pa.binary()), batch.column(2)],
                names=["doc_id", "n_shingles", "h1", "h2", "regs", "t"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, regs binary, t long")


def band_keys(classes: DataFrame, buckets: int, bands: int, rows: int) -> DataFrame:
    """(band key, class id): one row for each band of each class."""
    pick = (mix(np.arange(bands * rows * 4, dtype=U), 3) % U(buckets)).astype(np.int64).reshape(bands, -1)
    chosen = np.asarray([list(dict.fromkeys(p.tolist()))[:rows] if len(set(p.tolist())) >= rows else list(range(rows)) for p in pick])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), buckets).astype(U)
            keys = np.empty((len(ids), bands), U)
            for b in range(bands):
                h = np.full(len(ids), U(b))
                for k in chosen[b]:
                    h = mix(h * U(0x9E3779B97F4A7C15) + regs[:, k], b)
                keys[:, b] = h
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, bands))], names=["band", "v"])

    return classes.select("v", "regs").mapInArrow(run, "band long, v long")


def worded(text: str, words: int) -> set[bytes]:
    """The shingles of a text as their words."""
    own = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def links_within(a_sets, b_sets, percent: int, maybe: np.ndarray, same: bool, confirm=lambda i, j: True) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union among the pairs marked in `maybe`; `confirm` has the last word on each of its links."""
    out = []
    parent = list(range(len(a_sets) + (0 if same else len(b_sets))))
    shift = 0 if same else len(a_sets)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(a_sets)):
        row = np.flatnonzero(maybe[i])
        for j in row.tolist():
            if same and j <= i:
                continue
            x, y = root(i), root(shift + j)
            if x == y:
                continue
            a, b = a_sets[i], b_sets[j]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = np.intersect1d(a, b, assume_unique=True).size
            if 100 * both >= percent * (len(a) + len(b) - both) and confirm(i, j):
                parent[x] = y
                out.append((i, j))
    return out


def _verify(words: int, buckets: int, percent: int, slack: float):
    """Block pairs arrive sorted by (cluster, i, j); emits the links found."""

    def pair(rows: list):
        side = [r["side"] for r in rows]
        regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(len(rows), buckets)
        sets = shingle_sets(pa.array([r["text"] for r in rows], pa.large_string()), words)
        a = [k for k, s in enumerate(side) if s == 0]
        b = [k for k, s in enumerate(side) if s == 1]
        same = not b
        if same:
            b = a
        small = np.asarray([len(s) < 64 for s in sets])  # too few shingles for an estimate
        maybe = (estimate(regs[a], regs[b]) >= percent / 100 - slack) | (small[a][:, None] & small[b][None, :])

        @functools.lru_cache(maxsize=16)
        def shingles(k: int) -> set[bytes]:
            return worded(rows[k]["text"], words)

        def confirm(i: int, j: int) -> bool:
            x, y = shingles(a[i]), shingles(b[j])
            both = len(x & y)
            return 100 * both >= percent * (len(x) + len(y) - both)

        return [(rows[a[i]]["v"], rows[b[j]]["v"]) for i, j in links_within([sets[k] for k in a], [sets[k] for k in b], percent, maybe, same, confirm)]

    def run(batches):
        held, key, found = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                k = (r["cluster"], r["i"], r["j"])
                if k != key:
                    if len(held) > 1:
                        found += pair(held)
                    held, key = [], k
                held.append(r)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in found], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                found = []
        if len(held) > 1:
            found += pair(held)
        yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in found], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _verified(places: DataFrame, texts: DataFrame, words: int, buckets: int, percent: int, slack: float) -> DataFrame:
    """Links (a, b) among the rows of each (cluster, i, j) of places (v, cluster, i, j, side); texts has v, doc_id, text and regs."""
    each = places.groupBy("v").agg(F.collect_list(F.struct("cluster", "i", "j", "side")).alias("at"))
    dealt = texts.join(each, "v").select(F.col("doc_id"), "text", "regs", F.explode("at").alias("at")).select(F.col("doc_id").alias("v"), "text", "regs", "at.*")
    dealt = dealt.repartition(shuffle_partitions(places.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "v")
    return dealt.mapInArrow(_verify(words, buckets, percent, slack), "a long, b long")


def stars(held: DataFrame, part: int) -> DataFrame:
    """Places where each class meets the least class of each of its bands; held has v, band, low, n.  A leader goes to every part of its followers."""
    follow = held.filter("v <> low").select("v", "low").distinct()
    parts = follow.groupBy("low").agg(F.expr(f"cast((count(*) + {part - 1}) div {part} as int)").alias("parts"))
    lead = parts.select(F.col("low").alias("v"), F.col("low").alias("cluster"), F.explode(F.expr("sequence(0L, cast(parts - 1 as bigint))")).alias("i"), F.lit(0).alias("side"))
    rest = join_hot(follow, parts.withColumn("n", F.col("parts")), ["low"], ["v"]).select("v", F.col("low").alias("cluster"), F.expr("pmod(xxhash64(v), parts)").alias("i"), F.lit(1).alias("side"))
    return lead.unionByName(rest).withColumn("j", F.col("i"))


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Places for all pairs of blocks of a cluster that may hold an unlinked pair; members has v, cluster, root (what v is linked with so far).

    A root with `block` or more members has blocks of its own, smaller ones share blocks; two
    blocks of one root needn't meet.
    """
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    many = sizes.groupBy("cluster").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("size") < block, F.col("size")).otherwise(0)).alias("small")).filter("roots > 1")
    sizes = sizes.join(many, "cluster")
    pure = F.col("size") >= block
    sizes = sizes.select("cluster", "root", pure.alias("pure"), F.expr(f"if(size >= {block}, (size + {block - 1}) div {block}, greatest(1, (small + {block - 1}) div {block}))").alias("blocks"), F.col("size").alias("n"))
    key = F.expr("if(pure, xxhash64(root, pmod(xxhash64(v), blocks)), xxhash64(cluster, 'shared', pmod(xxhash64(root), blocks)))")
    dealt = written(join_hot(members, sizes, ["cluster", "root"], ["v"]).select("v", "cluster", key.alias("block"), F.when(F.col("pure"), F.col("root")).alias("own")), "blocks")
    blocks = dealt.groupBy("cluster", "block").agg(F.first("own").alias("own"))
    other = blocks.select("cluster", F.col("block").alias("other"), F.col("own").alias("theirs"))
    meet = blocks.join(other, "cluster").filter("if(block = other, own is null, not coalesce(own = theirs, false))")
    places = dealt.join(meet.select("cluster", "block", "other"), ["cluster", "block"])
    return places.select("v", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("if(block > other, 1, 0)").alias("side"))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, buckets: int = 128, bands: int = 24, rows: int = 5, block: int = 48, slack: float = 0.17) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(signatures(docs, words, buckets), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    named = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("least"), F.count("*").alias("n"))
    named = named.select("h1", "h2", F.col("least.doc_id").alias("name"), F.col("least.t").alias("name_t"), "n")
    classed = join_hot(full, named, ["h1", "h2"], ["doc_id"])
    members = classed.select("doc_id", F.col("name").alias("v")).distinct()
    classes = classed.filter("doc_id = name and t = name_t").dropDuplicates(["h1", "h2"]).select(F.monotonically_increasing_id().alias("v"), "doc_id", "t", "regs")
    classes = written(classes, "classes")  # numbered once
    mixed = full.groupBy("doc_id").agg(F.expr("min(struct(h1, h2)) <> max(struct(h1, h2))").alias("mixed")).filter("mixed").select("doc_id")

    keys = written(band_keys(classes.select("v", "regs"), buckets, bands, rows), "bands")
    shared = keys.groupBy("band").agg(F.min("v").alias("low"), F.count("*").alias("n")).filter("n > 1")
    held = written(join_hot(keys, shared, ["band"], ["v"]), "held")
    drop_written(keys)
    wanted = held.select("v").distinct().join(classes, "v")
    texts = among(docs, wanted.select("doc_id"), "doc_id").withColumn("t", F.xxhash64("text")).join(wanted, ["doc_id", "t"]).dropDuplicates(["v"]).select("v", "doc_id", "text", "regs")
    texts = written(texts, "texts")

    first = written(_verified(stars(held, 4 * block), texts, words, buckets, percent, slack), "links")
    names = classes.select(F.col("doc_id").alias("a"), "v")
    edges = first.join(names, "a").select(F.col("v").alias("x"), "b").join(names.select(F.col("a").alias("b"), F.col("v").alias("y")), "b")
    edges = edges.select(F.lit(True).alias("sure"), F.col("x").alias("a"), F.col("y").alias("b"))
    edges = edges.unionByName(held.filter("v <> low").select(F.lit(False).alias("sure"), F.col("v").alias("a"), F.col("low").alias("b")))
    both = components(edges, graph="sure")
    linked, loose = both.filter("sure").drop("sure"), both.filter("not sure").drop("sure")
    cost = held.filter("v = low").select("v", F.col("n")).join(loose, "v").groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
    dense = loose.groupBy("component").agg(F.count("*").alias("n")).join(cost, "component").withColumn("dense", F.col("n") * F.col("n") <= F.col("cost")).drop("cost")
    near = written(join_hot(loose, dense, ["component"], ["v"]).join(linked.withColumnRenamed("component", "root"), "v", "left").withColumn("root", F.coalesce("root", "v")), "near")
    clusters = near.filter("dense").select("v", F.col("component").alias("cluster"), "root")
    clusters = clusters.unionByName(held.join(near.filter("not dense"), "v").select("v", F.col("band").alias("cluster"), "root"))
    second = _verified(block_pairs(clusters, block), texts, words, buckets, percent, slack)
    several = members.join(mixed, "doc_id").filter("doc_id <> v").select(F.col("doc_id").alias("a"), F.col("v").alias("b"))
    final = components(first.unionByName(second).filter("a <> b").unionByName(several))
    drop_written(held, texts, classes, first, near)

    to = members.join(final.withColumnRenamed("component", "c"), "v", "left").select("doc_id", F.coalesce("c", "v").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c"))
    out = signed.select("doc_id", "n_shingles").join(to, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


#: By brute force: every pair that shares a shingle, and all that is reachable.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.o = e.a),
low AS (SELECT doc_id, min(o) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN low USING (doc_id)
"""
