"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

A document is its token ids and an end id.  Longer ones than a sequence are cut, the
short piece first.  Pieces are dealt by hash to islands of about `island` pieces; an
island breeds several populations from best-fit packings in several orders: whole
well-filled sequences of one parent are injected into the other, sequences that hold a
doubled piece are dissolved and displaced pieces are best-fitted; each population's elite
migrates to the next one.  An island stops as soon as it reaches the lower bound.  Then
full enough sequences are final, and the others move as groups to a few joined islands,
where they seed a second run; so what an island can't fill, its neighbours' pieces do.
Pieces are dealt by their row's number too, so rows that repeat spread over all islands.

Nulls and repeats: a null text is empty (one end id); a null doc_id is carried along;
repeated rows are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import bounded_batches, shuffle_partitions, written
from tallywood.llm.kernels import sliced

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 0


class ByteBpe:
    """Ids of whole texts as little-endian 32-bit bytes, equal to those of `tokenizers`.

    The same vocabulary as `tiktoken` ranks, where given, is several times as fast and
    gives the same ids; texts with the end token's string or with characters for which
    the two libraries' Unicode tables may differ go through `tokenizers` itself.
    """

    FAR = re.compile("[^\x00-\u05ff\u1e00-\u206f\u20a0-\u20bf\u2190-\u23ff\u2500-\u26ff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")  # where libraries' Unicode tables may differ

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.exact = functools.cache(lambda: Tokenizer.from_file(tokenizer))  # loaded when a text needs it
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or "<|endoftext|>" in text or self.far(text):
            return np.asarray(self.exact().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        data = bytes(memoryview(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set())))
        return data if sys.byteorder == "little" else np.frombuffer(data, np.uint32).astype("<u4").tobytes()

    def far(self, text: str) -> bool:
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.FAR.search(text))


@functools.cache
def _bpe(tokenizer: str, ranks: str | None) -> ByteBpe:
    """One for each worker process, which outlives its tasks."""
    return ByteBpe(tokenizer, ranks)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    short = n % capacity
    bounds = ([(0, short)] if short else []) + [(s, capacity) for s in range(short, n, capacity)]
    return bounds


def tokenise(docs: DataFrame, capacity: int, tokenizer: str, ranks: str | None) -> DataFrame:
    """The pieces of each row, with the row's number in its partition."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = _bpe(tokenizer, ranks)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        nth = 0
        for batch in sliced(batches):
            ids, piece, start, length, crc, rows = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = bpe.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
                    rows.append(nth)
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rows, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", nth long")


def best_fit(order, sizes, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Puts each piece where the least room is left over, else into a new sequence."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            room, k = capacity, len(bins)
            bins.append([])
        else:
            room, k = free.pop(at)
        bins[k].append(i)
        insort(free, (room - sizes[i], k))
    return bins


def fitness(bins, sizes, capacity) -> tuple[int, float]:
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def cross(giver, taker, sizes, capacity, least: float, rng) -> list[list[int]]:
    """The taker with whole well-filled sequences of the giver, without doubles."""
    good = [b for b in giver if sum(sizes[i] for i in b) >= least * capacity]
    if not good:
        return [list(b) for b in taker]
    chosen = [good[k] for k in rng.permutation(len(good))[: max(1, len(good) // 2)]]
    inside = {i for b in chosen for i in b}
    kept = [list(b) for b in taker if not inside.intersection(b)]
    displaced = [i for b in taker if inside.intersection(b) for i in b if i not in inside]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, kept + [list(b) for b in chosen], capacity)


def mutate(bins, sizes, capacity, rng) -> list[list[int]]:
    """Dissolves the emptiest sequences and a few others, and best-fits their pieces."""
    if len(bins) < 2:
        return bins
    load = [sum(sizes[i] for i in b) for b in bins]
    gone = set(np.argsort(load)[: max(1, len(bins) // 20)].tolist()) | set(rng.integers(0, len(bins), max(1, len(bins) // 10)).tolist())
    loose = [i for k in gone for i in bins[k]]
    rng.shuffle(loose)
    loose.sort(key=lambda i: -(sizes[i] + int(rng.integers(0, 1 + sizes[i] // 8))))
    return best_fit(loose, sizes, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(sizes, capacity: int, seed: int, seeds: list[list[list[int]]] = (), generations: int = 6, least: float = 0.98, populations: int = 3, every: int = 2) -> list[list[int]]:
    """The best packing found for one island's pieces by `populations` that breed apart.

    Every `every` generations the best packing of each (its elite) migrates to the next one
    in a ring, in place of the worst there.  A packing at the lower bound ends the search.
    """
    n = len(sizes)
    bound = -(-sum(sizes) // capacity)
    best = best_fit(sorted(range(n), key=lambda i: -sizes[i]), sizes, [], capacity)
    if len(best) <= bound:
        return best

    def score(bins):
        return fitness(bins, sizes, capacity)

    rng = np.random.default_rng(seed)
    crowds = []
    for _ in range(populations):
        noisy = np.asarray(sizes) * rng.uniform(0.9, 1.1, n)
        crowds.append(sorted([best, best_fit(np.argsort(-noisy).tolist(), sizes, [], capacity), *seeds], key=score, reverse=True))
    for generation in range(generations):
        for k, (a, b, *_) in enumerate(crowds):
            crowd = [a, b, cross(a, b, sizes, capacity, least, rng), cross(b, a, sizes, capacity, least, rng), mutate(a, sizes, capacity, rng)]
            crowds[k] = sorted(crowd, key=score, reverse=True)
            if len(crowds[k][0]) <= bound:
                return crowds[k][0]
        if generation % every == every - 1:
            elite = [c[0] for c in crowds]
            for k, c in enumerate(crowds):
                crowds[k] = sorted([*c[:-1], elite[k - 1]], key=score, reverse=True)
    return max((c[0] for c in crowds), key=score)


def _islands(capacity: int, elite: float, second: bool):
    """Packs the rows of each island; rows: PIECES, island, seq (the sequence an earlier run chose)."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        t = t.take(pa.compute.sort_indices(t, [("island", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        island, sizes, old = (t.column(c).to_numpy() for c in ("island", "length", "seq"))
        for lo, hi in zip(edges := [0, *(np.flatnonzero(np.diff(island)) + 1).tolist()], [*edges[1:], len(island)]):
            own = sizes[lo:hi].tolist()
            seeds = []
            if second:
                groups: dict[int, list[int]] = {}
                for i, s in enumerate(old[lo:hi].tolist()):
                    groups.setdefault(s, []).append(i)
                seeds = [list(groups.values())]
            full = [[i] for i, s in enumerate(own) if s == capacity]
            rest = [i for i, s in enumerate(own) if s != capacity]
            to = {i: k for k, i in enumerate(rest)}
            inner = [[[to[i] for i in b] for b in one if b[0] in to] for one in seeds]
            bins = full + [[rest[i] for i in b] for b in evolve([own[i] for i in rest], capacity, int(island[lo]), inner)] if rest else full
            seq, offset, done = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, bool)
            for k, b in enumerate(bins):
                at = 0
                for i in b:
                    seq[i], offset[i] = (int(island[lo]) << 33) | (int(second) << 32) | k, at
                    at += own[i]
                done[b] = second or at >= elite * capacity
            part = t.slice(lo, hi - lo).drop_columns(["island", "seq"])
            yield from part.append_column("seq", pa.array(seq)).append_column("offset", pa.array(offset)).append_column("done", pa.array(done)).combine_chunks().to_batches()

    return run


PACKED = PIECES + ", seq long, offset long, done boolean"


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, ranks: str | None = None, island: int = 1000, joined: int = 32, elite: float = 0.995) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs (doc_id, text).

    `tokenizer` is a `tokenizers` file, `ranks` the same vocabulary as `tiktoken` ranks
    (only for speed).  `island` pieces are packed together, and what `joined` islands
    couldn't fill to `elite` is packed again.
    """
    import public_tokenizers

    if tokenizer is None:
        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    pieces = written(tokenise(docs, capacity, tokenizer, ranks), "pieces")  # fixed, so a task that runs again deals the same rows alike
    islands = max(1, pieces.count() // island)
    parts = max(shuffle_partitions(spark), islands // 64)
    pieces = pieces.withColumn("island", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(islands))).withColumn("seq", F.lit(0).cast("long")).drop("nth")
    first = written(pieces.repartition(parts, "island").mapInArrow(_islands(capacity, elite, False), PACKED), "packed")
    loose = first.filter("not done").withColumn("island", F.expr(f"(seq >> 33) div {joined}")).select("doc_id", "piece", "start", "length", "ids_crc32", "island", "seq")
    again = loose.repartition(parts, "island").mapInArrow(_islands(capacity, elite, True), PACKED)
    return first.filter("done").unionByName(again).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
