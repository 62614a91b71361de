"""Token counts of a SentencePiece BPE model by rank-synchronous merging of ragged arrays.

Texts become character numbers; a border is put wherever two neighbouring characters
stand together in no piece of the vocabulary, for no merge can ever cross it.  The
pre-tokens between borders are held as one ragged array, equal ones once.  In each round
every pre-token merges its lowest-rank pair (the leftmost of equals), all of them at the
same time; one whose pairs are in no piece is done, and its surviving symbols are counted:
one for a piece, its UTF-8 bytes for a character outside the vocabulary.  Pre-tokens of
over `LONG` symbols (a long run of blanks, say) would need as many rounds, so these take
their pairs in the same order from a heap.

Texts are read whole, very long ones in blocks that end at a border.  The model's bytes
are broadcast (half a megabyte); nothing is shuffled.

Nulls: a null text is empty (no token); a null doc_id is carried along; repeated rows are
counted each.  An empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import bounded_batches, table
from tallywood.llm.kernels import release, sliced

BLOCK = 1 << 20
LONG = 256
NONE = 1 << 30
SPACE, MARK = 0x20, 0x2581
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PieceModel:
    """The merges of a model with an identity normaliser, a blank in front of each text and byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        probe = "  a \t\nb  <s>ﬁ Å"
        if sp.normalize(probe) != ("▁" + probe.replace(" ", "▁")) or not any(map(sp.is_byte, range(sp.get_piece_size()))):
            raise ValueError("the model must have an identity normaliser, a dummy prefix and byte fallback")
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        chars = sorted({c for p in pieces for c in p})
        symbols = pieces + sorted(set(chars) - set(pieces))  # a character that is no piece of its own can still be merged
        number = {s: k for k, s in enumerate(symbols)}
        worst_first = sorted({sp.get_score(i) for i in ids}, reverse=True)
        rank_of = {s: k for k, s in enumerate(worst_first)}
        self.rank = np.full(len(symbols) + 1, NONE, dtype=np.int64)  # the last entry stands for no piece, as number -1
        self.rank[: len(pieces)] = [rank_of[sp.get_score(i)] for i in ids]
        self.ranks = self.rank.tolist()
        self.weight = np.ones(len(symbols), dtype=np.int64)
        self.weight[len(pieces) :] = [len(s.encode()) for s in symbols[len(pieces) :]]
        self.char_of = np.zeros(0x110000, dtype=np.uint16)  # 0: a character of no piece
        self.char_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_of[SPACE] = self.char_of[MARK]
        self.symbol_of = np.asarray([0, *[number[c] for c in chars]], dtype=np.int32)
        near = np.asarray(sorted({(int(self.char_of[ord(a)]), int(self.char_of[ord(b)])) for p in pieces for a, b in zip(p, p[1:])}))
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        self.together[near[:, 0], near[:, 1]] = True
        pairs = {(number[p[:k]], number[p[k:]]): number[p] for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.symbols = len(symbols)
        self.pairs = {a * self.symbols + b: to for (a, b), to in pairs.items()}
        self._hash()

    def _hash(self) -> None:
        """An open hash table of all pairs that a piece joins, at most half full."""
        self.bits = max(8, (2 * len(self.pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.asarray(list(self.pairs), dtype=np.int64)
        to = np.asarray(list(self.pairs.values()), dtype=np.int32)
        slot = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[at], self.made[at] = left[won], to[won]
            rest = np.ones(len(left), dtype=bool)
            rest[won] = False
            left, to, slot = left[rest], to[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        key = a.astype(np.int64) * self.symbols + b
        slot = self._slot(key)
        out = np.full(len(key), -1, dtype=np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            got = self.keys[slot]
            hit = got == key
            out[open_[hit]] = self.made[slot[hit]]
            on = ~hit & (got != -1)
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def survivors(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, given as character numbers laid end to end."""
        out = np.zeros(len(sizes), dtype=np.int64)
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self._alone(self.symbol_of[chars[ends[k] - sizes[k] : ends[k]]].tolist())
        own = np.flatnonzero(sizes <= LONG)
        sym = self.symbol_of[chars[np.repeat(sizes <= LONG, sizes)]]
        sizes = sizes[own]
        made = np.full(len(sym), -1, dtype=np.int32)
        made[:-1] = self.joined(sym[:-1], sym[1:])
        made[np.cumsum(sizes) - 1] = -1
        while len(sym):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat((self.rank[made] << 32) | np.arange(len(sym)), starts)
            ended = (low >> 32) == NONE
            if ended.any():
                out[own[ended]] = np.add.reduceat(self.weight[sym], starts)[ended]
            at = low[~ended] & 0xFFFFFFFF
            sym[at] = made[at]
            last = at + 1 == (starts + sizes - 1)[~ended]
            made[at] = -1
            to = at[~last]
            made[to] = self.joined(sym[to], sym[to + 2])
            to = at[at > starts[~ended]]
            made[to - 1] = self.joined(sym[to - 1], sym[to])
            stay = np.repeat(~ended, sizes)
            stay[at + 1] = False
            sym, made = sym[stay], made[stay]
            own, sizes = own[~ended], sizes[~ended] - 1
        return out

    def _alone(self, sym: list[int]) -> int:
        """The same for one long pre-token, its pairs in order of (rank, place) from a heap."""
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def pair(i: int, j: int):
            got = self.pairs.get(sym[i] * self.symbols + sym[j])
            if got is not None:
                heapq.heappush(heap, (ranks[got], i, sym[i], sym[j], got))

        ranks, heap = self.ranks, []
        for i in range(n - 1):
            pair(i, i + 1)
        while heap:
            _, i, x, y, got = heapq.heappop(heap)
            j = after[i]
            if sym[i] != x or j >= n or sym[j] != y:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j], after[i] = got, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                pair(i, after[j])
            if before[i] >= 0:
                pair(before[i], i)
        return int(self.weight[[s for s in sym if s >= 0]].sum())

    def borders(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, character numbers and whether a pre-token starts at each of them."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        chars = self.char_of[points]
        new = np.ones(len(chars), dtype=bool)
        new[1:] = ~self.together[chars[:-1], chars[1:]]
        return points, chars, new

    def _tokens(self, points: np.ndarray, chars: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and tokens of each pre-token."""
        starts = np.flatnonzero(new).astype(np.int32)
        offsets = np.append(starts * 2, 2 * len(chars)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars))]).dictionary_encode()
        distinct = runs.dictionary
        edge = np.frombuffer(distinct.buffers()[1], dtype=np.int32)[distinct.offset : distinct.offset + len(distinct) + 1]
        flat = np.frombuffer(distinct.buffers()[2], dtype=np.uint16)[edge[0] // 2 : edge[-1] // 2]
        n = self.survivors(flat, np.diff(edge) // 2)[runs.indices.to_numpy()]
        lost = np.flatnonzero(chars[starts] == 0)  # always alone
        far = points[starts[lost]]
        n[lost] = 1 + (far > 0x7F).astype(np.int64) + (far > 0x7FF) + (far > 0xFFFF)
        return starts, n

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        short = [k for k, t in enumerate(texts) if 0 < len(t) <= BLOCK]
        if short:
            points, chars, new = self.borders("".join(" " + texts[k] for k in short))
            ends = np.cumsum([len(texts[k]) + 1 for k in short])
            new[ends[:-1]] = True
            starts, n = self._tokens(points, chars, new)
            out[short] = np.add.reduceat(n, np.searchsorted(starts, np.concatenate([[0], ends[:-1]])))
        for k, t in enumerate(texts):
            if len(t) > BLOCK:
                out[k] = self._in_blocks(" " + t)
        return out

    def _in_blocks(self, text: str) -> int:
        total, lo, size = 0, 0, BLOCK
        while lo < len(text):
            points, chars, new = self.borders(text[lo : lo + size])
            if lo + size < len(text):
                cut = int(np.flatnonzero(new)[-1])
                if not cut:  # no border in the whole block: a longer one
                    size *= 2
                    continue
                points, chars, new = points[:cut], chars[:cut], new[:cut]
            total += int(self._tokens(points, chars, new)[1].sum())
            lo, size = lo + len(points), BLOCK
        return total


_READY: dict = {}


def _model(proto: bytes) -> PieceModel:
    """One for each worker process and model."""
    key = (len(proto), zlib.crc32(proto))
    if key not in _READY:
        _READY.clear()
        _READY[key] = PieceModel(proto)
    return _READY[key]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row of docs (doc_id, text); `model` is a file on the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    def run(batches):
        counter = _model(proto.value)
        for batch in sliced(batches, rows=4096, size=2 << 20):
            n = counter.count([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])
        release()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long"), text)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
