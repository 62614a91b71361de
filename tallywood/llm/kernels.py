"""Vectorised text kernels shared by the operators: whole Arrow batches, no per-word Python.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so UTF-8 needs no
decoding.  A word's hash is its bytes, mixed, or 64 bits of its BLAKE2b digest.  `window_hashes`, a polynomial
over word hashes, only picks anchors; what decides uses `shingle_hashes` with a comparison of
words, or `span_names`, a digest of the words themselves.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_POW: dict[int, np.ndarray] = {}
CHUNK = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    old = _POW.get(base)
    if old is None or len(old) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        out = np.ones(size, dtype=U)
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _POW[base] = old = out
    return old[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U(seed & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (n+1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~white[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    edge[1:] = ~solid[:-1]
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(solid & edge)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[inner[(inner > 0)] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one blank after each, and where each word starts there (n+1 entries)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(word))
    out[nth + word] = data[nth - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)]
    return out, at


def _eights(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with eight zeros behind it, and the eight bytes from each place on as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return padded, np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _upto(eights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Only the first n (7 at most) bytes of each."""
    return eights & ((U(1) << (n.astype(U) << U(3))) - U(1))


def rough_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word from its length and its first and last eight bytes, equal for equal words; only for what is checked later."""
    _, eight = _eights(data)
    size = ends - starts
    first = eight[starts]
    short = size <= 7
    first[short] = _upto(first[short], size[short])
    last = eight[np.maximum(ends - 8, starts)]
    last[short] = 0
    return mix(mix(first) + last + size.astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64 bits of each word, equal for equal words in every batch: of up to 7 bytes the bytes and their number, mixed, which no two share; of longer ones BLAKE2b, once for each distinct word."""
    out = np.empty(len(starts), dtype=U)
    lo = 0
    while lo < len(starts):  # in parts, so that scratch arrays stay small whatever the text's length
        a = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, a + CHUNK, side="right")))
        part = LOWER[data[a : ends[hi - 1]]] if lower else data[a : ends[hi - 1]]
        begin, size = starts[lo:hi] - a, ends[lo:hi] - starts[lo:hi]
        here, short = out[lo:hi], size <= 7
        padded, eight = _eights(part)
        here[short] = mix(_upto(eight[begin[short]], size[short]) | (size[short].astype(U) << U(56)))
        if not short.all():
            at = np.stack([begin[~short], begin[~short] + size[~short]], axis=1).ravel()  # words and what lies between them in turn
            words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(padded)])
            words = words.take(pa.array(np.arange(0, len(at), 2))).dictionary_encode()
            digests = b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist()])
            here[~short] = np.frombuffer(digests, dtype="<u8")[words.indices.to_numpy()]
        lo = hi
    return out


def span_names(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit BLAKE2b digest, as two longs, of each span of bytes."""
    view, blake = memoryview(text), hashlib.blake2b
    digests = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())])
    both = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shingle_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, text borders ignored: a chain of mixers, not a polynomial."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = mix(words[:n], seed)
    for j in range(1, k):
        out = mix(out * U(3) + words[j : j + n], seed + j)
    return out


_WIN = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_WIN, -1, 1 << 64)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive entries, text borders ignored."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    if n > CHUNK + k:
        return np.concatenate([window_hashes(words[lo : lo + CHUNK + k - 1], k, seed) for lo in range(0, n - k + 1, CHUNK)])
    total = np.empty(n + 1, dtype=U)
    total[0] = 0
    np.cumsum(words * powers(_WIN, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n)[: n - k + 1], seed)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def parts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a larger row is alone or ends its range."""
    ends = np.cumsum(sizes)
    out, lo = [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="left")) + 1)
        out.append((lo, min(hi, len(sizes))))
        lo = out[-1][1]
    return out


def sliced(batches, rows: int = 512, size: int = 1 << 20):
    """Record batches cut so that none has more text than `size` bytes, unless one row has."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows, batch.num_rows - at)
            while take > 1 and batch.slice(at, take).nbytes > size:
                take //= 2
            yield batch.slice(at, take)
            at += take
        release()
