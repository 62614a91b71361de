"""Toxicity scores from subword bags: n-gram embeddings averaged into a linear softmax.

A word is a maximal run of letters, digits, non-ASCII bytes and `@ $ *`, lower-cased; its
subwords are all n-grams of 3 to 6 bytes of the word with one border mark on each side,
hashed into `buckets`.  A word is the mean of its subword vectors, so an unseen
misspelling shares most of its vector with the word.  Bags are windows of `window` words
(each word falls in one, counted from the text's first word); the softmax layer reads each
window's average, and the window that speaks loudest is the text's score, so a few words
in a long text still count.  Embeddings and
softmax layer are trained jointly in numpy by Adam on a bounded sample of labelled
texts; the fitted score per subword is a number, so scoring is a table look-up.

Nulls: a null or empty text has the score of no evidence (the fitted bias); a null
doc_id is carried, is never held out and has no label.  Documents with contradictory
labels count with each.  Where no label, or only one kind of label, can be learned, all
scores are alike, near 0 (no label, or all 0) or near 1 (all 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import bounded_batches, held_out, table
from tallywood.llm.kernels import LOWER, U, mix, parts, powers, release, string_buffers, word_spans

SOLID = np.zeros(256, dtype=bool)
SOLID[128:] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    SOLID[_a:_b] = True
SOLID[[0x40, 0x24, 0x2A]] = True
GRAMS = (3, 4, 5, 6)
SLICE = 200_000  # bytes of text scored at once
_B = 0xB5297A4D3F84D5B5 | 1
_BI = pow(_B, -1, 1 << 64)


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int):
    """For each n: (bucket of the n-gram at each byte, mask of proper n-grams, word number); then words' texts."""
    n = len(data) + len(offsets) + 1  # a border before every text and at the end
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    text = np.zeros(n + 8, dtype=np.uint8)
    text[at] = np.where(SOLID[data], LOWER[data], 0)
    solid = text > 0
    start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    word = np.cumsum(np.concatenate([[0], (solid[1:] & ~solid[:-1])])) - 1  # a border belongs to the word before it
    total = np.zeros(len(text) + 1, dtype=U)
    np.cumsum((text.astype(U) + U(1)) * powers(_B, len(text)), out=total[1:])
    back = powers(_BI, len(text))
    inner = np.concatenate([[0], np.cumsum(~solid)])
    out = []
    for k in GRAMS:
        m = len(text) - k + 1
        ok = (inner[k - 1 : k - 1 + m] - inner[1 : 1 + m]) == 0  # all but the first and last are letters
        i = np.flatnonzero(ok)
        h = mix((total[i + k] - total[i]) * back[i], k) >> U(64 - bits)
        out.append((h.astype(np.int64), word[i + 1]))
    text_of = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), start, side="left")
    return out, text_of, len(start)


def bags(texts: pa.Array, bits: int):
    """(bucket, word, weight 1 / subwords of the word) triples and each word's text."""
    data, offsets = string_buffers(texts)
    grams, text_of, words = subwords(data, offsets, bits)
    bucket = np.concatenate([g[0] for g in grams])
    word = np.concatenate([g[1] for g in grams])
    weight = 1.0 / np.maximum(1, np.bincount(word, minlength=words))
    return bucket, word, weight, text_of


def windows_of(text_of: np.ndarray, texts: int, window: int):
    """Window number of each word and text of each window; every text has at least one."""
    count = np.bincount(text_of, minlength=texts)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    per = np.maximum(1, -(-count // window))
    base = np.concatenate([[0], np.cumsum(per)[:-1]])
    return base[text_of] + (np.arange(len(text_of)) - first[text_of]) // window, np.repeat(np.arange(texts), per), count


def pooled(word_scores: np.ndarray, text_of: np.ndarray, texts: int, window: int, bias: float) -> np.ndarray:
    """Logit of each text: the highest of its windows' mean scores."""
    win, win_text, _ = windows_of(text_of, texts, window)
    sums = np.bincount(win, word_scores, len(win_text))
    out = np.full(texts, -np.inf)
    np.maximum.at(out, win_text, sums)
    return out / window + bias


def train(texts: list[str], labels: np.ndarray, bits: int = 16, dim: int = 8, window: int = 4, epochs: int = 4, rate: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """Scalar per bucket (embedding times the softmax layer's difference) and bias."""
    rng = np.random.default_rng(seed)
    size = 1 << bits
    emb = rng.normal(0, 0.1, (size, dim))
    layer = rng.normal(0, 0.5, (dim, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (layer, bias)]
    square = np.zeros(size)
    order = np.arange(len(texts))
    step = 0
    for epoch in range(epochs):
        rng.shuffle(order)
        for lo in range(0, len(order), 64):
            step += 1
            chosen = order[lo : lo + 64]
            bucket, word, weight, text_of = bags(pa.array([texts[i] for i in chosen], pa.large_string()), bits)
            if not len(word):
                continue
            y = labels[chosen]
            score = emb @ (layer[:, 1] - layer[:, 0])
            per_word = np.bincount(word, score[bucket], len(text_of)) * weight
            win, win_text, _ = windows_of(text_of, len(chosen), window)
            sums = np.bincount(win, per_word, len(win_text)) / window
            best = np.lexsort((-sums, win_text))
            best = best[np.unique(win_text[best], return_index=True)[1]]  # the window that speaks for each text
            role = np.full(len(win_text), -1)
            role[best] = win_text[best]
            used = role[win[word]]
            keep = used >= 0
            b, row, w = bucket[keep], used[keep], weight[word[keep]] / window
            kinds, inverse = np.unique(b, return_inverse=True)
            mean = np.zeros((len(chosen), dim))
            for d in range(dim):
                mean[:, d] = np.bincount(row, emb[b, d] * w, len(chosen))
            logits = mean @ layer + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y] -= 1
            grad_layer, grad_bias, grad_mean = mean.T @ p / len(chosen), p.mean(0), p @ layer.T
            grad = np.empty((len(kinds), dim))
            for d in range(dim):
                grad[:, d] = np.bincount(inverse, grad_mean[row, d] * w, len(kinds))
            square[kinds] += (grad**2).mean(1)
            emb[kinds] -= rate * grad / (np.sqrt(square[kinds])[:, None] + 1e-8)
            for x, g, s in ((layer, grad_layer, state[0]), (bias, grad_bias, state[1])):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                x -= 0.02 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return (emb @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int], longest: int) -> tuple[list[str], np.ndarray]:
    """At most most[k] training texts of up to `longest` characters with label k, the first by hash of id."""
    from functools import reduce

    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    short = docs.filter(F.length("text").between(1, longest)).select("doc_id")
    known = known.join(short, "doc_id", "left_semi")
    picked = reduce(DataFrame.unionAll, [known.filter(F.col("toxic") == k).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(most[k]) for k in (0, 1)])
    ids = [(r.doc_id, r.toxic) for r in picked.collect()]  # sum(most) at most
    if not ids:
        return [], np.zeros(0, np.int64)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id", "toxic"]).orderBy("doc_id").limit(sum(most)).collect()
    return [r.text or "" for r in rows], np.asarray([r.toxic for r in rows], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (4500, 1500), longest: int = 20_000, **options) -> dict:
    """A model from at most most[0] texts that aren't toxic and most[1] that are, of up to `longest` characters each."""
    texts, y = sample(docs, labels, most, longest)
    window = options.get("window", 4)
    bits = options.get("bits", 16)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return {"table": np.zeros(1 << bits, np.float32), "bias": 20.0 * (2 * p - 1), "bits": bits, "window": window}
    scores, bias = train(texts, y, **options)
    del texts
    release()  # the driver lives on
    return {"table": scores, "bias": bias, "bits": bits, "window": window}


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    """The score of each text; a text longer than SLICE is read in parts of whole windows, so scratch arrays stay small."""
    if len(texts) == 1 and (pieces := _long(texts, model["window"])):
        z = np.asarray([max(_logits(p, model)[0] for p in pieces)])
    else:
        z = _logits(texts, model)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _long(texts: pa.Array, window: int) -> list[pa.Array]:
    """One long text in parts that begin with the first word of a window; none for a shorter text."""
    data, _ = string_buffers(texts)
    if len(data) <= SLICE:
        return []
    starts, _, _ = word_spans(data, np.asarray([0, len(data)]), ~SOLID)
    firsts = starts[::window]
    cuts, at = [0], 0
    while at < len(firsts):
        k = int(np.searchsorted(firsts, cuts[-1] + SLICE))
        at = max(k, at + 1)
        if at < len(firsts):
            cuts.append(int(firsts[at]))
    cuts.append(len(data))
    return [pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.asarray([0, b - a], dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data[a:b]))]) for a, b in zip(cuts, cuts[1:])]


def _logits(texts: pa.Array, model: dict) -> np.ndarray:
    grams, text_of, words = subwords(*string_buffers(texts), model["bits"])
    total, count = np.zeros(words), np.zeros(words)
    for bucket, word in grams:
        total += np.bincount(word, model["table"][bucket], words)
        count += np.bincount(word, minlength=words)
    return pooled(total / np.maximum(1, count), text_of, len(texts), model["window"], model["bias"])


def with_scores(docs: DataFrame, model: dict, column: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text."""
    bounded_batches(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(text))
        for lo, hi in parts(sizes, SLICE):
            out[lo:hi] = score_texts(text.slice(lo, hi - lo), handle.value)
        release()
        return pa.array(out)

    return docs.withColumn(column, score(F.col("text").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return with_scores(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels, **options), "score").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
