"""Substring dedup: words in passages of `length` words that also start anywhere else go.

The corpus is its own reference here, so automata of all documents would be the corpus
several times over, and each document would have to be streamed through every shard:
neither is bounded.  `deduplicate` therefore finds repeated windows exactly by hash, in
steps that move little and keep no group together:

1. texts in more than one row are counted; all their windows start elsewhere, so all is
   removed, and one row speaks for them where other texts are compared;
2. each window of `length` words has an anchor, the least of its `gram`-word hashes (the
   last of equals); a document's windows with one anchor are consecutive, so about one
   row for every ten words leaves a task.  Anchors are counted with partial aggregation;
3. equal windows have equal anchors: only windows with a repeated anchor are named and
   counted, again with partial aggregation.  A window's name is the 128-bit BLAKE2b digest of
   its words joined by blanks, so that no two windows can be made or expected to share one;
4. the places of repeated windows return to their texts and their words are removed.

`remove_reference` is the form for a bounded reference: suffix automata of its shards
are broadcast, documents are streamed through them for matching statistics, and maximal
spans of `length` or more words that match are removed.

Words are runs of other bytes than 0x20 and 0x09-0x0D, unchanged.  Windows are judged on
the input.  Nulls: a null text has no words; texts are known by 92 bits of their SHA-256,
not by doc_id, so null or repeated doc_ids don't mix them; repeated rows count as other
places.  An empty table gives no rows; a column named like the result is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import among, bounded_batches, drop_written, join_hot, may_be, table, unused, written
from tallywood.llm.kernels import joined_words, release, rough_hashes, sliced, span_names, string_buffers, window_hashes, word_spans

PLACE = "t long, u int"


def _windows(texts: pa.Array, length: int):
    """Rough word hashes, for every window start whether it lies in one text, and each text's first word."""
    data, offsets = string_buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    h = rough_hashes(data, starts, ends)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    ok = text_of[: max(0, len(h) - length + 1)] == text_of[length - 1 :] if len(h) >= length else np.zeros(0, bool)
    return h, ok, first, text_of


def anchor_runs(texts: pa.Array, length: int, gram: int):
    """(anchor hash, text number, first window within the text, windows) of each run of windows with one anchor."""
    h, ok, first, text_of = _windows(texts, length)
    g = window_hashes(h, gram, 21)
    if not ok.any():
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    span = length - gram + 1
    best, width = np.arange(len(g)), 1
    while width < span:  # the last least of `width` grams from each start, by doubling
        step = min(width, span - width)
        a, b = best[:-step], best[step:]
        best = np.where(g[a] < g[b], a, b)
        width += step
    s = np.flatnonzero(ok)
    anchor = best[s]
    new = np.empty(len(s), dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1) | (text_of[s[1:]] != text_of[s[:-1]])
    at = np.flatnonzero(new)
    return g[anchor[at]], text_of[s[at]], s[at] - first[text_of[s[at]]], np.diff(np.append(at, len(s)))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            g, text, s, n = anchor_runs(batch.column(2), length, gram)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(g.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["t", "u", "anchor", "s", "len"],
            )

    return docs.mapInArrow(run, PLACE + ", anchor long, s int, len int")


def windows(docs: DataFrame, length: int) -> DataFrame:
    """docs (t, u, text, runs array<struct<s, n>>): t, u, w, x, s, more for each distinct window of each row's runs.

    w and x are the two halves of the digest of its words, its name.

    s is the window's first start; `more` has its other starts in the same row, if any, so
    that a line said a thousand times in one text is one row.
    """
    kind = pa.list_(pa.int32())

    def run(batches):
        for batch in sliced(batches):
            data, offsets = string_buffers(batch.column(2))
            starts, ends, first = word_spans(data, offsets)
            words, begin = joined_words(data, starts, ends)
            runs = batch.column(3)
            text = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            s, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(text, n)
            if not len(row):
                continue
            local = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            word = first[row] + local
            key, check = span_names(words, begin[word], begin[word + length] - 1)
            order = np.lexsort((local, check, key, row))
            row, local, key, check = row[order], local[order].astype(np.int32), key[order], check[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
            size = np.diff(np.append(new, len(row))) - 1
            others = np.ones(len(row), dtype=bool)
            others[new] = False
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(ends), pa.array(local[others]), type=kind, mask=pa.array(size == 0))
            at = row[new]
            out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(key[new]), pa.array(check[new]), pa.array(local[new]), more], names=["t", "u", "w", "x", "s", "more"])
            for lo in range(0, out.num_rows, 200_000):
                yield out.slice(lo, 200_000)

    return docs.mapInArrow(run, PLACE + ", w long, x long, s int, more array<int>")


CUT = "n_words long, n_removed long, kept_sha256 string, kept_text string"


def cut_out(length: int, keep_text: bool, keep_digest: bool):
    """A function of (text, starts, whole): what stays without the words that the windows from these starts, or all windows, cover."""

    @F.arrow_udf(CUT)
    def cut(text: pa.Array, starts: pa.Array, whole: pa.Array) -> pa.Array:
        out = []
        for one, s, every in zip(text, starts, whole.to_pylist()):
            one = one.as_py()
            words = (one or "").encode("utf-8", "surrogatepass").split()
            n, removed, kept = len(words), 0, words
            if every and n >= length:
                keep, kept, removed = np.zeros(n, dtype=bool), [], n
            elif s.is_valid and len(s):
                s = s.values.to_numpy()
                cover = np.zeros(n + 1, dtype=np.int32)
                np.add.at(cover, s, 1)
                np.add.at(cover, np.minimum(s + length, n), -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                removed = n - len(kept)
            digest = hashlib.sha256(b" ".join(kept)).hexdigest() if keep_digest else None
            out.append((n, removed, digest, (_rebuilt(one, keep) if removed else one) if keep_text else None))
        n, removed, digest, kept = zip(*out) if out else ((), (), (), ())
        made = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=[c.split()[0] for c in CUT.split(", ")])
        del out, kept
        release()
        return made

    return cut


def _rebuilt(text: str, keep: np.ndarray) -> str:
    """The text without the removed words and the white space before them; other spacing stays."""
    data = text.encode("utf-8", "surrogatepass")
    starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.asarray([0, len(data)]))
    out, last = [], 0
    k = np.flatnonzero(np.diff(np.concatenate([[False], ~keep, [False]]).astype(np.int8)))
    for a, b in zip(k[::2].tolist(), k[1::2].tolist()):
        out.append(data[last : ends[a - 1] if a else 0])
        last = int(ends[b - 1])
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass").strip("\n ") if out else ""


def _named(text) -> list:
    """92 bits of a text's SHA-256, as a long and an int."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, n), 16, -10).cast("long") if n == 16 else F.conv(F.substring(digest, at, n), 16, 10).cast("long").cast("int") for at, n in ((1, 16), (17, 7))]


def repeated_texts(own: DataFrame) -> DataFrame:
    """(t, u, n, low) of texts in more than one row of own (doc_id, t, u, text): number of rows and least doc_id."""
    return own.filter("text is not null").groupBy("t", "u").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).filter("n > 1")


def one_of_each(own: DataFrame, copied: DataFrame) -> DataFrame:
    """t, u, text of one row of each text; only rows whose text may be repeated are shuffled."""
    near, clear = may_be(own, copied.select("t"), "t")
    total = copied.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = copied.filter(F.col("n") * 1000 > total).select("t", "u", F.lit(True).alias("hot"), "low")  # fewer than 1000
    near = near.join(F.broadcast(hot), ["t", "u"], "left").filter(F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("low"))).drop("hot", "low")
    near = near.join(copied.select("t", "u", "low", "n"), ["t", "u"], "left").filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("low")))
    once = written(near.select("t", "u", "text").dropDuplicates(["t", "u"]), "once")
    return clear.select("t", "u", "text").unionByName(once)


def repeated_starts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(t, u, starts) of the windows that start anywhere else too, for distinct texts (t, u, text).

    Anchors are made twice rather than kept, and bitmaps clear most rows before a join.
    """
    again = written(anchors(texts, length, gram).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    found = among(anchors(texts, length, gram), again.select("anchor"), "anchor", 25)
    runs = join_hot(found, again, ["anchor"], ["t"]).groupBy("t", "u").agg(F.collect_list(F.struct("s", F.col("len").alias("n"))).alias("runs"))  # bounded by the text
    runs = written(runs, "runs")
    near = windows(among(texts, runs.select("t"), "t").join(runs, ["t", "u"]).select("t", "u", "text", "runs"), length)
    twice = near.groupBy("w", "x").agg(F.sum(F.when(F.col("more").isNull(), 1).otherwise(2)).alias("n")).filter("n > 1")
    hits = join_hot(near, twice, ["w", "x"], ["t"]).groupBy("t", "u").agg(F.concat(F.collect_set("s"), F.flatten(F.collect_list("more"))).alias("starts"))
    out = written(hits, "starts")
    drop_written(again, runs)
    return out


def deduplicate(docs: DataFrame, length: int = 35, gram: int = 16, keep_text: bool = True, keep_digest: bool = True, into: str = "cut") -> DataFrame:
    """docs with a column `into` (n_words, n_removed, kept_sha256, kept_text); all its rows and other columns stay."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into)
    t, u, starts, whole = unused(docs, "t", "u", "starts", "whole")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _named(text)[0].alias("t"), _named(text)[1].alias("u"), text.alias("text"))
    copied = written(repeated_texts(own), "copied")
    found = repeated_starts(one_of_each(own, copied), length, gram)
    found = found.join(copied, ["t", "u"], "left_anti").select("t", "u", "starts", F.lit(False).alias("whole"))
    total = copied.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("n") * 1000 > total
    said = found.unionByName(copied.filter(~hot).select("t", "u", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))
    said = written(said.select(F.col("t").alias(t), F.col("u").alias(u), F.col("starts").alias(starts), F.col("whole").alias(whole)), "said")
    hot = F.broadcast(copied.filter(hot).select(F.col("t").alias(t), F.col("u").alias(u)))  # fewer than 1000

    keyed = docs.withColumns(dict(zip((t, u), _named(text))))
    copies = keyed.join(hot, [t, u], "left_semi").withColumns({starts: F.lit(None).cast("array<int>"), whole: F.lit(True)})
    near, clear = may_be(keyed.join(hot, [t, u], "left_anti"), said.select(t), t)
    near = near.join(said, [t, u], "left")
    clear = clear.withColumns({starts: F.lit(None).cast("array<int>"), whole: F.lit(False)})
    both = near.unionByName(clear).unionByName(copies)
    return both.withColumn(into, cut_out(length, keep_text, keep_digest)(text, F.col(starts), F.coalesce(F.col(whole), F.lit(False)))).select(*docs.columns, into)


class SuffixAutomaton:
    """Of a list of word sequences; a match never runs over a sequence's end."""

    def __init__(self, sequences):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(word)
        if q is not None:  # known from an earlier sequence
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, word)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return cur

    def _split(self, p: int, q: int, word) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def statistics(self, words) -> list[int]:
        """For each position the length of the longest match that ends there."""
        state, n, out = 0, 0, []
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def remove_reference(docs: DataFrame, reference: list[str], length: int = 35, most_words: int = 2_000_000, shards: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of docs (doc_id, text) without spans of `length` or more words of the reference.

    The reference is given on the driver and may have `most_words` words at most: it is broadcast to every task.
    """
    seqs = [r.encode().split() for r in reference]
    if sum(map(len, seqs)) > most_words:
        raise ValueError(f"the reference has more than {most_words} words; use deduplicate over documents and reference")
    held = docs.sparkSession.sparkContext.broadcast([seqs[k::shards] for k in range(shards)])

    def run(batches):
        machines = [SuffixAutomaton(s) for s in held.value if s]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                keep = np.ones(len(words), dtype=bool)
                for m in machines:
                    for i, k in enumerate(m.statistics(words)):
                        if k >= length:
                            keep[i + 1 - k : i + 1] = False
                gone = len(words) - int(keep.sum())
                out.append({"doc_id": doc_id, "n_words": len(words), "n_removed": gone, "kept_text": _rebuilt(text, keep) if gone else text})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs, keep_text=False).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


#: By brute force: every window as text.
OP10_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
cover AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM s WHERE k IN (SELECT k FROM again)),
gone AS (SELECT r, count(*) AS n FROM cover GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS said FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN cover USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
