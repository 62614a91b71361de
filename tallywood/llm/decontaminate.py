"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and seen as words of ASCII letters, digits and non-ASCII
characters.  An item's window has as many words as the item; its shingles are all its
runs of `words` words, each weighted by how often it occurs.  Steps:

1. a bound: a window of similarity `similarity` or more misses at most
   (1 - similarity) * shingles of an item's shingles, so it holds one of any set with one
   more.  The item's rarest such set are its probes; windows without a probe needn't be
   fingerprinted.  Every window over a probe is, whatever else it holds;
2. SimHash: each such window gets a 64-bit weighted fingerprint, its bits the majorities
   over the shingles (64 counters, three to a long);
3. multi-index: the fingerprints are cut in `blocks` blocks; two within `radius`
   = blocks * (flips + 1) - 1 bits differ in at most `flips` bits of one block.  The items'
   blocks are entered with all patterns of up to `flips` bits turned, so an equi-join on a
   block finds every pair within the radius, and few others; those beyond it go.  The
   entries grow with the items, so they are joined by a shuffle and never broadcast;
4. candidates are verified by exact weighted-shingle similarity, sum of minima over sum
   of maxima, at least `similarity`.

At similarity 0.8 the expected distance is 9.7 bits with deviation 2.9; neighbouring
windows that pass too give a document further chances.

Nulls: a null text has no words; a null doc_id is carried along (rows are told apart by
doc_id and text); a null item text or one of fewer than `words` words matches nothing.
A document shorter than an item is one window.  Repeated rows have the same answer.  Of
several windows for one item the most similar, then the first, is reported.  Empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import among, drop_written, table, unused, without, written

WORDS = r"array_remove(split(lower({0}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), '')"
LANES = 1 | 1 << 21 | 1 << 42


def shingled(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """Adds nw (number of words) and sh (hash of each run of `words` words).

    The word hashes pass through a one-row explode: else the optimizer would put their
    expression in the lambda, to be computed again for every word.
    """
    parts = ", ".join(f"h[i + {k}]" for k in range(words))
    return (
        df.select("*", F.explode(F.array(F.expr(f"transform({WORDS.format(text)}, w -> xxhash64(w))"))).alias("h"))
        .withColumn("nw", F.expr("size(h)"))
        .withColumn("sh", F.expr(f"if(nw < {words}, cast(array() as array<bigint>), transform(sequence(0, nw - {words}), i -> xxhash64({parts})))"))
        .drop("h")
    )


def occurrences(df: DataFrame, array: str, into: str) -> DataFrame:
    """Adds the array's values, each hashed with its place among equal ones, so that sets of them compare as multisets."""
    (ordered,) = unused(df, "ordered")
    out = df.withColumn(ordered, F.explode(F.array(F.array_sort(array))))
    return out.withColumn(into, F.expr(f"transform({ordered}, (x, i) -> xxhash64(x, i - array_position({ordered}, x)))")).drop(ordered)


def fingerprint(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """(keys, fp): the SimHash of each row's array of shingle hashes."""
    lanes = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(F.lit(LANES if i < 21 else 1))).alias(f"s{i}") for i in range(21)]
    lanes.append(F.sum(F.shiftrightunsigned("x", 63)).alias("s21"))
    sums = df.select(*keys, F.explode(array).alias("x")).groupBy(*keys).agg(F.count("*").alias("n"), *lanes)
    at = [(f"shiftrightunsigned(s{i}, {21 * lane}) & {(1 << 21) - 1}L", i + 21 * lane) for i in range(21) for lane in range(3)] + [("s21", 63)]
    return sums.select(*keys, F.expr(" | ".join(f"if(({count}) * 2 > n, shiftleft(1L, {bit}), 0L)" for count, bit in at)).alias("fp"))


def with_blocks(df: DataFrame, blocks: int, flips: int = 0) -> DataFrame:
    """One row for each block of fp and each pattern of at most `flips` bits turned in it."""
    bounds = [round(64 * k / blocks) for k in range(blocks + 1)]
    cut = ", ".join(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L" for a, b in zip(bounds, bounds[1:]))
    out = df.select("*", F.posexplode(F.expr(f"array({cut})")).alias("block", "value"))
    if not flips:
        return out
    width = max(b - a for a, b in zip(bounds, bounds[1:]))
    turned = ", ".join(f"{m}L" for m in range(1 << width) if m.bit_count() <= flips)
    return out.withColumn("turned", F.explode(F.expr(f"array({turned})"))).withColumn("value", F.col("value").bitwiseXOR(F.col("turned"))).drop("turned")


def probes(items: DataFrame, hits: DataFrame, similarity: float) -> DataFrame:
    """(item_id, nw, m, x): of each item the floor((1 - similarity) * m) + 1 shingles that are rarest among hits."""
    seen = hits.groupBy("x").agg(F.count("*").alias("seen"))
    each = items.select("item_id", "nw", F.size("sh").alias("m"), F.explode("sh").alias("x")).join(seen, "x", "left")
    ranked = each.groupBy("item_id", "nw", "m").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "x"))).alias("r"))  # bounded by the item
    keep = F.expr(f"cast(floor({1 - similarity:.12f}D * m + 1e-9D) + 1 as int)")
    return ranked.select("item_id", "nw", "m", F.explode(F.array_distinct(F.transform(F.slice("r", F.lit(1), keep), lambda s: s["x"]))).alias("x"))


def spans_of(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, spans): the starts of all windows over a probe, by the window's length."""
    at = hits.join(chosen.select("x", "nw", "m").distinct(), "x").groupBy("key", "dw", "nw", "m").agg(F.collect_set("pos").alias("at"))
    starts = F.expr("array_distinct(flatten(transform(at, p -> sequence(greatest(0, least(p - m + 1, dw - nw)), greatest(0, least(p, dw - nw))))))")
    return at.select("key", "nw", "m", starts.alias("starts")).groupBy("key").agg(F.collect_list(F.struct("nw", "m", "starts")).alias("spans"))  # bounded by the document


def every_span(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """(key, spans) of all windows of all documents: what spans_of leaves out can't pass, which tests show with this."""
    lengths = [(r.nw, r.nw - words + 1) for r in items.select("nw").distinct().collect()]
    span = [F.struct(F.lit(n).alias("nw"), F.lit(m).alias("m"), F.expr(f"sequence(0, greatest(0, nw - {n}))").alias("starts")) for n, m in lengths]
    return shingled(docs, words).filter(f"nw >= {words}").select("key", F.array(*span).alias("spans")).dropDuplicates(["key"])


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, similarity: float = 0.8, blocks: int = 5, flips: int = 3, most_broadcast: int = 2_000_000, probing: bool = True) -> DataFrame:
    """doc_id, key, item_id, start, n_words, similarity of every document and item with a similar enough window.

    docs has doc_id and text, items item_id and text; start counts words from 0; key is
    xxhash64(doc_id, text).  Without `probing` all windows are fingerprinted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    items = shingled(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), words).filter(f"nw >= {words}")
    items = written(occurrences(items.select("item_id", "nw", "sh").dropDuplicates(["item_id", "nw", "sh"]), "sh", "z"), "items")
    hits = None
    if probing:
        known = items.select(F.explode("sh").alias("x")).distinct()
        if known.count() <= most_broadcast:
            known = F.broadcast(known)
        hits = written(shingled(docs, words).select("key", F.col("nw").alias("dw"), F.posexplode("sh").alias("pos", "x")).join(known, "x"), "hits")
        spans = written(spans_of(hits, probes(items, hits, similarity)), "spans")
    else:
        spans = written(every_span(docs, items, words), "spans")
    near = among(docs, spans.select("key"), "key").dropDuplicates(["key"]).join(spans, "key")
    wanted = written(shingled(near, words).select("key", "doc_id", "sh", "spans"), "wanted")

    windows = wanted.select("key", "sh", F.explode("spans").alias("span")).select("key", "sh", F.col("span.nw").alias("nw"), F.col("span.m").alias("m"), F.explode("span.starts").alias("start"))
    left = with_blocks(fingerprint(windows.select("key", "nw", "start", F.expr("slice(sh, start + 1, m)").alias("sh")), ["key", "nw", "start"], "sh"), blocks)
    right = with_blocks(fingerprint(items, ["item_id", "nw"], "sh"), blocks, flips).withColumnRenamed("fp", "item_fp")
    close = left.join(right.hint("merge"), ["nw", "block", "value"]).filter(f"bit_count(fp ^ item_fp) <= {blocks * (flips + 1) - 1}").select("key", "nw", "start", "item_id").distinct()

    listed = close.groupBy("key").agg(F.collect_list(F.struct("nw", "start", "item_id")).alias("c"))
    pairs = wanted.select("key", "doc_id", "sh").join(listed, "key").select("key", "doc_id", "sh", F.explode("c").alias("c")).select("key", "doc_id", "c.*", F.expr(f"slice(sh, c.start + 1, c.nw - {words - 1})").alias("sh"))
    pairs = occurrences(pairs, "sh", "a").join(items.select("item_id", "nw", F.col("z").alias("b")), ["item_id", "nw"])
    both = F.expr("size(array_intersect(a, b))")
    passed = pairs.withColumn("similarity", both / (F.size("a") + F.size("b") - both)).filter(F.col("similarity") >= similarity)
    best = passed.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "nw")).alias("m"))
    out = written(best.select("doc_id", "key", "item_id", (-F.col("m.back")).cast("long").alias("start"), F.col("m.nw").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity")), "found")
    drop_written(items, spans, wanted, *([hits] if probing else []))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, without a window similar to an item."""
    (key,) = unused(docs, "key")
    gone = contaminated(docs.select("doc_id", "text"), items, **options).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return without(keyed, gone, key).select(docs.columns)


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
