"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from a bounded sample of
labelled texts; a text goes to the language whose dictionary compresses it best.  The
whole text is compressed in blocks of `block` bytes, each against the dictionary alone,
so that a long text doesn't become its own model.  `score` is the margin to the second
language relative to its size, scaled to 0..1; `rejected` marks narrow margins.

Nulls: a null text or one without a letter is `und` with score 0; a null doc_id is
carried and never held out.  Ties go to the alphabetically first language.  Without any
labelled text every row is `und`.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywood.llm.common import bounded_batches, held_out, table

_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The text's words in lower case, letters only."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())


def sample(docs: DataFrame, per_language: int, longest: int) -> dict[str, list[str]]:
    """About per_language distinct texts of each language (2 * per_language at most), chosen by hash among training rows.

    Texts of 200 to `longest` characters come first; a language with fewer of them than
    per_language takes others too, of which at most `longest` characters are read.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") > 0))
    rows = rows.select("lang", "doc_id", F.substring("text", 1, longest).alias("text"), F.length("text").between(200, longest).alias("fit"))
    counts = {(r.lang, r.fit): r["count"] for r in rows.groupBy("lang", "fit").count().collect()}  # two rows a language
    out: dict[str, list[str]] = {}
    if not counts:
        return out
    chances = []
    for lang, fit in counts:
        fitting = counts.get((lang, True), 0)
        wanted = per_language if fit else per_language - fitting
        chances.append((lang, fit, 1.3 * wanted / counts[lang, fit]))
    share = docs.sparkSession.createDataFrame([c for c in chances if c[2] > 0], "lang string, fit boolean, share double")
    chance = F.pmod(F.xxhash64("text", F.lit(29)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = rows.join(F.broadcast(share), ["lang", "fit"]).filter(chance < F.col("share")).select("lang", "fit", "text").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("fit"), F.xxhash64("text"), "text"))
    for r in rows.withColumn("nth", nth).filter(F.col("nth") <= 2 * per_language).orderBy("lang", "nth").collect():
        out.setdefault(r.lang, []).append(r.text)
    return out


def dictionaries(samples: dict[str, list[str]], size: int) -> dict[str, bytes]:
    """Equal shares of each sampled text's bytes, `size` in all for each language; what short texts leave goes to the longer ones."""
    out = {}
    for lang, texts in sorted(samples.items()):
        words = sorted((plain(t) for t in texts), key=len)
        cut, left = [], size
        for i, w in enumerate(words):
            cut.append(w[: max(0, left // (len(words) - i) - 1)])
            left -= len(cut[-1]) + 1
        out[lang] = b" ".join(cut)
    return out


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int, block: int):
        import regex
        import zstandard as z

        self.names = sorted(content)
        self.letter = regex.compile(r"\p{L}")
        self.block = block
        self.makers = []
        for k in self.names:
            d = z.ZstdCompressionDict(content[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.makers.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not self.letter.search(text):
            return "und", 0.0
        data = plain(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = [sum(len(m.compress(b)) for b in blocks) for m in self.makers]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        if len(order) == 1:
            return self.names[0], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.names[order[0]], min(1.0, 4 * (second - best) / second)


def identify(docs: DataFrame, per_language: int = 300, longest: int = 20_000, size: int = 110_000, level: int = 5, block: int = 4096, margin: float = 0.02) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of docs (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(dictionaries(sample(docs, per_language, longest), size))  # `size` bytes a language at most

    @F.pandas_udf("lang_pred string, score double")
    def guess(text: pd.Series) -> pd.DataFrame:
        f = _ready(content, level, block)
        return pd.DataFrame([f(t) for t in text], columns=["lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), guess(F.col("text").cast("string")).alias("g"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "g.lang_pred", "g.score", (F.col("g.score") < margin).alias("rejected"))


_READY: dict = {}


def _ready(content, level: int, block: int) -> Classifier:
    """One classifier for each worker process and model; the model is known by its bytes, for workers outlive a run."""
    key = (tuple(sorted((k, zlib.crc32(v)) for k, v in content.value.items())), level, block)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Classifier(content.value, level, block)
    return _READY[key]


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
