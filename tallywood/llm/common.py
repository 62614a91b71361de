"""Small helpers of the operators: tables, shared checkpoints, unused names, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="tallywood-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return _OWN["dir"]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes Parquet to the shared folder and reads it back; what nobody drops goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _path(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes what written() made, once nothing will read it again."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            files, p = _path(df.sparkSession, path)
            files.delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own, k = f"_{name}", 0
        while own.lower() in have:
            own, k = f"_{name}{k}", k + 1
        have.add(own.lower())
        out.append(own)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session has no bound: rows may be texts, and ten thousand of them fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "", str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set(key, BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wide(df: DataFrame, *cols) -> DataFrame:
    """Deals rows by key over a set number of partitions, so that Python work isn't coalesced into few tasks."""
    return df.repartition(shuffle_partitions(df.sparkSession), *cols)


def held_out(col="doc_id"):
    """True for the quarter of the ids that no model may learn labels from."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def among(df: DataFrame, ids: DataFrame, column: str, bits: int = 22) -> DataFrame:
    """The rows of df whose `column` may be among ids (one column of that name); rows that surely aren't go before any shuffle.

    A bitmap of 2**bits hashes of the ids, at most 2**(bits - 6) rows of two longs, is
    broadcast (a hash of that many bits bounds it whatever the number of ids).  Every row
    among the ids stays; a join decides the others.
    """
    marked, may, drop = _marked(df, ids, column, bits)
    return marked.filter(may).drop(*drop)


def may_be(df: DataFrame, ids: DataFrame, column: str, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """The rows of df that may be among ids, and those that surely aren't."""
    marked, may, drop = _marked(df, ids, column, bits)
    return marked.filter(may).drop(*drop), marked.filter(~F.coalesce(may, F.lit(False))).drop(*drop)


def may_be_column(df: DataFrame, ids: DataFrame, column: str, flag: str, bits: int = 22) -> DataFrame:
    """df with a column `flag` that is false only for rows that surely aren't among ids."""
    marked, may, drop = _marked(df, ids, column, bits)
    return marked.withColumn(flag, F.coalesce(may, F.lit(False))).drop(*drop)


def without(df: DataFrame, ids: DataFrame, column: str, bits: int = 22) -> DataFrame:
    """The rows of df whose `column` isn't among ids; only rows that the bitmap can't clear are shuffled."""
    near, clear = may_be(df, ids, column, bits)
    return clear.unionByName(near.join(ids, column, "left_anti").select(clear.columns))


def join_hot(df: DataFrame, counted: DataFrame, keys: list[str], spread: list[str], share: int = 1000, total: int | None = None) -> DataFrame:
    """df inner joined with counted on keys, where no key brings more than 1/share of df's rows to one task.

    counted has a row for each key, its number `n` of rows in df, and other columns.  Keys
    with more than 1/share of all rows, fewer than `share` of them, are broadcast; their
    rows are dealt by `spread` too.  `total` is the number of all rows, where it is known.
    """
    values = [c for c in counted.columns if c not in keys]
    hot_, light_, salt_ = unused(df, "hot", "light", "salt")
    if total is None:
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    whole = F.struct(*values)
    hot = counted.filter(F.col("n") * share > total).select(*keys, whole.alias(hot_))
    light = counted.filter(F.col("n") * share <= total).select(*keys, F.lit(0).cast("long").alias(salt_), whole.alias(light_))
    dealt = df.join(F.broadcast(hot), keys, "left").withColumn(salt_, F.when(F.col(hot_).isNotNull(), F.xxhash64(*spread)).otherwise(0))
    both = dealt.join(light, [*keys, salt_], "left").withColumn(hot_, F.coalesce(hot_, light_)).filter(F.col(hot_).isNotNull())
    return both.select(*[F.col(c) for c in df.columns], *[F.col(f"{hot_}.{v}").alias(v) for v in values])


def _marked(df: DataFrame, ids: DataFrame, column: str, bits: int):
    """df with two more columns, whether a row may be among ids, and the columns to drop."""
    word, bits_of = unused(df, "word", "bits")
    slot = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    place, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))")
    bitmap = ids.select(place.alias(word), bit.alias("b")).groupBy(word).agg(F.bit_or("b").alias(bits_of))
    marked = df.withColumn(word, place).join(F.broadcast(bitmap), word, "left")
    return marked, F.col(bits_of).bitwiseAND(bit) != 0, (word, bits_of)
