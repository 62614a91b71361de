"""Metric sets: counts, coverage, activity and exact nearest-rank distributions, for all and by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywood.sources.staging import staged


def ranks(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], overall: bool = False) -> DataFrame:
    """keys, `overall` (0 or 1) and exact nearest-rank percentiles, {name: (column, p)}, of each key's values and, where asked, of all rows.

    Equal values become one row with their number, for all rows from those of the keys.  These
    are sorted over ranges of keys and values; each range's total, summed up before it, tells
    which range holds a rank, and only that range is numbered.  So no aggregate or task holds a
    group's values.  Nulls don't count; a key without values has no row.  The columns asked for
    have one type.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in enumerate(columns)]))
    values = rows.select(*keys, each.alias("m")).select(*keys, "m.metric", "m.value").filter("value is not null")
    counted = values.groupBy(*keys, "metric", "value").agg(F.count("*").alias("n"))
    if overall:
        counted = counted.groupingSets([[*keys, "metric", "value"], ["metric", "value"]], *keys, "metric", "value").agg(F.sum("n").alias("n"), F.grouping(keys[0]).cast("int").alias("overall"))
    else:
        counted = counted.withColumn("overall", F.lit(0))
    by = [*keys, "overall", "metric"]
    counted = staged(counted, "counts")  # sampled for its ranges, then dealt
    ranged = staged(counted.repartitionByRange(*by, "value").withColumn("range", F.spark_partition_id()), "counted")
    own = Window.partitionBy(*by)
    before = own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range").agg(F.sum("n").alias("size")).select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(own).alias("total"))
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("ask"), F.lit(columns.index(c)).alias("of"), F.lit(float(p)).alias("p")) for k, (c, p) in enumerate(wanted.values())]))
    target = F.greatest(F.ceil(F.col("a.p") * F.col("total")), F.lit(1)) - F.col("start")
    asked = totals.select("*", asks.alias("a")).filter("a.of = metric").withColumn("target", target).filter("target > 0 and target <= size")
    asked = asked.select(*[F.col(c).alias(f"_{c}") for c in (*by, "range")], "a.ask", "target")
    here = None
    for c in (*by, "range"):
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        here = same if here is None else here & same
    upto = Window.partitionBy(*by, "range", "ask").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.join(asked, here).withColumn("upto", F.sum("n").over(upto)).filter("target <= upto and target > upto - n")
    return found.groupBy(*keys, "overall").agg(*[F.max(F.when(F.col("ask") == k, F.col("value"))).alias(name) for k, name in enumerate(wanted)])


def with_ranks(aggregated: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """aggregated (keys, a row for each key of rows, and `overall` where it has a row over all) with the percentiles of `ranks`; null where there is no value."""
    both = "overall" in aggregated.columns
    found = ranks(rows, keys, wanted, both)
    on = [*keys, "overall"] if both else keys
    if not on:
        return aggregated.join(found.drop("overall"), how="left")  # one row each
    found = found.select(*[F.col(c).alias(f"_{c}") for c in on], *wanted)
    here = F.lit(True)
    for c in on:
        here = here & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return aggregated.join(found, here, "left").drop(*[f"_{c}" for c in on])


def zero(c: str | Column) -> Column:
    return F.coalesce(c, F.lit(0))


def summary(col: str, prefix: str = "") -> list[Column]:
    """sample_size, mean (not rounded) and max of a column's values; zeros without any."""
    return [F.count(col).alias(f"{prefix}sample_size"), zero(F.avg(col)).cast("double").alias(f"{prefix}mean"), zero(F.max(col)).cast("long").alias(f"{prefix}max")]


def halves(col: str, prefix: str = "") -> dict[str, tuple[str, float]]:
    """The percentiles that a distribution shows, for `ranks`."""
    return {f"{prefix}p50": (col, 0.5), f"{prefix}p95": (col, 0.95)}


def distribution(rows: DataFrame, keys: list[str], col: str, *more: Column) -> DataFrame:
    """keys, sample_size, p50, p95, mean and max of a column's values, and more aggregates; zeros without any value."""
    made = with_ranks(rows.groupBy(*keys).agg(*summary(col), *more), rows, keys, halves(col))
    return made.withColumns({c: zero(c).cast("long") for c in ("p50", "p95")})


def by_source_and_overall(df: DataFrame, key: str, *aggs: Column, wanted: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """One row for each key and one, with a null key, over all rows, from the rows, not from the parts; with percentiles where wanted."""
    if not wanted:
        return df.groupingSets([[key], []], key).agg(*aggs)
    sets = df.groupingSets([[key], []], key).agg(*aggs, F.grouping(key).cast("int").alias("overall"))
    return with_ranks(sets, df, [key], wanted).drop("overall")


def active_days(ts: str) -> list[Column]:
    return [F.count_distinct(F.date_format(ts, "yyyy-MM-dd")).alias("active_days"), F.count_distinct(F.date_format(ts, "yyyy-MM")).alias("active_months")]


def usage(rows: DataFrame, *keys: str) -> DataFrame:
    """input, output and reported tokens of each session: the highest cumulative value if there is any, else the sum."""
    def one(field: str) -> Column:
        cumulative = F.max(F.when(F.col("cumulative"), F.col(field)))
        return F.coalesce(cumulative, F.sum(F.when(~F.col("cumulative"), F.col(field)))).alias(field)

    return rows.groupBy(*keys).agg(one("input"), one("output"), one("total"))


def complete(col: str | None = None) -> Column:
    both = F.col("input").isNotNull() & F.col("output").isNotNull()
    return both if col is None else F.when(both, F.col(col))


def coverage() -> list[Column]:
    return [
        F.count("*").alias("session_count"),
        F.count_if(F.col("input").isNotNull()).alias("with_input"),
        F.count_if(F.col("output").isNotNull()).alias("with_output"),
        F.count_if(complete()).alias("with_total"),
    ]


def mismatches() -> Column:
    """Sessions whose reported total differs from input + output, where all are known."""
    return F.count_if(complete() & F.col("total").isNotNull() & (F.col("total") != F.col("input") + F.col("output"))).alias("mismatches")
