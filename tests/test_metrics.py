import math
import random

from pyspark.sql import functions as F

from tallywood.operators import metrics, sessions


def _nearest(values, p):
    values = sorted(v for v in values if v is not None)
    return values[max(1, math.ceil(p * len(values))) - 1] if values else None


def test_exact_ranks_of_keys_and_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 7, rng.randrange(10**12)])) for _ in range(3000)]
    rows += [("hot", 5, k) for k in range(500)] + [("one", 3, None), ("none", None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, x long, y long, metric string").repartition(7)
    wanted = {"x50": ("x", 0.5), "x95": ("x", 0.95), "x0": ("x", 0.0), "y5": ("y", 0.05), "y100": ("y", 1.0)}
    got = {(r.k, r.overall): tuple(r[n] for n in wanted) for r in metrics.ranks(df, ["k"], wanted, overall=True).collect()}
    want = {}
    for key in [("a", 0), ("b", 0), (None, 0), ("hot", 0), ("one", 0), (None, 1)]:
        mine = [r for r in rows if key[1] or r[0] == key[0]]
        want[key] = tuple(_nearest([r[1 if c == "x" else 2] for r in mine], p) for c, p in wanted.values())
    assert got == want


def test_distribution_joins_ranks_by_null_safe_keys(spark):
    df = spark.createDataFrame([(None, 4), (None, 1), ("a", None), ("b", 2)], "k string, x long")
    got = {r.k: (r.sample_size, r.p50, r.p95, r["mean"], r["max"]) for r in metrics.distribution(df, ["k"], "x").collect()}
    assert got == {None: (2, 1, 4, 2.5, 4), "a": (0, 0, 0, 0.0, 0), "b": (1, 2, 2, 2.0, 2)}
    assert metrics.distribution(df.limit(0), [], "x").collect() == [(0, 0.0, 0, 0, 0)]
    both = metrics.by_source_and_overall(df, "k", F.count("*").alias("n"), wanted={"p50": ("x", 0.5)}).collect()
    assert sorted(((r.n, r.p50) for r in both), key=repr) == sorted([(1, 2), (1, None), (2, 1), (4, 2)], key=repr)


def test_shortlist_meets_in_one_shuffle(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", "z"]), k, rng.randrange(30), rng.randrange(9), rng.randrange(1000), rng.randrange(5), k) for k in range(400)]
    df = spark.createDataFrame(rows, "source string, session long, activity long, user_count long, elapsed long, tool_count long, session_order long").withColumn("source_order", F.ascii("source").cast("long"))
    short = sessions.shortlist(df)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
    assert short.count() <= 8 * (4 + 3)
    assert sessions.greedy_pick([r.asDict() for r in short.collect()]) == sessions.greedy_pick([r.asDict() for r in df.collect()])
