"""Connected components of large graphs by alternating large-star and small-star steps.

Every step is a group-by with partial aggregation and one join; nothing of the graph
comes to the driver but two numbers a round.  Rounds are cut by tables in the shared
folder, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import drop_written, join_hot, written


def _star(edges: DataFrame, large: bool, total: int, of: list[str]) -> DataFrame:
    """Every vertex points its (larger or not larger) neighbours to the smallest vertex near it.

    Vertices with more than a thousandth of the `total` edges are met over all tasks.
    """
    moved = [*of, F.col("b").alias("a"), F.col("m").alias("b")]
    if large:
        near = edges.unionAll(edges.select(*of, F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy(*of, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        out = join_hot(near.filter("b > a"), low.filter("n > 0"), [*of, "a"], ["b"], total=total).select(*moved)
    else:
        near = edges.select(*of, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy(*of, "a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = join_hot(near, low, [*of, "a"], ["b"], total=total).select(*moved).unionAll(low.select(*of, "a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _progress(edges: DataFrame, of: list[str]) -> tuple[int, int]:
    """How many edges there are, and how many vertices keep them from being stars around the smaller ends."""
    ends = edges.select(*of, F.col("a").alias("v"), F.lit(1).alias("x"), (F.col("a") <= F.col("b")).cast("int").alias("y"))
    ends = ends.unionAll(edges.select(*of, F.col("b").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = ends.groupBy(*of, "v").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
    seen = each.agg(F.coalesce(F.sum("x"), F.lit(0)), F.count_if(F.expr("x > 1 or (x > 0 and y > 0)"))).first()
    return int(seen[0]), int(seen[1])


def components(edges: DataFrame, most: int = 60, graph: str | None = None) -> DataFrame:
    """(v, component): the smallest vertex reachable, for every vertex of edges (a, b); a loop or null ends are no edge.

    With `graph`, a column of edges, its values are graphs of their own; the result has it too.
    """
    of = [graph] if graph else []
    edges = written(edges.select(*of, F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    for _ in range(most):
        total, open_ = _progress(edges, of)
        if not open_:
            break
        turned = written(_star(edges, True, total, of), "edges")
        step = written(_star(turned, False, total, of), "edges")
        drop_written(edges, turned)
        edges = step
    else:
        raise RuntimeError(f"components still changed after {most} rounds")
    roots = edges.select(*of, F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    return edges.select(*of, F.col("a").alias("v"), F.col("b").alias("component")).unionAll(roots)
