"""Embedding near-duplicates on a robust-pruned flat graph over overlapping shards.

1. equal vectors collapse to a class (a number, its least vec_id, number of copies);
2. centroids come from k-means on a bounded sample; each class is at home in the nearest
   centroid's shard and a member of the next `overlap` ones too.  A cluster with more
   than `shard` classes is split by hash, and its vectors are searched in every part;
   a dense group may have many centroids: all within cosine `reach` are searched;
3. in each shard the members' nearest neighbours are robust-pruned (a candidate goes if a
   chosen neighbour is `alpha` times nearer to it) and lists are united with their
   reverses.  Vectors are in several shards' lists; the union is searched shard by shard;
4. each vector is searched in its shards by a best-first walk from itself (where it is a
   member), the shard's medoid and spread entries; then the range expands: neighbours of
   all within `threshold - margin` are visited until none is new;
5. a pair counts if its cosine in double precision is at least the threshold (verified on
   the stored components), once, in the shard where the found vector is at home.  A
   spanning forest of the pairs leaves the task; components are brought to every vector;
6. the other clusters that may be home of a vector within the threshold (`may_hold`, a
   bound, not an estimate) are visited too, and all their vectors are scored.  For that
   clusters are packed in buckets; a vector goes once to each bucket it has to visit.
   Spread-out vectors exclude few clusters, so their visits grow with the table's square.

`audit` measures recall against brute force for a set of queries, in blocks.

Null or zero vectors and those with null or non-finite components link with nothing, as
do vectors of other lengths with each other; a null vec_id has no links, component null
and is kept.  Repeated rows are one vector; rows that repeat a vec_id with other vectors
are one vertex, with the largest of their numbers of links.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import drop_written, join_hot, shuffle_partitions, table, written
from tallywood.llm.components import components


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): the components as double bytes of each vector that can link."""

    def run(batches):
        for batch in batches:
            ids, dims, out = [], [], []
            for vec_id, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not one.is_valid or one.values.null_count or not len(one.values):
                    continue
                x = one.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(vec_id)
                    dims.append(len(x))
                    out.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, dim int, v binary")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int, reach: float) -> list[int]:
    """The n nearest centroids of a unit vector, then all others with at least that cosine."""
    s = c @ x
    order = np.argsort(-s, kind="stable")
    return order[: max(min(n, len(c)), int((s >= reach).sum()))].tolist()


def may_hold(s: np.ndarray, c: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """Which clusters may be home of a vector within the threshold; s are unit vectors' cosines to the centroids c, own their homes.

    A vector y at home in j is no nearer to centroid `own` than to j, so y has an angle of
    90 degrees at most to c[j] - c[own]; x, within the threshold's angle a of y, has 90 + a
    at most: s[own] - s[j] <= sin(a) * |c[j] - c[own]|.
    """
    if threshold <= 0:
        return np.ones(s.shape, dtype=bool)
    gap = np.sqrt(np.maximum(0, (c**2).sum(1)[own][:, None] + (c**2).sum(1) - 2 * (c @ c.T)[own]))
    return s[np.arange(len(s)), own][:, None] - s <= np.sqrt(max(0.0, 1 - threshold**2)) * gap + 1e-7


def packed(counts: list[int], most: int) -> list[tuple[int, int]]:
    """(first bucket, buckets) of each cluster: small ones share a bucket of `most` vectors, larger ones are split over several."""
    out, at, room = [], -1, 0
    for n in counts:
        if n > most:
            out.append((at + 1, -(-n // most)))
            at, room = at + out[-1][1], 0
        else:
            if n > room:
                at, room = at + 1, most
            room -= n
            out.append((max(at, 0), 1))
    return out


def build(x: np.ndarray, degree: int = 14, pool: int = 48, alpha: float = 1.2) -> np.ndarray:
    """Adjacency matrix of unit vectors: robust-pruned nearest neighbours, united with their reverses."""
    m = len(x)
    graph = np.zeros((m, m), dtype=bool)
    if m < 2:
        return graph
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    c = min(pool, m - 1)
    cand = np.argpartition(-sim, c - 1, axis=1)[:, :c]
    dist = 1 - np.take_along_axis(sim, cand, 1)
    alive = np.ones(cand.shape, dtype=bool)
    rows = np.arange(m)
    for _ in range(degree):
        pick = np.where(alive, dist, np.inf).argmin(1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        p = cand[rows, pick]
        graph[rows[ok], p[ok]] = True
        alive &= (alpha * (1 - sim[p[:, None], cand]) > dist) & ok[:, None]
        alive[rows, pick] = False
    return graph | graph.T


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, low: float, entries: np.ndarray, steps: int = 24):
    """(query, member) pairs visited with cosine >= low: a best-first walk, then range expansion."""
    m, q = len(x), len(queries)
    seen = np.zeros((q, m), dtype=bool)
    score = np.full((q, m), -2.0)
    edges = graph.astype(np.float32)

    def visit(mask):
        """Scores the marked pairs that weren't seen."""
        rows, nodes = np.nonzero(mask & ~seen)
        for lo in range(0, len(rows), 16_384):
            r, k = rows[lo : lo + 16_384], nodes[lo : lo + 16_384]
            score[r, k] = np.einsum("ij,ij->i", queries[r], x[k])
        seen[rows, nodes] = True
        return rows, nodes

    start = np.zeros((q, m), dtype=bool)
    start[:, entries] = True
    inside = np.flatnonzero(own >= 0)
    start[inside, own[inside]] = True
    visit(start)
    done = np.zeros((q, m), dtype=bool)
    live = np.arange(q)
    for _ in range(steps):
        open_ = np.where(done[live], -3.0, score[live])
        best = open_.argmax(1)
        go = open_[np.arange(len(live)), best] > -2
        live, best = live[go], best[go]
        if not len(live):
            break
        before = score[live].max(1)
        done[live, best] = True
        mask = np.zeros((q, m), dtype=bool)
        mask[live] = graph[best]
        visit(mask)
        live = live[(score[live].max(1) > before) | (done[live].sum(1) < 8)]
    front = score >= low
    while front.any():
        rows, nodes = visit(front.astype(np.float32) @ edges > 0)
        near = score[rows, nodes] >= low
        front = np.zeros((q, m), dtype=bool)
        front[rows[near], nodes[near]] = True
    return np.nonzero(score >= low)


class Shard:
    """Graph of one shard's members; links of batches of queries, with a union-find over the members."""

    def __init__(self, rows: list[dict], threshold: float, margin: float):
        self.threshold, self.low = threshold, threshold - margin
        self.ids, self.x, self.norm, self.unit = self._arrays(rows)
        self.home = np.asarray([r["role"] == 0 for r in rows], dtype=bool)
        self.weight = np.asarray([r["weight"] for r in rows], dtype=np.int64)
        self.parent = list(range(len(rows)))
        m = len(rows)
        if m:
            self.graph = build(self.unit)
            medoid = int((self.unit @ self.unit.sum(0)).argmax())
            self.entries = np.unique(np.append(np.linspace(0, m - 1, min(m, 24)).astype(np.int64), medoid))

    @staticmethod
    def _arrays(rows):
        x = np.stack([np.frombuffer(r["v"]) for r in rows]) if rows else np.zeros((0, 1))
        norm = np.linalg.norm(x, axis=1)
        return np.asarray([r["vec_id"] for r in rows], dtype=np.int64), x, norm, x / np.maximum(norm, 1e-300)[:, None]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self, rows: list[dict], first: int | None) -> list[dict]:
        """Link counts of a batch of queries and, for each, one member it links with; `first` is their place among the members."""
        if not len(self.ids):
            return []
        ids, x, norm, u = self._arrays(rows)
        own = np.arange(first, first + len(rows)) if first is not None else np.full(len(rows), -1)
        a, b = search(self.unit, self.graph, u, own, self.low, self.entries)
        exact = np.empty(len(a), dtype=bool)
        for lo in range(0, len(a), 16_384):
            k = slice(lo, lo + 16_384)
            exact[k] = np.einsum("ij,ij->i", x[a[k]], self.x[b[k]]) / (norm[a[k]] * self.norm[b[k]]) >= self.threshold
        keep = exact & self.home[b] & (ids[a] != self.ids[b])
        return self.counted(ids, a[keep], b[keep])

    def counted(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[dict]:
        """Links of queries a with members b."""
        counts = np.bincount(a, self.weight[b], len(ids)).astype(np.int64)
        out, at = [], {}
        for i, j in zip(a.tolist(), b.tolist()):
            if i in at:
                self.parent[self.root(j)] = self.root(at[i])
            else:
                at[i] = j
        for i, j in at.items():
            out.append({"a": int(ids[i]), "b": int(self.ids[j]), "n": int(counts[i])})
        return out

    def forest(self) -> list[dict]:
        return [{"a": int(self.ids[i]), "b": int(self.ids[self.root(i)]), "n": 0} for i in range(len(self.ids)) if self.root(i) != i]


def _shard_search(threshold: float, margin: float, batch_rows: int = 256):
    """Rows of one shard come sorted, members (role 0 at home, 1 overlap) before visitors (2), who pass in batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        shard, held, key = None, [], None

        def settle(last: bool) -> list[dict]:
            """Makes the shard of the held members, or searches the held visitors."""
            nonlocal shard, held
            out = []
            if shard is None:
                shard = Shard(held, threshold, margin)
                for lo in range(0, len(held), batch_rows):
                    out += shard.links(held[lo : lo + batch_rows], lo)
            elif held:
                out += shard.links(held, None)
            held = []
            return out + (shard.forest() if last else [])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = (r["dim"], r["home"], r["part"])
                if k != key:
                    if key is not None:
                        out += settle(False) if shard is None and held else []
                        out += settle(True) if shard is not None else []
                    shard, held, key = None, [], k
                if r["role"] == 2 and shard is None:
                    out += settle(False)
                held.append(r)
                if shard is not None and len(held) >= batch_rows:
                    out += settle(False)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            out = settle(False) if shard is None else []
            yield pa.RecordBatch.from_pylist(out + settle(True), schema)

    return run


class Bucket(Shard):
    """Vectors at home in one or more clusters; visitors are scored against all of the clusters they have to visit."""

    def __init__(self, rows: list[dict], centroids: np.ndarray, threshold: float):
        rows = sorted(rows, key=lambda r: r["near"][0])
        self.threshold, self.centroids = threshold, centroids
        self.ids, self.x, self.norm, self.unit = self._arrays(rows)
        self.weight = np.asarray([r["weight"] for r in rows], dtype=np.int64)
        self.parent = list(range(len(rows)))
        self.clusters, first = np.unique([r["near"][0] for r in rows], return_index=True)
        self.bounds = np.append(first, len(rows))

    def visits(self, rows: list[dict]) -> list[dict]:
        """Link counts of a batch of visitors with the members whose cluster isn't in their `near`; those are searched elsewhere."""
        ids, x, norm, u = self._arrays(rows)
        own = np.asarray([r["near"][0] for r in rows])
        need = may_hold(u @ self.centroids.T, self.centroids, own, self.threshold)
        need[np.repeat(np.arange(len(rows)), [len(r["near"]) for r in rows]), np.concatenate([r["near"] for r in rows])] = False
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, lo, hi in zip(self.clusters, self.bounds[:-1], self.bounds[1:]):
            here = np.flatnonzero(need[:, k])
            for at in range(lo, hi if len(here) else lo, 4096):
                i, j = np.nonzero(u[here] @ self.unit[at : min(hi, at + 4096)].T >= self.threshold - 1e-9)
                i, j = here[i], j + at
                exact = np.einsum("ij,ij->i", x[i], self.x[j]) / (norm[i] * self.norm[j]) >= self.threshold
                keep = exact & (ids[i] != self.ids[j])
                a.append(i[keep])
                b.append(j[keep])
        return self.counted(ids, np.concatenate(a), np.concatenate(b))


def _bucket_search(threshold: float, held, batch_rows: int = 512):
    """Rows of one bucket and slice come sorted, members (role 0) before visitors (1), who pass in batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        bucket, rows, key = None, [], None

        def settle(last: bool) -> list[dict]:
            """Makes the bucket of the rows, or lets them visit it."""
            nonlocal bucket, rows
            out = []
            if bucket is None:
                bucket = Bucket(rows, held.value[key[0]], threshold)
            elif rows:
                out = bucket.visits(rows)
            rows = []
            return out + (bucket.forest() if last else [])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = (r["dim"], r["bucket"], r["slice"])
                if k != key:
                    out += settle(True) if key is not None else []
                    bucket, key = None, k
                if bucket is None and r["role"] == 1:
                    settle(False)
                rows.append(r)
                if bucket is not None and len(rows) >= batch_rows:
                    out += settle(False)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist(settle(True), schema)

    return run


def far_links(placed: DataFrame, counts: dict[int, int], held, threshold: float, shard: int, values: int = 1 << 20) -> DataFrame:
    """Links with vectors at home in a cluster that isn't in `near` but may hold one within the threshold.

    A bucket has at most `values` vector components (a quarter of a small table), and its
    visitors come in slices of about as many, each with its own copy of the bucket.
    """
    spark = placed.sparkSession
    most = {d: min(max(1, values // d), max(shard, -(-n // 4))) for d, n in counts.items()}
    at_home = {(r.dim, r.home): r["count"] for r in placed.filter(F.col("dim").isin(list(counts))).groupBy("dim", F.expr("near[0]").alias("home")).count().collect()}  # a row for each centroid at most
    plan = spark.sparkContext.broadcast({d: packed([at_home.get((d, h), 0) for h in range(len(c))], most[d]) for d, c in held.value.items()})

    def routes(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["own"], r["to"] = -1, []
            for d, slots in plan.value.items():
                same = [r for r in rows if r["dim"] == d]
                c = held.value[d]
                for lo in range(0, len(same), 512):
                    part = same[lo : lo + 512]
                    near = [r["near"] for r in part]
                    own = np.asarray([k[0] for k in near])
                    need = may_hold(unit(np.stack([np.frombuffer(r["v"]) for r in part])) @ c.T, c, own, threshold)
                    for r, k, line in zip(part, near, need):
                        line[k] = False
                        first, n = slots[k[0]]
                        r["own"] = first + zlib.crc32(r["v"]) % n
                        r["to"] = sorted({b for h in np.flatnonzero(line) if at_home.get((d, h)) for b in range(slots[h][0], sum(slots[h]))})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("v", pa.binary()), ("vec_id", pa.int64()), ("weight", pa.int64()), ("near", pa.list_(pa.int32())), ("own", pa.int32()), ("to", pa.list_(pa.int32()))]))

    routed = written(placed.mapInArrow(routes, "dim int, v binary, vec_id long, weight long, near array<int>, own int, to array<int>"), "routed")
    sliced = F.create_map(*[x for d, n in most.items() for x in (F.lit(d), F.lit(n))])
    slices = routed.select("dim", F.explode("to").alias("bucket")).groupBy("dim", "bucket").count().withColumn("slices", F.expr("count") / sliced[F.col("dim")])
    slices = slices.select("dim", "bucket", F.ceil("slices").cast("int").alias("slices"))
    row = ["dim", "bucket", "slice", "role", "vec_id", "weight", "near", "v"]
    members = routed.withColumnRenamed("own", "bucket").join(slices, ["dim", "bucket"]).withColumn("role", F.lit(0)).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).select(*row)
    visitors = routed.withColumn("bucket", F.explode("to")).join(slices, ["dim", "bucket"]).withColumn("role", F.lit(1)).withColumn("slice", F.expr("cast(pmod(xxhash64(vec_id), slices) as int)")).select(*row)
    dealt = members.unionByName(visitors).repartition(shuffle_partitions(spark), "dim", "bucket", "slice").sortWithinPartitions("dim", "bucket", "slice", "role", "vec_id")
    return dealt.mapInArrow(_bucket_search(threshold, held), "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, margin: float = 0.1, shard: int = 384, sample: int = 6000, most_centroids: int = 512, overlap: int = 2, reach: float = 0.65) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    good = written(usable(vectors), "vectors")
    named = good.groupBy("dim", "v").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("weight"), F.count("*").alias("n"))
    named = written(named.withColumn("vec_id", F.monotonically_increasing_id()), "classes")  # a class has a number of its own, for rows may repeat a vec_id
    classes = named.select("dim", "v", "vec_id", "weight")
    total = classes.count()
    dims = {r.dim: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(8).collect()}
    centroids = {}
    for d in dims:  # 8 lengths at most have centroids; other lengths are one cluster each, split by hash
        rows = classes.filter(F.col("dim") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
        x = unit(np.stack([np.frombuffer(r.v) for r in rows]))
        centroids[d] = kmeans(x, int(min(most_centroids, len(x), max(1, total // (shard // 3)))))
    held = spark.sparkContext.broadcast(centroids)  # 8 * most_centroids vectors at most

    def homes(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                c = held.value.get(r["dim"])
                r["near"] = [0] if c is None else nearest(unit(np.frombuffer(r["v"])[None])[0], c, 1 + overlap, reach)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("v", pa.binary()), ("vec_id", pa.int64()), ("weight", pa.int64()), ("near", pa.list_(pa.int32()))]))

    placed = written(classes.mapInArrow(homes, "dim int, v binary, vec_id long, weight long, near array<int>"), "placed")
    sizes = placed.groupBy("dim", F.expr("near[0]").alias("home")).agg(F.expr(f"cast((count(*) + {shard - 1}) div {shard} as int)").alias("parts"))
    spread = placed.select("dim", "v", "vec_id", "weight", F.posexplode("near").alias("rank", "home")).join(sizes, ["dim", "home"])
    spread = spread.select("dim", "v", "vec_id", "weight", "rank", "home", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)").alias("own"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    role = F.when((F.col("part") != F.col("own")) | (F.col("rank") > overlap), 2).when(F.col("rank") == 0, 0).otherwise(1)
    dealt = spread.select("dim", "home", "part", role.alias("role"), "vec_id", "weight", "v").repartition(shuffle_partitions(spark), "dim", "home", "part").sortWithinPartitions("dim", "home", "part", "role", "vec_id")
    found = dealt.mapInArrow(_shard_search(threshold, margin), "a long, b long, n long")
    if dims:
        found = found.unionByName(far_links(placed, dims, held, threshold, shard))
    found = written(found, "links")
    members = written(join_hot(good, named.withColumnRenamed("vec_id", "class"), ["dim", "v"], ["vec_id"]).select("vec_id", "class").distinct(), "members")
    drop_written(good, placed)
    low = members.groupBy("vec_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("vec_id", "low")
    several = members.join(low, "vec_id").select(F.col("class").alias("a"), F.col("low").alias("b"))
    linked = components(found.select("a", "b").unionByName(several))
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    each = named.select(F.col("vec_id").alias("class"), "least", "weight").join(linked.withColumnRenamed("v", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = each.groupBy("component").agg(F.min("least").alias("c"), F.count("*").alias("n"))
    each = join_hot(each, least, ["component"], ["class"]).join(counts, "class", "left")
    each = each.select("class", "c", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n"))
    each = join_hot(members, each, ["class"], ["vec_id"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("c").alias("c"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(each, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = 0.9, every: int = 20) -> float:
    """Recall of n_links: for the vectors whose id is divisible by `every`, against all vectors, in blocks of about 2,000 queries."""
    good = usable(vectors)
    chosen = good.filter(F.col("vec_id") % every == 0)
    blocks = -(-chosen.count() // 2000)
    hit = true = 0
    for block in range(blocks):
        a, b = _audited(good, chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block), result, threshold)
        hit, true = hit + a, true + b
    return hit / true if true else 1.0


def _audited(good: DataFrame, chosen: DataFrame, result: DataFrame, threshold: float) -> tuple[int, int]:
    """Links found, and links there are, of the chosen vectors."""
    chosen = chosen.collect()
    ids = [r.vec_id for r in chosen]
    by = {d: (np.asarray([r.vec_id for r in chosen if r.dim == d]), unit(np.stack([np.frombuffer(r.v) for r in chosen if r.dim == d]))) for d in {r.dim for r in chosen}}
    held = good.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for d, (own, x) in held.value.items():
                same = [r for r in rows if r["dim"] == d]
                if same:
                    y = unit(np.stack([np.frombuffer(r["v"]) for r in same]))
                    i, j = np.nonzero(x @ y.T >= threshold)
                    other = np.asarray([r["vec_id"] for r in same])
                    n = np.bincount(i[own[i] != other[j]], minlength=len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], names=["vec_id", "n"])

    true = {r.vec_id: r.n for r in good.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    got = {r.vec_id: r.n_links for r in result.filter(F.col("vec_id").isin(ids)).select("vec_id", "n_links").collect()}
    return sum(min(got.get(k, 0), n) for k, n in true.items()), sum(true.values())


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
