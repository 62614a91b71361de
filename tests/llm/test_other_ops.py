import hashlib

import numpy as np


def test_chat_round_trip(spark):
    from tallywood.llm.chat import digests, format_chats, read_back, render

    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (2, 1, "assistant", None), (2, 0, "user", "\\"), (3, 0, "assistant", "x"), (4, 0, None, "y"), (4, 0, "user", "y"), (5, None, "tool", "<|text|>"), (6, 0, "user", "a" * 100_000), (6, 0, "user", "a" * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in digests(format_chats(df)).collect()}
    byid = {}
    for c, turn, role, text in rows:
        byid.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in byid.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [out[c].valid for c in (1, 2, 3, 4, 5, 6)] == [True, True, False, False, False, False]
    rng = np.random.default_rng(1)
    for _ in range(200):
        turns = [(["user", "assistant", "system", "odd<"][rng.integers(0, 4)], "".join(rng.choice(list("<[\\/s>|INST] "), rng.integers(0, 12)))) for _ in range(4)]
        assert read_back("".join(s for s, _ in render(*map(list, zip(*turns)))[0])) == turns
    assert format_chats(df.limit(0)).count() == 0


def test_url_rules_and_templates(spark):
    from tallywood.llm.urls import judge

    urls = [None, "nothing", "http://WWW.Example.ORG/es/1?x#y", "https://a.example.org/en/12", "https://example.org/en/2", "https://b.com/fr/1", "https://b.com/de/1", "https://org", "https://notexample.org/es/", "x://y://z.org/a", "https://q.net/de/5", "https://q.net/fr/5", "https://q.net/de/5"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "https://b.com/de/2", "clash")]
    out = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    get = lambda i: (out[i].host, out[i].path, out[i].rule)
    assert get(0) == ("", "", None) and get(1) == ("", "", None)
    assert get(2) == ("www.example.org", "/es/1", "example.org/es/") and out[2].verdict == "block"
    assert get(3)[2] == "example.org/en/1" and get(4)[2] == "org/" and get(5)[2] == "com/fr/" and get(6)[2] == "com/de/"
    assert get(7) == ("org", "", None) and get(8)[2] == "org/" and get(9) == ("y:", "//z.org/a", None)
    assert out[10].rule is None and out[10].verdict == "block" and out[11].verdict == "allow" and out[None].rule == "com/de/"
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_vectors_against_brute_force(spark):
    from tallywood.llm.vectors import audit, near_vectors

    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:1] + 0.08 * rng.normal(size=(150, 16)), base[5:7], 3 * base[7:8]]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(*o, 0) for o in odd], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in near_vectors(df, shard=32).collect()}
    u = x.astype(np.float64)
    s = (u @ u.T) / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(u, axis=1)[None, :]
    near = s >= 0.9
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(near, comp[None, :], 10**9).min(1))
    links = np.asarray([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum()
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.95
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert audit(df, near_vectors(df, shard=32), every=10) >= 0.9
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_of_spread_out_clusters(spark):
    from tallywood.llm.vectors import kmeans, may_hold, near_vectors, unit

    rng = np.random.default_rng(4)
    base = unit(rng.normal(size=(3000, 32)))
    aside = rng.normal(size=(400, 32))
    aside = unit(aside - (aside * base[:400]).sum(1, keepdims=True) * base[:400])
    x = np.concatenate([base, 0.905 * base[:400] + np.sqrt(1 - 0.905**2) * aside])
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, 0)
    c = kmeans(unit(x), 60)
    home = (unit(x) @ c.T).argmax(1)
    i, j = np.nonzero(s >= 0.9)
    assert may_hold(unit(x) @ c.T, c, home, 0.9)[i, home[j]].all() and (home[i] != home[j]).any()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors(df, shard=96).collect()}
    assert [got[k] for k in range(len(x))] == (s >= 0.9).sum(1).tolist()


def test_vectors_of_many_lengths_and_whole_audit(spark):
    from pyspark.sql import functions as F

    from tallywood.llm.vectors import audit, near_vectors

    df = spark.range(1, 2201).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, (id + 1) div 2), k -> cast(k + id % 2 * k as double))").alias("embedding"))
    got = near_vectors(df, most_centroids=1)
    assert got.filter("n_links <> 1").count() == 0
    few = spark.range(0, 2400).select(F.col("id").alias("vec_id"), F.expr("array(1.0D, id)").alias("embedding"))
    said = few.select("vec_id", F.expr("if(vec_id < 2000, 2399, 0)").cast("long").alias("n_links"))
    assert audit(few, said, threshold=-1.0, every=1) == 2000 / 2400


def test_components(spark):
    from tallywood.llm.components import components

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {v: find(v) for a, b in edges if a != b for v in (a, b)}
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    out = P.run(spark, sf)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    got = out.collect()
    assert got and max(r.offset + r.length for r in got) <= 2048
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_bitmap_filters(spark):
    from tallywood.llm.common import among, without

    df = spark.createDataFrame([(i, "x") for i in range(500)] + [(None, "n")], "id long, v string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "id long")
    near = {r.id for r in among(df, ids, "id", 12).collect()}
    assert set(range(0, 500, 7)) <= near and len(near) < 200
    left = [r.id for r in without(df, ids, "id", 8).collect()]
    assert sorted(x for x in left if x is not None) == [i for i in range(500) if i % 7] and None in left
    assert without(df, ids.limit(0), "id").count() == 501


def test_chat_reader_finds_the_marks_among_escapes():
    import random

    from tallywood.llm.chat import read_back, render

    rng = random.Random(5)
    bits = ["\\", "<", "[", "/", ">", "|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|role|>", "<|text|>", "a", " ", "\n", "é", ""]
    said = lambda n: "".join(rng.choice(bits) for _ in range(n))
    for n in [*range(8)] * 200 + [200_000]:
        turns = [(rng.choice(["system", "user", "assistant", "tool", "<|x", "", "\\"]), said(n)) for _ in range(3)]
        assert read_back("".join(s for s, _ in render(*map(list, zip(*turns)))[0])) == turns
