"""Trees of url templates, fingerprints of windows, components and repeated ids against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywood.llm import decontaminate, urls, vectors
from tallywood.llm.components import components


def test_tree_of_any_depth(spark):
    slugs = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(120)]
    rows = [(i, f"http://a.net/x/y/blog/{s}/view") for i, s in enumerate(slugs)]
    rows += [(1000 + i, f"http://a.net/x/y/{w}/{c}") for i, (w, c) in enumerate((w, c) for w in ("news", "wiki") for c in "abcdefgh")]
    labels = [(i, True) for i in range(60)] + [(1000 + i, False) for i in range(16)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "page_id long, blocked boolean")).collect()}
    assert {got[i].template for i in range(120)} == {"/x/y/blog/*/view"}  # slugs far below the root are a wildcard
    assert {got[1000 + i].template.split("/")[3] for i in range(16)} == {"~news"}  # alike siblings are one branch
    assert {got[i].verdict for i in range(60, 120)} == {"block"}  # so new slugs of a blocked branch are blocked
    assert {got[1000 + i].verdict for i in range(16)} == {"allow"}


def test_urls_without_labels_nulls_repeats_and_long_paths(spark):
    long = "http://z/" + "s/" * 2000
    rows = [(1, None), (1, None), (None, "no scheme"), (2, long + "a"), (3, long + "b"), (4, "http://z"), (5, "http://z/"), (6, "http://Z//s?q")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("other"))
    got = urls.judge(pages, rules=()).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} == {"allow"} and {r.purity for r in got} == {0.0}
    assert {r.host for r in got} == {"", "z"}
    assert sorted(len(r.path) for r in got if r.page_id in (2, 3)) == [4002, 4002]
    assert urls.judge(pages.limit(0)).count() == 0


def test_ties_of_rates_are_one_branch(spark):
    rows = [(i, f"http://t/{w}/k") for i, w in enumerate("abcd" * 5)]
    labels = [(i, i % 4 < 2) for i in range(20)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "page_id long, blocked boolean")).collect()
    assert {r.template for r in got} == {"/~a/k", "/~c/k"}
    assert all((r.verdict == "block") == (r.page_id % 4 < 2) for r in got)


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items, similarity=0.8):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for k, item in items:
            v = (item or "").lower().split()
            if len(v) < 5 or len(w) < 5:
                continue
            b = shingles(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = shingles(w[s : s + len(v)])
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= similarity:
                    out[d, k] = max(out.get((d, k), 0), sim)
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(rng.choice((30, 60, 61))))) for k in range(12)] + [(90, "a b a b a b a b a b a b a b"), (91, None), (92, "too short")]
    docs = []
    for d in range(120):
        own = items[d % 13][1].split()
        for _ in range(d % 5):
            at = rng.randrange(len(own))
            own[at : at + rng.choice((0, 1))] = [word()]
        docs.append((d, " ".join([word() for _ in range(rng.randrange(0, 40))] + own + [word() for _ in range(rng.randrange(0, 40))])))
    return docs + [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (503, " ".join(items[1][1].split()[:-3]))], items


def test_windows_found_against_brute_force(spark, leaks):
    docs, items = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("own"))
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, i).collect()}
    assert got.keys() <= want.keys() and len(got) >= 0.97 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 or got[k] < want[k] for k in got)
    every = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, i, probing=False).collect()}
    assert every == got  # the bound on probes leaves out nothing that passes
    kept = decontaminate.decontaminate(d, i)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in {a for a, _ in got})


def test_components_of_chains_hubs_and_two_graphs(spark):
    chain, hub = [(i, i + 1) for i in range(40)], [(1000, i) for i in range(1001, 1400)] + [(1200, 2000), (2000, 1), (7, 7)]
    got = {(r.g, r.v): r.component for r in components(spark.createDataFrame([("c", *e) for e in chain] + [("h", *e) for e in hub], "g string, a long, b long"), graph="g").collect()}
    assert {got["c", v] for v in range(41)} == {0} and {c for (g, _), c in got.items() if g == "h"} == {1} and ("h", 7) not in got


def test_vectors_with_repeated_ids_nulls_and_a_hot_copy(spark):
    e = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(1, e[0]), (1, e[0]), (2, e[1]), (3, e[2]), (3, e[3]), (4, e[3]), (5, None), (6, [0.0, 0.0, 0.0]), (None, e[0])] + [(100 + k, [0.0, 2.0, 0.01]) for k in range(50)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert (got[1].n_links, got[2].n_links, got[1].component_id, got[2].component_id) == (1, 1, 1, 1)
    assert (got[4].n_links, got[4].component_id, got[100].component_id) == (1, 3, 3)  # 3 has both vectors
    assert {got[100 + k].n_links for k in range(50)} == {50} and got[3].n_links == 50
    assert got[5].n_links == got[6].n_links == 0 and got[None].kept and got[None].component_id is None
