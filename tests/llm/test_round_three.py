import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest


@pytest.fixture(scope="module")
def proto():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _library(path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(sp.encode(t))


def test_token_counts_of_odd_texts(spark, proto):
    from tallywood.llm.tokens import count_tokens

    count = _library(proto)
    texts = [None, "", " ", "   ", "a", "a  b\n\tc", "<s> x </s> <unk> <0x0A>", "▁▁x ▁", "é é 梦 　", "👩‍👩‍👧\x00\U0010ffff", "word " * 5000, "x" * 3000, " " * 700, "zq9" * 400, "the the the", "the the the"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(None, "no id", "clash"), (3, "   ", "clash")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), proto).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()), count(t or "")) for i, t, _ in rows)
    assert {r.over_limit for r in got if r.n_tokens > 4096} == {True} and {r.over_limit for r in got if r.n_tokens <= 4096} == {False}
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), proto).count() == 0


def test_merges_like_the_library_in_any_block(proto, monkeypatch):
    from tallywood.llm import tokens

    count = _library(proto)
    with open(proto, "rb") as f:
        model = tokens.PieceModel(f.read())
    rng = random.Random(3)
    alphabets = ["ab ", "▁ ", "aAé梦́ 👩\n\t", "abcdefghijklmnopqrstuvwxyz", "theinga ", "0123456789.,;-"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 2, 7, 40, 400]))) for _ in range(1500)]
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 255, 256, 257, 900)]
    want = [count(t) for t in texts]
    assert model.count(texts).tolist() == want
    monkeypatch.setattr(tokens, "BLOCK", 64)
    assert model.count(texts).tolist() == want
    monkeypatch.setattr(tokens, "LONG", 3)
    assert model.count(texts).tolist() == want


def test_token_counts_of_the_table(spark, proto):
    from tallywood.llm.tokens import op11_token_counts

    count = _library(proto)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: (len((d.text or "").encode()), count(d.text or ""), count(d.text or "") > 4096) for d in docs}


def _brute_audit(docs, labels):
    import re

    smallest = {}
    for i, _, t in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    says = lambda i, k: i is not None and any(r[0] == i and r[k] == 1 for r in labels)
    parts = {}
    for i, source, t in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > smallest[t])) if bad}
        parts.setdefault(source or "", []).append((fails, says(i, 1), says(i, 2)))
    out = {}
    for part, rows in parts.items():
        share = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                earlier = [r for r in rows if c in r[0] and r not in left]
                left = [r for r in left if c not in r[0]]
                share[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(earlier), sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), c]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = share[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark):
    from tallywood.llm.filters import audit

    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "Gamma", "DELTA", "e#", "é", "x|y"]
    texts = [None, "", "\x0b \t", " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(199)), " ".join(f"w{k % 100}" for k in range(200)), " ".join(f"w{k % 99}" for k in range(200)), "A" * 2 + "b" * 98, "A" * 3 + "b" * 97, " ".join(["a"] * 300)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 150, 400]))) for _ in range(20)]
    docs = [(k, rng.choice([None, "", "web", "code"]), rng.choice(texts)) for k in range(150)] + [(k, "hot", texts[3]) for k in range(300, 500)]
    docs += [(None, "web", texts[3]), (None, None, None), docs[0], docs[0], (7, "web", texts[3]), (7, "web", texts[3]), (301, "hot", texts[3])]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, source string, text string, fingerprint string, near int").repartition(5)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = _brute_audit(docs, labels)
    assert len(want) == 600 * 4 and got == want
    assert audit(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    empty = audit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 2400 and empty.filter("good_lost + toxic_lost > 0").count() == 0


def test_chains_keep_texts_of_one_fingerprint_apart():
    from tallywood.llm.filters import _settle

    records = [(5, ("one", 4, {("p", 0): 1})), (5, ("two", 2, {("p", 1): 1})), (5, ("one", 3, {("q", 0): 2})), (5, ("two", 9, {("p", 1): 1})), (5, ("one", 3, {("q", 0): 1})), (1, (8, "p", 2, 1))]
    assert sorted(_settle(iter(records))) == sorted([(4, "p", 16, 1), (3, "q", 0, 3), (2, "p", 1, 1), (9, "p", 17, 1), (8, "p", 2, 1)])


def test_words_in_blocks(monkeypatch):
    from tallywood.llm import filters

    rng = random.Random(5)
    monkeypatch.setattr(filters, "CHUNK", 7)
    for _ in range(300):
        data = "".join(rng.choice("ab \n\x0bé") for _ in range(rng.randrange(0, 60))).encode()
        assert list(filters.words_of(data)) == data.split()


def _brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    books = [[list(cut(v)[p]) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            at = [best(cut(v)[p], p)[1] for _, v, _ in kept]
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), a in zip(kept, at) if a == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out, by_label = [], Counter()
    for i, v, label in kept:
        pairs = [best(x, p) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in pairs), sum(d for d, _ in pairs), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=repr)


def _codes(df):
    from tallywood.llm.codes import compress

    return sorted((tuple(r) for r in compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_vector_codes_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 24)).astype(np.float32).round(1)
    rows = [(int(i), [float(c) for c in v], [None, 1, 2][i % 3]) for i, v in enumerate(x)]
    rows += [(1000 + k, rows[5][1], 1) for k in range(200)] + [rows[9], rows[9], (None, rows[3][1], None), (2000, None, 1), (2001, [None] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [float("-inf")] + [0.0] * 23, 1), (2004, [-0.0] * 24, 2)]
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<float>, label int, part string, row int").repartition(3)
    assert _codes(frame) == _brute_codes(rows)
    few = rows[:5]
    assert _codes(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")) == _brute_codes(few)
    assert _codes(frame.limit(0)) == []


def test_vector_codes_of_odd_sizes(spark):
    wide = [(1, [1e30, -3e38] * 8, 1), (2, [0.5] * 16, 1), (3, [1e9] * 16, None)]
    got = _codes(spark.createDataFrame(wide + [(4, [1.0], 1), (5, [], 1)], "vec_id long, embedding array<float>, label int"))
    assert [(r[0], r[1], r[2]) for r in got] == [(1, "00" * 8, 0), (2, "01" * 8, 0), (3, "02" * 8, 0), (4, None, None), (5, None, None)]
    assert [r[3] for r in got] == [0] * 5
    uneven = [(k, [float(k), 1.0, 2.0], 1) for k in range(20)]
    assert len(_codes(spark.createDataFrame(uneven, "vec_id long, embedding array<float>, label int"))) == 20


def test_nearest_takes_the_lower_of_equals_at_any_size():
    from tallywood.llm.codes import nearest

    for scale in (1, 2**24, 2**40):
        book = np.asarray([[2], [0], [2], [4]], dtype=np.int64) * scale
        at, far = nearest(np.asarray([[1], [3], [2], [-5]], dtype=np.int64) * scale, book)
        assert at.tolist() == [0, 0, 0, 1] and [int(d) for d in far] == [scale**2, scale**2, 0, 25 * scale**2]


def test_rounds_with_sql_over_whole_tables(spark):
    import duckdb

    from tallywood.llm.registry import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op12_filter_audit", "op13_vector_codes"):
        got = queries()[name](spark, sf)
        want = con.sql(oracle_sql()[name])
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
