"""Small fixtures with nulls, empty and long texts, ties and repeated rows, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, cut string, t string, key string"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(seed, n, size=200):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


def changed(text, every):
    return " ".join("other" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


# --- packing ---------------------------------------------------------------------------------


def test_packing_is_whole(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tallywood.llm.packing import pack

    texts = [None, "", "hello world", "<|endoftext|> x", prose(1, 3000), "世界 and é  two", "hello world", *[prose(k, 40 + 7 * k) for k in range(30)]]
    out = [r.asDict() for r in pack(docs(spark, texts), capacity=256, island=10, joined=2).collect()]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, seqs = {}, {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert k == 0 or p["length"] == 256
            at += p["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(r["length"] for r in out)
    assert len(seqs) <= -(-total // 256) + 3
    assert pack(docs(spark, ["x"]).limit(0)).count() == 0


def test_genetic_search_improves_or_keeps():
    from tallywood.llm.packing import best_fit, evolve, fitness

    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 3
    first = best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, [], 61)
    best = evolve(sizes, 61, 1)
    assert fitness(best, sizes, 61) >= fitness(first, sizes, 61)
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 61 for b in best)


# --- near duplicates -------------------------------------------------------------------------


def brute_groups(texts, words, percent):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if x]
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


def test_near_duplicates_against_brute_force(spark):
    from tallywood.llm.neardup import near_duplicates

    base = prose(3, 150)
    texts = [None, "", "  ", "one", "ONE", "one two", "one two", base, base.upper(), "É é", "é é", prose(9, 20_000)]
    texts += [changed(base, k) for k in (20, 30, 40, 60, 80, 100, 130)] + [prose(k, 60) for k in range(20, 40)] + [prose(k, 60) + " tail" for k in range(20, 40)]
    texts += [f"{base} {i}" for i in range(120)]  # one group over several blocks
    sets, root = brute_groups(texts, 3, 85)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts), block=16).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == root
    assert all(got[i].kept == (root[i] == i) for i in got)
    assert near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    from tallywood.llm.neardup import near_duplicates

    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, "a b c d")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in out) == [("2", 2, True), ("5", 2, False), ("5", 2, False), ("None", None, True)]


def test_repeated_id_with_different_texts(spark):
    from tallywood.llm.neardup import near_duplicates

    one, two, three = prose(51, 200), prose(52, 200), prose(53, 200)
    rows = [(1, one), (1, two), (1, three), (2, one + " tail"), (3, two + " tail"), (4, three + " tail"), (5, prose(54, 200)), (9, two), (9, prose(55, 200)), (8, prose(55, 200) + " tail")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in out} == {(k, 5 if k == 5 else 1, k in (1, 5)) for k in (1, 2, 3, 4, 5, 8, 9)} and len(out) == len(rows)


def test_registers_estimate():
    from tallywood.llm.neardup import estimate, registers

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1700], rng.integers(0, 2**63, 300).astype(np.uint64)])
    r = registers([np.unique(a), np.unique(b), np.zeros(0, np.uint64), a[:3]], 128)
    assert abs(estimate(r[:1], r[1:2])[0, 0] - 1700 / 2300) < 0.15
    assert (r[2] == 0xFFFF).all() and len(set(r[3].tolist())) <= 3


# --- substrings ------------------------------------------------------------------------------


def test_substrings_against_brute_force(spark):
    from tallywood.llm.substrings import deduplicate

    shared = prose(5, 50)
    texts = [None, "", "same " * 40, prose(1, 30), f"{prose(2, 60)} {shared} {prose(4, 45)}", f"{prose(6, 10)}\n{shared}\n{prose(7, 80)}", prose(8, 100), prose(8, 100), shared[: len(shared) // 2], prose(11, 9000)]
    want, seen = {}, {}
    words = [(t or "").encode().split() for t in texts]
    for w in words:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    for k, w in enumerate(words):
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        want[k] = (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())
    out = deduplicate(docs(spark, texts)).collect()
    assert {r.doc_id: (r.cut.n_words, r.cut.n_removed, r.cut.kept_sha256) for r in out} == want
    assert all(hashlib.sha256(b" ".join((r.cut.kept_text or "").encode().split())).hexdigest() == want[r.doc_id][2] for r in out)
    assert deduplicate(docs(spark, ["x"]).limit(0)).count() == 0


def test_suffix_automaton(spark):
    import random

    from tallywood.llm.substrings import SuffixAutomaton, remove_reference

    random.seed(2)
    for _ in range(100):
        seqs = [[random.choice("abc") for _ in range(random.randint(0, 10))] for _ in range(3)]
        q = [random.choice("abc") for _ in range(15)]
        subs = {tuple(x[i:j]) for x in seqs for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max([k for k in range(1, i + 2) if tuple(q[i + 1 - k : i + 1]) in subs], default=0) for i in range(len(q))]
        assert SuffixAutomaton(seqs).statistics(q) == want
    ref = prose(1, 60)
    out = {r.doc_id: r for r in remove_reference(docs(spark, [None, f"a {ref} b", "c d"]), [ref]).collect()}
    assert (out[0].n_words, out[1].n_removed, out[1].kept_text, out[2].kept_text) == (0, 60, "a b", "c d")
    with pytest.raises(ValueError):
        remove_reference(docs(spark, ["x"]), ["a b c"], most_words=2)


# --- decontamination -------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark):
    from collections import Counter

    from tallywood.llm.decontaminate import contaminated, decontaminate

    items = [prose(1, 20, 5000), prose(2, 55, 5000), "too few words", None, "of of of of of of of of"]
    sh = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    one = items[1].split()
    texts = [None, "", f"{prose(5, 40)} {items[0].upper()}! {prose(6, 9)}", f"{prose(7, 30)} " + ", ".join(one[:30] + ["new"] + one[31:]), " ".join(one[:20] + ["more"] + one[20:]) + " " + prose(8, 300), items[0][: len(items[0]) // 2], prose(9, 500), items[4] + " x " + items[4], f"{prose(7, 30)} {items[1]}"]
    tok = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if x]
    want = set()
    for d, t in enumerate(texts):
        w = tok(t)
        for k, item in enumerate(items):
            n, s = len(tok(item)), sh(tok(item))
            if n >= 5 and any(sum((sh(w[i : i + n]) & s).values()) >= 0.8 * sum((sh(w[i : i + n]) | s).values()) for i in range(max(1, len(w) - n + 1))):
                want.add((d, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench).collect()} == want
    kept = decontaminate(docs(spark, texts), bench)
    assert kept.columns == docs(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert contaminated(docs(spark, texts), bench.limit(0)).count() == 0


# --- classifiers -----------------------------------------------------------------------------


def test_toxicity(spark):
    from tallywood.llm.toxicity import toxicity

    rng = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(1200):
        w = prose(i, 60).split()
        bad = i % 3 == 0
        if bad:
            w[int(rng.integers(0, 60))] = rng.choice(["horrid", "vile", "horrids", "viley"])
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    texts += [None, "", "horrrid thing", "x " * 5000]
    out = {r.doc_id: r for r in toxicity(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), epochs=25).collect()}
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out.values())
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out for i in held)
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.9
    assert out[1202].score > out[1201].score
    none = toxicity(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, toxic int")).first()
    assert none.predicted == 0


def test_language(spark):
    from tallywood.llm.langid import identify

    make = lambda s, base: " ".join("".join(np.random.default_rng(s * 100 + k).choice(base.split(), 3)) for k in range(80))
    kinds = {"aa": "the an ing er", "bb": "que os ción ra", "cc": "ein sch ung te"}
    texts = [make(i, list(kinds.values())[i % 3]) for i in range(90)] + [None, "", "123 !!", "é"]
    langs = {i: list(kinds)[i % 3] for i in range(90)} | {90: None, 91: None, 92: None, 93: None}
    out = {r.doc_id: r for r in identify(docs(spark, texts, langs)).collect()}
    assert [out[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and out[93].lang_pred in kinds
    held = [i for i in range(90) if out[i].held_out]
    assert held and all(out[i].lang_pred == langs[i] for i in held)
    assert identify(docs(spark, ["abc"], {0: None})).first().lang_pred == "und"


def test_language_of_short_texts_and_equal_shares(spark):
    from tallywood.llm.langid import dictionaries, identify

    make = lambda s, base, n: " ".join("".join(np.random.default_rng(s * 100 + k).choice(base.split(), 3)) for k in range(n))
    kinds = {"aa": ("the an ing er", 80), "bb": ("que os ción ra", 4), "cc": ("ein sch ung te", 6000)}
    texts = [make(i, *list(kinds.values())[i % 3]) for i in range(60)]
    langs = {i: list(kinds)[i % 3] for i in range(60)}
    assert min(map(len, texts[2::3])) > 20_000 and max(map(len, texts[1::3])) < 200
    out = {r.doc_id: r for r in identify(docs(spark, texts, langs)).collect()}
    assert all(out[i].lang_pred == langs[i] for i in range(60) if out[i].held_out)
    words = ["".join(chr(97 + (k * 7 + i) % 26) for i in range(9)) + f"{chr(97 + k)}" for k in range(26)]
    made = dictionaries({"aa": [" ".join(f"{w}{a}{b}" for a in "abcdefgh" for b in "abcdefgh") for w in words]}, 2600)["aa"]
    assert len(made) <= 2600 and all(w.encode() in made for w in words)


# --- licences --------------------------------------------------------------------------------


def test_licenses_against_brute_force(spark):
    from tallywood.llm.licenses import BASE, evaluate, parse, scan

    texts = [None, "", "Released under the MIT License. under-the mit license", "Apache License, Version 2.0 / apache license version 2", "CC BY-NC cc by nc by", "under the mit licenses", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Zlib\nx", "under the MIT License " * 3000]
    out = {r.doc_id: r for r in scan(docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = out[d]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert out[6].allowed and "spdx:zlib" in out[6].labels and out[0].allowed is None
    assert parse("MIT AND (Apache-2.0 OR GPL-2.0 WITH Classpath-exception-2.0)") == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "WITH", "OR", "AND"]
    assert not evaluate(parse("MIT AND GPL-2.0")) and evaluate(parse("GPL-2.0 OR MIT")) and parse("MIT OR") is None and parse("(MIT") is None and parse(")") is None


def test_license_tags_are_read_whole(spark):
    from tallywood.llm.licenses import scan

    long = "SPDX-License-Identifier: " + "MIT AND " * 100 + "GPL-2.0-only\nrest"
    far = "SPDX-License-Identifier" + " " * 30 + ":" + " " * 40 + "MIT"
    two = "SPDX-License-Identifier: MIT " + "x " * 400 + "SPDX-License-Identifier: GPL-2.0-only"
    out = {r.doc_id: r for r in scan(docs(spark, [long, far, two, "SPDX-License-Identifier:\nMIT"])).collect()}
    assert [out[i].allowed for i in range(4)] == [False, True, False, None]
    assert "spdx:gpl-2.0-only" in out[0].labels and "spdx:mit" in out[1].labels and {"spdx:mit", "spdx:gpl-2.0-only"} == set(out[2].labels.split(","))
