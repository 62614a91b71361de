import hashlib
import random

import numpy as np
import pyarrow as pa


def _thue_morse(n, flip):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join("ab"[x ^ flip] for x in out[:n])


def test_long_words_that_differ_are_told_apart(spark):
    """Thue-Morse words: a polynomial over their bytes modulo 2**64 is the same for both."""
    from tallywood.llm.neardup import near_duplicates
    from tallywood.llm.substrings import deduplicate

    one, two = _thue_morse(1024, 0), _thue_morse(1024, 1)
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.cut for r in deduplicate(docs).collect()}
    assert [(got[i].n_words, got[i].n_removed) for i in (1, 2)] == [(35, 0), (35, 0)]
    assert got[1].kept_sha256 == hashlib.sha256(f"{one} {rest}".encode()).hexdigest()
    words = [" ".join(f"{_thue_morse(1024, flip)}{k}" for k in range(40)) for flip in (0, 1)]
    near = near_duplicates(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in near) == [(0, 0), (1, 1)]


def test_word_hashes_are_of_the_words(monkeypatch):
    from tallywood.llm import kernels

    rng = random.Random(8)
    texts = [None, "", " \n", "x" * 5000] + ["".join(rng.choice("aBé \t\n") for _ in range(rng.randrange(80))) for _ in range(200)]
    known = set()
    for size in (1 << 20, 50):
        monkeypatch.setattr(kernels, "CHUNK", size)
        data, offsets = kernels.string_buffers(pa.array(texts))
        starts, ends, first = kernels.word_spans(data, offsets)
        words = [w for t in texts for w in (t or "").encode().split()]
        for lower in (False, True):
            own = [w.lower() if lower else w for w in words]
            got = kernels.word_hashes(data, starts, ends, lower).tolist()
            assert len(set(zip(own, got))) == len(set(own)) == len(set(got))
            known |= dict(zip(own, got)).items()
        rough = kernels.rough_hashes(data, starts, ends).tolist()
        assert len(set(zip(words, rough))) == len(set(words))
        joined, at = kernels.joined_words(data, starts, ends)
        assert joined.tobytes() == b"".join(w + b" " for w in words) and at.tolist()[-1] == len(joined)
    assert len({w for w, _ in known}) == len(known)  # in every batch the same
    h = np.arange(1, 50, dtype=np.uint64)
    whole = kernels.shingle_hashes(h, 5, 1)
    assert len(whole) == 45 and len(set(whole.tolist())) == 45 and whole[7] == kernels.shingle_hashes(h[7:12], 5, 1)[0]


def test_shingles_found_by_hash_are_confirmed_on_words(spark, monkeypatch):
    from tallywood.llm import neardup

    assert neardup.worded("A b\tC d", 3) == {b"a b c", b"b c d"} and neardup.worded("A b", 3) == {b"a b"} and neardup.worded(" \n", 3) == set()
    calls = []
    sets = [np.arange(100, dtype=np.uint64)] * 3
    got = neardup.links_within(sets, sets, 85, np.ones((3, 3), bool), True, lambda i, j: calls.append((i, j)) or (i, j) == (1, 2))
    assert got == [(1, 2)] and calls == [(0, 1), (0, 2), (1, 2)]


def test_near_duplicates_exactly_at_the_threshold(spark):
    """17 of 20 shingles are shared: 85 %; 16 of 21 are not enough."""
    from tallywood.llm.neardup import near_duplicates

    base = [f"w{k}" for k in range(20)]  # 18 shingles of three words
    longer = [*base[:19], "y", "z"]  # 17 of base's 18 and two more: 17 of 20
    below = [*base[:18], "p", "q", "r"]  # 16 of 18 and three more: 16 of 21
    docs = [(1, " ".join(base)), (2, " ".join(longer)), (3, " ".join(f"u{k}" for k in range(30))), (5, " ".join(below).replace("w0 ", "W0\t"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (18, 1), 2: (19, 1), 3: (28, 3), 5: (19, 5)}


def test_whole_texts_speak_in_language_id(spark):
    from tallywood.llm.langid import identify

    rng = random.Random(9)
    said = {"fr": "le chat mange la souris dans une grande maison avec des amis et il est tard pour nous".split(), "en": "the cat eats a mouse inside some big house with several friends and it is late for us".split()}
    rows = [(k, " ".join(rng.choice(said[lang]) for _ in range(120)), lang) for k, lang in enumerate(["fr", "en"] * 60)]
    rows += [(1000, "le chat mange la souris dans une grande maison " * 300 + " ".join(said["en"]), None), (None, None, None), (1001, "123 !", None), (1002, "", "fr")]
    rows += [(1003, rows[0][1], "fr")] * 400  # one id and text many times can't fill the sample
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20, size=20_000).collect() if r.doc_id is None or r.doc_id >= 1000}
    assert got[1000].lang_pred == "fr" and got[None].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und"
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
