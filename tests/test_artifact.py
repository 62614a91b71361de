"""The review's file: written by executors, whole or not at all."""

import json
import os

import pytest

from tallywood.operators import artifact, topics

KIND = "pos long, evidence_ref string, source string, session string, evidence array<string>, clean boolean, primary_topic string"


def rows(spark, n, clean=True):
    return spark.createDataFrame([(k, topics.reference("n", k), "codex", "s", ['say "é" \\', "x"] if k % 2 else [], clean or k != n, None) for k in range(n, 0, -1)], KIND).repartition(7)


def test_written_in_order(spark, tmp_path):
    at = str(tmp_path / "review.json")
    for n in (1, 2500, 0):  # a file of that name gives way
        artifact.write_review(rows(spark, n), at, {"formatVersion": "topic-review.v1", "é": 1})
        got = json.load(open(at, encoding="utf-8"))
        assert got["é"] == 1
        assert [s["evidenceRef"] for s in got["sessions"]] == [topics.reference("n", k + 1) for k in range(n)]
        assert all(s == {"evidenceRef": s["evidenceRef"], "source": "codex", "userEvidence": ['say "é" \\', "x"] if k % 2 == 0 else [], "primaryTopic": None} for k, s in enumerate(got["sessions"]))
        assert artifact.read_review(spark, at) == got
        assert sorted(r.evidenceRef for r in artifact.review_sessions(spark, at).collect()) == [s["evidenceRef"] for s in got["sessions"]]
    assert os.listdir(tmp_path) == ["review.json"]
    assert oct(os.stat(at).st_mode)[-3:] == "600"


def test_nothing_is_left_of_a_failure(spark, tmp_path):
    at = str(tmp_path / "review.json")
    with pytest.raises(ValueError):
        artifact.write_review(rows(spark, 5, clean=False), at, {})
    os.mkdir(at)  # can't be replaced
    open(f"{at}/x", "w").close()
    with pytest.raises(OSError):
        artifact.write_review(rows(spark, 5), at, {})
    assert os.listdir(tmp_path) == ["review.json"] and os.listdir(at) == ["x"]
