"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tallywood.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v, ".9g")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted([plain([r[c] for c in cols]) for r in df.collect()], key=str) == sorted([plain([r[i] for i in at]) for r in rel.fetchall()], key=str)


def test_cli(tmp_path, spark):
    import io
    import json

    from tallywood import cli

    log = tmp_path / "a.jsonl"
    log.write_text(json.dumps({"type": "user", "sessionId": "s", "timestamp": "2026-07-01T10:00:00Z", "message": {"role": "user", "content": "what is this"}}) + "\n")
    f, m = str(tmp_path / "f.json"), str(tmp_path / "m.md")
    out = io.StringIO()
    assert cli.run(["facts", "--source", f"claude_code={log}", "--output", f], out) == 0
    assert oct(os.stat(f).st_mode)[-3:] == "600"
    assert cli.run(["render", f, "--output", m], out) == 0
    assert cli.run(["validate", m, "--facts", f], out) == 2
    text = open(m).read().replace("privacy_reviewed: false", "privacy_reviewed: true")
    open(m, "w").write(text)
    assert cli.run(["inspect", m, "--facts", f, "--json"], out) == 0
    assert cli.run(["redact", m, "--output", str(tmp_path / "r.md")], out) == 0
    with pytest.raises(SystemExit):
        cli.run(["facts", "--sauce", "x"])
    with pytest.raises(ValueError):
        cli.store_once(str(tmp_path), b"x", "0" * 64)


def test_stream(spark, tmp_path):
    from tallywood.streaming.append import record_stream, windowed_counts

    d = tmp_path / "in"
    d.mkdir()
    (d / "a.jsonl").write_text('{"type":"user","timestamp":"2026-07-01T10:05:00Z"}\n{"type":"user","timestamp":1782900600}\nbroken\n')
    q = windowed_counts(record_stream(spark, str(d), "codex")).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sum(r["count"] for r in spark.table("seen").collect()) == 2
