"""Command line: facts, topics apply, render, redact, validate, inspect.  Exit code 0, 1 on error, 2 for an invalid document."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import tempfile

from tallywood.operators import document, facts
from tallywood.operators.validation import facts_problems
from tallywood.plans import report
from tallywood.sources.logs import SourceInput


def write_private(path: str, data: str | bytes) -> None:
    """All or nothing, readable by the owner only."""
    data = data.encode() if isinstance(data, str) else data
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder, prefix=".tallywood-")
    try:
        os.fchmod(fd, 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def store_once(folder: str, data: bytes, approved_sha256: str) -> str:
    """Puts an approved document in a folder under its hash; the same bytes are kept once."""
    digest = hashlib.sha256(data).hexdigest()
    if digest != approved_sha256:
        raise ValueError("the approved hash isn't that of the file")
    path = os.path.join(folder, f"{digest}.md")
    if not os.path.exists(path):
        write_private(path, data)
    return path


def as_json(x) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False) + "\n"


def read_facts(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if problems := facts_problems(out):
        raise ValueError(problems[0])
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tallywood").config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallywood", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("facts", allow_abbrev=False)
    f.add_argument("--source", action="append", required=True, help="NAME=PATH, repeatable")
    f.add_argument("--output", required=True)
    f.add_argument("--topic-review-output")
    f.add_argument("--no-topic-review", action="store_true")
    t = sub.add_parser("topics", allow_abbrev=False)
    t.add_argument("action", choices=["apply"])
    t.add_argument("facts")
    t.add_argument("review")
    t.add_argument("--output", required=True)
    r = sub.add_parser("render", allow_abbrev=False)
    r.add_argument("facts")
    r.add_argument("--output", required=True)
    d = sub.add_parser("redact", allow_abbrev=False)
    d.add_argument("document")
    d.add_argument("--output", required=True)
    for name in ("validate", "inspect"):
        v = sub.add_parser(name, allow_abbrev=False)
        v.add_argument("document")
        v.add_argument("--facts")
        v.add_argument("--json", action="store_true")
    return p


def run(args: list[str], out=sys.stdout) -> int:
    o = parser().parse_args(args)
    say = lambda s: print(s, file=out)
    if o.command == "facts":
        inputs = [SourceInput(*s.split("=", 1)) for s in o.source if "=" in s]
        if len(inputs) < len(o.source):
            raise ValueError("a source is NAME=PATH")
        got = facts.facts(session(), inputs, review_to=None if o.no_topic_review else o.topic_review_output)
        write_private(o.output, as_json(got))
        say(f"{got['overall']['sessionCount']} sessions")
    elif o.command == "topics":
        with open(o.review, encoding="utf-8") as f:
            write_private(o.output, as_json(facts.apply_review(session(), read_facts(o.facts), json.load(f))))
    elif o.command == "render":
        write_private(o.output, report.render(read_facts(o.facts)))
    elif o.command == "redact":
        with open(o.document, encoding="utf-8") as f:
            text, counts = document.redact_samples(f.read())
        write_private(o.output, text)
        say(as_json(counts).strip())
    else:
        with open(o.document, "rb") as f:
            data = f.read()
        meta, issues = document.validate(data, read_facts(o.facts) if o.facts else None)
        told = {"valid": not issues, "sha256": hashlib.sha256(data).hexdigest(), **meta, "issues": [{"code": c, "line": n} for c, n in issues]}
        say(as_json(told).strip() if o.json else "\n".join([f"{'valid' if not issues else 'invalid'} {told['sha256']}", *[f"{n}: {c}" for c, n in issues]]))
        return 2 if issues else 0
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except (ValueError, OSError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
