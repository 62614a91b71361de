"""Session-log files as a table of records.

Tasks list the folders, one round for each depth, and the listing stays a table.  Spark's
readers take the visible files under the inputs' roots; they skip names that begin with a
dot or underscore, so tasks read those themselves, through pyarrow's file systems where
the path names one.  Records are parsed in the JVM.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.functions.textrules import SPACE
from tallywood.sources.staging import staged

SUPPORTED = (".json", ".jsonl", ".ndjson")
SOURCES = ("codex", "claude_code")
ENTRIES = "source string, root string, path string, bytes long, kind string, hidden boolean"
LINES = "path string, block long, seq long, value string"
CHUNK = 1 << 20  # bytes of a hidden file that a task holds at once, and one line


@dataclass(frozen=True)
class SourceInput:
    source: str
    path: str


def rooted(path: str) -> str:
    """A local path without links, or another file system's URI as it is."""
    local = re.sub("^file:/+", "/", path)
    return path.rstrip("/") if "://" in local else os.path.realpath(local)


def _kind(name: str) -> str:
    return "file" if os.path.splitext(name)[1].lower() in SUPPORTED else "other"


def remote_entries(uri: str) -> list[tuple[str, int, str]]:
    """`entries` by pyarrow's file systems."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri)
    head = uri[: uri.rindex(at)]
    found = system.get_file_info(at)
    if found.type == fs.FileType.File:
        return [(uri, found.size, _kind(at))]
    if found.type != fs.FileType.Directory:
        return []
    return [(head + i.path, i.size or 0, "folder" if i.type == fs.FileType.Directory else _kind(i.path)) for i in system.get_file_info(fs.FileSelector(at))]


def entries(path: str) -> list[tuple[str, int, str]]:
    """(path, bytes, folder | file | other) of a file, or of what a folder holds; links in it aren't followed, what is absent holds nothing."""
    if "://" in path:
        return remote_entries(path)
    if os.path.isfile(path):
        return [(path, os.path.getsize(path), _kind(path))]
    if not os.path.isdir(path):
        return []
    with os.scandir(path) as inside:
        plain = [e for e in inside if not e.is_symlink()]
    folders = [(e.path, 0, "folder") for e in plain if e.is_dir()]
    return folders + [(e.path, e.stat().st_size, _kind(e.name)) for e in plain if e.is_file()]


def _is_hidden(path: str, root: str) -> bool:
    """Whether Spark's readers skip the file when they are given the root."""
    below = path[len(root) :].strip("/") or os.path.basename(path)
    return any(n[0] in "._" or n.endswith("._COPYING_") for n in below.split("/") if n)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["source", "root", "path", "bytes", "kind", "hidden"]
    for b in batches:
        rows = [(s, r, p, n, k, _is_hidden(p, r)) for s, r, at in zip(b["source"], b["root"], b["path"]) for p, n, k in entries(at)]
        yield pd.DataFrame(rows, columns=columns)


def walk(spark: SparkSession, inputs: list[SourceInput]) -> DataFrame:
    """Every file that an input reaches, once for each such input; root is the topmost input's folder around it."""
    roots = [rooted(i.path) for i in inputs]
    top = {r: min((o for o in roots if r == o or r.startswith(o.rstrip("/") + "/")), key=len) for r in roots}
    level = spark.createDataFrame([(i.source, top[r], r) for i, r in zip(inputs, roots)], "source string, root string, path string")
    cores = spark.sparkContext.defaultParallelism
    out = None
    while True:
        seen = staged(level.repartition(cores, "path").mapInPandas(_listed, ENTRIES), "listing")
        files = seen.filter("kind <> 'folder'")
        out = files if out is None else out.unionAll(files)
        level = seen.filter("kind = 'folder'").select("source", "root", "path")
        if level.isEmpty():
            return out


def listing(spark: SparkSession, inputs: list[SourceInput]) -> tuple[DataFrame, dict[str, int], list[str]]:
    """(files, unsupported files of each source, sources in input order).

    A file reached twice counts once, by canonical path; unsupported files count at every
    input that reaches them.  Ranks grow with the Unicode collation of paths; they have gaps.
    """
    if not inputs:
        raise ValueError("at least one source is needed")
    seen = set()
    for i in inputs:
        if i.source not in SOURCES:
            raise ValueError(f"unsupported source: {i.source}")
        key = (i.source, i.path if "://" in i.path else os.path.abspath(i.path))
        if key in seen:
            raise ValueError(f"the same source and path twice: {i.source}={i.path}")
        seen.add(key)
    order = list(dict.fromkeys(i.source for i in inputs))
    found = walk(spark, inputs)
    others = dict.fromkeys(order, 0) | {r.source: r.n for r in found.filter("kind = 'other'").groupBy("source").agg(F.count("*").alias("n")).collect()}
    once = found.filter("kind = 'file'").groupBy("source", "root", "path", "hidden").agg(F.max("bytes").alias("bytes"))
    ranked = once.orderBy("source", F.expr("path COLLATE UNICODE"), "path").withColumn("file_rank", F.monotonically_increasing_id())
    return staged(ranked, "files"), others, order


def parsed(text: str) -> Column:
    """The variant of a text that is one strict JSON value, else null.

    Spark's parser reads one value and ignores what follows it.  Whatever follows would
    have to go on both as an array and as an object, which only blanks can.
    """
    one = F.expr(f"try_parse_json(concat('[', {text}, ']'))")
    named = F.expr(f"try_parse_json(concat('{{\"v\":', {text}, '}}'))")
    return F.when(one.isNotNull(), F.try_variant_get(named, "$.v", "variant"))


def objects(lines: DataFrame, whole: bool) -> DataFrame:
    """pos and v (null where malformed) of each record in `value`; blank lines hold none, a whole file's array holds its elements."""
    value, v = F.col("value"), parsed("value")
    rest = [c for c in lines.columns if c != "value"]
    if not whole:
        said = lines.filter(value.rlike(f"[^{SPACE}]"))
        return said.select(*rest, F.lit(0).alias("pos"), F.when(value.rlike("^[ \\t\\r\\n]*\\{"), v).alias("v"))
    many = F.when(value.rlike("^[ \\t\\r\\n]*\\["), F.expr("try_variant_get(v, '$', 'array<variant>')"))
    said = lines.withColumn("v", v).select(*rest, F.posexplode(F.coalesce(many, F.array("v"))).alias("pos", "v"))
    return said.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of hidden files, whole texts of those that end in .json."""
    from pyarrow import fs

    def frame(path, first, values):
        return pd.DataFrame({"path": path, "block": 0, "seq": range(first, first + len(values)), "value": [v.decode("utf-8", "replace") for v in values]})

    for b in batches:
        for path in b["path"]:
            system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with system.open_input_stream(at) as f:
                if path.lower().endswith(".json"):
                    yield frame(path, 0, [f.read()])
                    continue
                n, rest = 0, b""
                while block := f.read(CHUNK):
                    *full, rest = (rest + block).split(b"\n")
                    yield frame(path, n, full)
                    n += len(full)
                if rest:
                    yield frame(path, n, [rest])


def _caseless(ending: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in ending)


def records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """source, path, ordinal (within the source), v (variant, null where malformed) of every record of the files.

    Of a name that an object repeats the last value counts.  Invalid UTF-8 stays as
    replacement characters or raw bytes and spoils no other line.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    roots = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.root) for r in files.filter("not hidden").select("root").distinct().collect()]  # as many as inputs at most
    parts = []
    for is_whole, names in ((True, "*." + _caseless("json")), (False, f"*.{{{_caseless('jsonl')},{_caseless('ndjson')}}}")):
        shy = files.filter("hidden").filter(F.lower("path").endswith(".json") == is_whole)
        raw = shy.select("path").distinct().repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_read, LINES)
        parts.append(objects(raw, is_whole).join(files.filter("hidden"), "path"))
        if roots:
            read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names)
            raw = read.text([r if "://" in r else f"file://{r}" for r in roots], wholetext=is_whole, **({} if is_whole else {"lineSep": "\n"}))
            path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
            raw = raw.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
            parts.append(objects(raw, is_whole).join(files.filter("not hidden"), "path"))
    order = F.struct(F.col("file_rank").alias("rank"), "block", "seq", "pos")
    done = [p.select("source", "path", order.alias("ordinal"), "v") for p in parts]
    out = done[0]
    for p in done[1:]:
        out = out.unionAll(p)
    return out
