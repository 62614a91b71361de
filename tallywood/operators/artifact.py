"""The topic review as a file: executors write its sessions as ordered parts, the file system joins them, the name appears last.

The driver copies the parts' bytes from stream to stream in blocks, so its memory doesn't grow
with the sessions.  Each session is one line, so the file can be read back line by line in parallel.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.sources.staging import folder

_SESSION = "evidenceRef string, source string, userEvidence array<string>, primaryTopic string"


def _place(spark: SparkSession, at: str):
    """File system and path; a local file system without checksum files beside what it writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at if ":/" in at else f"file://{os.path.abspath(at)}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRaw() if path.toUri().getScheme() == "file" else fs), path


def write_review(review: DataFrame, at: str, head: dict) -> None:
    """Writes head's fields and `sessions` as one JSON document, all or nothing, readable by the owner only.

    review is what `topics.create_review` gives; it is read twice, so give a table.  Raises
    ValueError where a row isn't clean, and writes nothing then.  No rows give an empty list.
    Where the file system doesn't replace files, a file of that name is an error.
    """
    if not review.filter("not clean").isEmpty():
        raise ValueError("review evidence still holds something sensitive")
    spark = review.sparkSession
    hadoop, io = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.io.IOUtils
    fs, target = _place(spark, at)
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        raise OSError(f"{at} is a folder")
    own = hadoop.Path(target.getParent(), f".tallywood-{uuid.uuid4().hex}")
    allowed = lambda mode: hadoop.permission.FsPermission(mode)
    hadoop.FileSystem.mkdirs(fs, own, allowed("700"))
    try:
        row = F.to_json(F.struct(F.col("evidence_ref").alias("evidenceRef"), "source", F.col("evidence").alias("userEvidence"), F.col("primary_topic").alias("primaryTopic")), {"ignoreNullFields": "false"})
        lines = review.select("pos", F.concat(F.when(F.col("pos") > 1, ",").otherwise(""), row).alias("value")).orderBy("pos").select("value")
        lines.write.text(hadoop.Path(own, "parts").toString())
        parts = sorted(p.getPath().getName() for p in fs.listStatus(hadoop.Path(own, "parts")))
        whole = hadoop.Path(own, "whole")
        out = fs.create(whole)
        try:
            fs.setPermission(whole, allowed("600"))
            out.write(bytearray((json.dumps(head, ensure_ascii=False)[:-1] + ', "sessions": [\n').encode()))
            for name in parts:
                if name.startswith("part-"):
                    part = fs.open(hadoop.Path(own, f"parts/{name}"))
                    try:
                        io.copyBytes(part, out, 65536, False)
                    finally:
                        part.close()
            out.write(bytearray(b"]}\n"))
        finally:
            out.close()
        if not fs.rename(whole, target):
            raise OSError(f"{at} can't be written")
    finally:
        fs.delete(own, True)


def review_sessions(spark: SparkSession, at: str) -> DataFrame:
    """evidenceRef, source, userEvidence and primaryTopic of a review as `write_review` lays it out, line by line."""
    lines = spark.read.text(at if ":/" in at else f"file://{os.path.abspath(at)}").filter(F.col("value").rlike('^,?[{]"evidenceRef":'))
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), _SESSION).alias("s")).select("s.*")


def own_place(spark: SparkSession) -> str:
    """A new name in the folder for tables between steps; its file goes when the driver ends."""
    at = f"{folder(spark)}/review-{uuid.uuid4().hex}.json"
    fs, path = _place(spark, at)
    fs.deleteOnExit(path)
    return at


def read_review(spark: SparkSession, at: str) -> dict:
    """The whole document."""
    return json.loads(spark.read.text(at if ":/" in at else f"file://{os.path.abspath(at)}", wholetext=True).first().value)
