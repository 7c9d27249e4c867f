"""New and changed files of a folder: by time and size, by checksum, or by the tag that an object store gives."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources.templates import render


def _checksum(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return {"md5": hashlib.file_digest(f, "md5").hexdigest()}


def _age(path: str) -> dict[str, Any]:
    s = os.stat(path)
    return {"modified_ns": s.st_mtime_ns, "bytes": s.st_size}


MARKS = {"mtime": _age, "checksum": _checksum}


def fingerprint(path: str, strategy: str = "mtime") -> dict[str, Any]:
    """What tells this version of a file from others."""
    if strategy not in MARKS:
        raise ValueError(f"unknown tracking strategy '{strategy}'")
    return MARKS[strategy](path)


@dataclass
class Cursor:
    """Fingerprints of the files seen so far; with a place to keep them it goes on where it stopped.

    keep: reads (no argument: text or None) and writes (one argument) the state, e.g. a file of the table store. A file counts as
    seen once ``commit`` was called after it, so what was found but not taken is found again after a crash.
    """

    seen: dict[str, dict[str, Any]] = field(default_factory=dict)
    keep: Callable[..., str | None] | None = None

    def __post_init__(self) -> None:
        if self.keep and (text := self.keep()):
            self.seen = json.loads(text)

    def fresh(self, found: Iterable[tuple[str, dict[str, Any]]]) -> list[str]:
        """Files that are new or changed, which are then seen."""
        out = []
        for path, mark in found:
            if self.seen.get(path) != mark:
                self.seen[path] = mark
                out.append(path)
        return out

    def commit(self) -> None:
        if self.keep:
            self.keep(json.dumps(self.seen))


def local_files(folder: str, pattern: str = "*", strategy: str = "mtime", keep: Callable[[str], bool] | None = None) -> list[tuple[str, dict[str, Any]]]:
    """Files of a folder by name, with fingerprints. The folder may be a template."""
    folder = render(folder)
    if not os.path.isdir(folder):
        return []
    paths = [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if fnmatch.fnmatch(n, pattern)]
    return [(p, fingerprint(p, strategy)) for p in paths if os.path.isfile(p) and (keep is None or keep(p))]


def object_files(client: Any, bucket: str, prefix: str = "", pattern: str = "*", keep: Callable[[str], bool] | None = None) -> list[tuple[str, dict[str, Any]]]:
    """Objects of a bucket by key, with their tags. client: anything with the paginator of an S3 client."""
    out = []
    for page in client.get_paginator("list_objects_v2").paginate(Bucket=bucket, Prefix=render(prefix)):
        for o in page.get("Contents", []):
            name = o["Key"].rsplit("/", 1)[-1]
            if name and fnmatch.fnmatch(name, pattern) and (keep is None or keep(o["Key"])):
                out.append((f"s3a://{bucket}/{o['Key']}", {"etag": o["ETag"].strip('"')}))
    return sorted(out)


def listed(spark: SparkSession, path: str, pattern: str = "*", checksum: bool = False) -> DataFrame:
    """path, modified, size (and md5) of files, by Spark: for folders too large for a listing on the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    columns = ["path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")]
    return files.select(*columns, F.md5("content").alias("md5")) if checksum else files.select(*columns)
