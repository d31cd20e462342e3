"""An archive of captured pages: a manifest and compressed members, read as a Spark data source.

The folder holds ``manifest.json``, an object with a list ``archives`` of members: filename,
from and to (days that the page lists), retrievedAt, documentSha256 and artifactSha256. A
partition is a member. Filters on days and on the time of retrieval choose members before
any is opened, and each member is checked as it is read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from oddslake.operators.latest import top_n

FORMAT = "captures"
SCHEMA = "filename string, first_day date, last_day date, retrieved_at timestamp, document_sha256 string, artifact_sha256 string, document string, issue string"
_DIGEST = re.compile(r"[0-9a-f]{64}")


@dataclass
class Member(InputPartition):
    filename: str
    first_day: date
    last_day: date
    retrieved_at: datetime
    document_sha256: str
    artifact_sha256: str


def _opened(folder: str, name: str) -> bytes:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    with files.open_input_stream(f"{path.rstrip('/')}/{name}", compression=None) as source:
        return source.read()


def members(manifest: bytes) -> list[Member]:
    """The members that a manifest lists; a manifest that is not sound is an error."""
    listed = json.loads(manifest)
    if not isinstance(listed, dict) or not isinstance(listed.get("archives"), list):
        raise ValueError("a manifest holds a list of archives")
    out = []
    for entry in listed["archives"]:
        fields = [entry.get(k) if isinstance(entry, dict) else None for k in ("filename", "from", "to", "retrievedAt", "documentSha256", "artifactSha256")]
        if not all(isinstance(x, str) for x in fields):
            raise ValueError("a member lacks a field, or has one that is no text")
        name, first, last, retrieved, *digests = fields
        if "/" in name or "\\" in name or not name.endswith(".gz"):
            raise ValueError(f"{name} is not the name of a compressed file of the folder")
        if not all(_DIGEST.fullmatch(x) for x in digests):
            raise ValueError(f"{name} has a checksum that is no SHA-256 in lower case")
        at = datetime.fromisoformat(retrieved)
        if at.tzinfo is None:
            raise ValueError(f"{name} was retrieved at a time without an offset")
        member = Member(name, date.fromisoformat(first), date.fromisoformat(last), at, *digests)
        if member.first_day > member.last_day:
            raise ValueError(f"{name} ends before it begins")
        out.append(member)
    return out


def checked(member: Member, packed: bytes) -> tuple[str | None, str | None]:
    """(document, issue): the member's text, or why it can't be trusted."""
    if hashlib.sha256(packed).hexdigest() != member.artifact_sha256:
        return None, "artifact-checksum"
    try:
        raw = gzip.decompress(packed)
    except (OSError, EOFError):
        return None, "not-compressed"
    if hashlib.sha256(raw).hexdigest() != member.document_sha256:
        return None, "document-checksum"
    try:
        return raw.decode(), None
    except UnicodeDecodeError:
        return None, "not-text"


class CaptureReader(DataSourceReader):
    _TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}

    def __init__(self, options: dict):
        self.folder, self.damaged = options["path"], options.get("damaged", "fail")
        if self.damaged not in ("fail", "keep"):
            raise ValueError("damaged is fail or keep")
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self._TESTS and f.attribute in (("first_day",), ("last_day",)) and isinstance(f.value, date):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[Member]:
        listed = members(_opened(self.folder, "manifest.json"))
        return [m for m in listed if all(self._TESTS[type(f)](getattr(m, f.attribute[0]), f.value) for f in self.wanted)]

    def read(self, partition: Member | None) -> Iterator[tuple]:
        m = partition
        if m is None:  # no member is wanted
            return
        try:
            document, issue = checked(m, _opened(self.folder, m.filename))
        except FileNotFoundError:
            document, issue = None, "missing"
        if issue is not None and self.damaged == "fail":
            raise ValueError(f"{m.filename}: {issue}")
        yield m.filename, m.first_day, m.last_day, m.retrieved_at, m.document_sha256, m.artifact_sha256, document, issue


class Captures(DataSource):
    """Options: path, the folder; damaged, "fail" (a damaged member is an error) or "keep" (its row has an issue and no document)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def captures(spark: SparkSession, folder: str, first: date | None = None, last: date | None = None, damaged: str = "fail") -> DataFrame:
    """The members of the archive in ``folder`` that overlap the days from ``first`` to ``last``, one row each; others are not opened."""
    spark.dataSource.register(Captures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(FORMAT).option("damaged", damaged).load(folder)
    rows = rows if first is None else rows.where(F.col("last_day") >= F.lit(first))
    return rows if last is None else rows.where(F.col("first_day") <= F.lit(last))


def newest_of_each(found: DataFrame, key: str, day: str, first: date, last: date) -> DataFrame:
    """Of rows read from captures, one for each ``key``: that of the newest capture, on ties of the smallest file name.

    ``found`` has key, day, filename, retrieved_at, first_day and last_day; rows whose day
    is outside their capture's days, or outside ``first`` to ``last``, don't count.
    """
    inside = F.col(day).between(F.col("first_day"), F.col("last_day")) & F.col(day).between(F.lit(first), F.lit(last))
    return top_n(found.where(inside), [key], [F.desc("retrieved_at"), F.asc("filename")])
