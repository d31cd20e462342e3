"""An archive of captures: damaged members, ranges of days, the newest capture of an id."""

import gzip
import hashlib
import json
from datetime import date

import pytest
from oddslake.sources import captures
from pyspark.sql import functions as F

sha = lambda x: hashlib.sha256(x).hexdigest()


@pytest.fixture
def archive(tmp_path):
    entries = []

    def add(name, first, last, at, lines, write=True, **changes):
        raw = "\n".join(lines).encode()
        packed = gzip.compress(raw)
        if write:
            (tmp_path / name).write_bytes(changes.pop("packed", packed))
        entries.append({"filename": name, "from": first, "to": last, "retrievedAt": at, "documentSha256": sha(raw), "artifactSha256": sha(packed)} | changes)
        (tmp_path / "manifest.json").write_text(json.dumps({"archives": entries}))
        return str(tmp_path)

    return add


def test_members_of_other_days_are_not_opened(spark, archive):
    archive("a.gz", "2024-01-01", "2024-01-10", "2024-01-11T00:00:00+00:00", ["x é"])
    archive("b.gz", "2024-02-01", "2024-02-10", "2024-02-11T00:00:00+02:00", ["y"], write=False)  # would fail
    folder = archive("c.gz", "2024-01-08", "2024-03-01", "2024-03-02T00:00:00Z", ["z"])
    rows = captures.captures(spark, folder, date(2024, 1, 5), date(2024, 1, 9))
    assert sorted((r["filename"], r["document"], r["issue"]) for r in rows.collect()) == [("a.gz", "x é", None), ("c.gz", "z", None)]
    assert rows.rdd.getNumPartitions() == 2
    assert [r["filename"] for r in captures.captures(spark, folder, first=date(2024, 1, 11), last=date(2024, 1, 20)).collect()] == ["c.gz"]
    assert captures.captures(spark, folder, first=date(2025, 1, 1)).count() == 0
    assert captures.captures(spark, "file://" + folder, last=date(2024, 1, 1)).count() == 1


def test_damaged_members_fail_or_are_kept_with_their_issue(spark, archive):
    day = ("2024-01-01", "2024-01-02", "2024-01-03T00:00:00Z")
    archive("good.gz", *day, ["ok"])
    archive("changed.gz", *day, ["ok"], packed=gzip.compress(b"other"))
    archive("plain.gz", *day, ["ok"], packed=b"plain", artifactSha256=sha(b"plain"))
    archive("inside.gz", *day, ["ok"], documentSha256=sha(b"?"))
    binary = gzip.compress(b"\xff\xfe")
    archive("binary.gz", *day, ["ok"], packed=binary, artifactSha256=sha(binary), documentSha256=sha(b"\xff\xfe"))
    folder = archive("gone.gz", *day, ["ok"], write=False)
    got = {r["filename"]: (r["document"], r["issue"]) for r in captures.captures(spark, folder, damaged="keep").collect()}
    assert got == {"good.gz": ("ok", None), "changed.gz": (None, "artifact-checksum"), "plain.gz": (None, "not-compressed"), "inside.gz": (None, "document-checksum"), "binary.gz": (None, "not-text"), "gone.gz": (None, "missing")}
    with pytest.raises(Exception, match="checksum|missing|not-"):
        captures.captures(spark, folder).collect()


@pytest.mark.parametrize("change", [{"filename": "../x.gz"}, {"filename": "x.txt"}, {"from": "2024-01-09"}, {"from": "soon"}, {"retrievedAt": "2024-01-03T00:00:00"}, {"documentSha256": "A" * 64}, {"artifactSha256": None}])
def test_manifests_that_are_not_sound(change):
    entry = {"filename": "x.gz", "from": "2024-01-01", "to": "2024-01-02", "retrievedAt": "2024-01-03T00:00:00Z", "documentSha256": "a" * 64, "artifactSha256": "b" * 64}
    assert len(captures.members(json.dumps({"archives": [entry]}).encode())) == 1
    with pytest.raises(ValueError):
        captures.members(json.dumps({"archives": [entry | change]}).encode())
    for other in ("[]", "{}", '{"archives": [3]}'):
        with pytest.raises(ValueError):
            captures.members(other.encode())


def test_the_newest_capture_of_each_id(spark, archive):
    archive("a.gz", "2024-01-01", "2024-01-10", "2024-01-11T00:00:00Z", ["1,2024-01-02,old", "2,2024-01-03,only", "3,2024-02-03,outside its capture"])
    archive("b.gz", "2024-01-01", "2024-01-20", "2024-01-21T00:00:00Z", ["1,2024-01-04,new", "4,2024-01-19,outside the days asked for"])
    folder = archive("a2.gz", "2024-01-01", "2024-01-10", "2024-01-11T00:00:00Z", ["2,2024-01-03,same time"])
    lines = captures.captures(spark, folder, date(2024, 1, 1), date(2024, 1, 10)).withColumn("line", F.explode(F.split("document", "\n")))
    parts = F.split("line", ",")
    rows = lines.select("filename", "retrieved_at", "first_day", "last_day", parts[0].alias("id"), parts[1].cast("date").alias("day"), parts[2].alias("what"))
    got = {r["id"]: r["what"] for r in captures.newest_of_each(rows, "id", "day", date(2024, 1, 1), date(2024, 1, 10)).collect()}
    assert got == {"1": "new", "2": "only"}
