"""Alias documents: sound, bad, repeated and known ones."""

import json
from datetime import datetime

import pytest
from oddslake.sources import documents, ingest

GOOD = {
    "provider": "book", "game": "lol", "name": "Älpha", "competition_key": "k", "target_provider": "p", "target_id": "1",
    "valid_from": "2024-01-01T00:00:00+02:00", "valid_until": "2024-02-01T00:00:00Z", "evidence": {"sources": ["https://x"], "reason": "seen", "more": {"a": 1}},
}


@pytest.fixture
def read(spark, tmp_path):
    def run(**files):
        for name, value in files.items():
            (tmp_path / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
        return documents.alias_records(documents.whole_files(spark, str(tmp_path)))

    return run


def issues(records):
    return {(r["path"].rsplit("/", 1)[1][:-5], r["place"]): r["issue"] for r in documents.quarantined(records).collect()}


def test_sound_documents(read):
    other = dict(reversed(GOOD.items()))
    got = documents.accepted(read(a={"aliases": [GOOD], "competition_aliases": [GOOD]}, b={"aliases": [other, GOOD | {"target_id": "2"}]}, empty={})).collect()
    assert sorted((r["kind"], r["target_id"]) for r in got) == [("competition", "1"), ("team", "1"), ("team", "2")] and len({r["alias_id"] for r in got}) == 3
    first = next(r for r in got if r["kind"] == "competition")
    assert (first["name"], first["valid_from"], first["valid_until"]) == ("Älpha", datetime(2023, 12, 31, 22), datetime(2024, 2, 1)) and json.loads(first["evidence"])["more"] == {"a": 1}


BAD = {
    "unknown-field": {"extra": 1}, "empty-text": {"name": ""}, "time-without-offset": {"valid_from": "2024-01-01T00:00:00"}, "empty-interval": {"valid_until": "2023-12-31T22:00:00Z"}, "no-evidence": {"evidence": {"sources": [], "reason": "x"}},
}


def test_bad_documents_are_set_aside_with_their_reasons(read):
    files = {issue.replace("-", "_"): {"aliases": [GOOD, GOOD | change]} for issue, change in BAD.items()}
    files |= {"missing_field": {"aliases": [GOOD, {k: v for k, v in GOOD.items() if k != "game"}]}, "no_reason": {"aliases": [GOOD, GOOD | {"evidence": {"sources": ["x"]}}]}, "text_evidence": {"aliases": [GOOD, GOOD | {"evidence": "x"}]}}
    files |= {"broken": '{"aliases": [', "list": "[]", "other": {"alias": []}, "single": {"aliases": {"a": 1}}, "number": {"aliases": [3]}, "good": {"aliases": [GOOD | {"target_id": "9"}]}}
    records = read(**files)
    want = {(i.replace("-", "_"), 1): i for i in BAD} | {("missing_field", 1): "missing-field", ("no_reason", 1): "no-evidence", ("text_evidence", 1): "no-evidence"}
    want |= {("broken", None): "not-an-object", ("list", None): "not-an-object", ("other", None): "unknown-list", ("single", None): "not-a-list", ("number", 0): "not-an-object"}
    assert issues(records) == want
    assert [r["target_id"] for r in documents.accepted(records).collect()] == ["9"]


def test_known_records_are_not_added_again(read):
    found = documents.accepted(read(a={"aliases": [GOOD, GOOD | {"target_id": "2"}]}))
    table = found.where("target_id = '1'")
    assert ingest.insert_absent(table, found, ["alias_id"]).count() == 2
    assert ingest.insert_absent(found, found, ["alias_id"]).count() == 2
