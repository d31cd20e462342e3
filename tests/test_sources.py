"""Files, versions and pages, on samples made by hand."""

import hashlib
import json

import pytest
from oddslake.sources import ingest, pages
from pyspark.sql import functions as F

HEADER = "gameid,participantid,teamid,playerid,date,year,league,kills"


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_strict_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", "﻿" + HEADER + '\ng1,1,t,p,2024-01-01,2024,"Cup, ""é""\nx",\ng1,2,t,p,2024-01-01,2024,Cup,03\n')
    rows = ingest.csv_rows(spark, path)
    assert rows.columns == HEADER.split(",")
    assert [(r["league"], r["kills"]) for r in rows.collect()] == [('Cup, "é"\nx', ""), ("Cup", "03")]
    payload = ingest.payload_rows(rows, "v1").where("participant_id = '2'").first()
    assert (payload["version_id"], payload["game_id"], payload["payload"]["kills"], len(payload["payload"])) == ("v1", "g1", "03", 8)
    for bad in ("gameid,participantid\n1,2\n", HEADER.replace("kills", "league") + "\n", ""):
        with pytest.raises(ingest.InvalidFile):
            ingest.csv_rows(spark, write(tmp_path, "bad.csv", bad))
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        ingest.csv_rows(spark, write(tmp_path, "wide.csv", HEADER + "\n1,2,3\n")).collect()


def test_files_by_content_and_year(spark, tmp_path):
    for name, text in (("2023.csv", "x"), ("2024.csv", "y"), ("copy.csv", "x"), ("other.txt", "z")):
        write(tmp_path, name, text)
    files = ingest.file_digests(spark, str(tmp_path), "*.csv")
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in "xyz"}
    assert sorted((r["length"], r["sha256"]) for r in files.collect()) == sorted([(1, sha["x"]), (1, sha["y"]), (1, sha["x"])])
    fresh = ingest.new_content(files, spark.createDataFrame([(sha["y"],)], "sha256 string")).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["sha256"]) for r in fresh] == [("2023.csv", sha["x"])]
    assert files.select(ingest.content_path(F.col("sha256")).alias("p")).where(f"p = 'sha256/{sha['y'][:2]}/{sha['y']}'").count() == 1
    listed = spark.createDataFrame([("b", 2024), ("a", 2023), ("c", 2022), ("d", 2022)], "path string, file_year int")
    assert [r["path"] for r in ingest.selected_files(listed, [2024, 2023]).collect()] == ["a", "b"]
    for years in ([2021], [2022], [2023, 2021]):
        with pytest.raises(ingest.InvalidFile):
            ingest.selected_files(listed, years)


def test_a_version_is_seen_once_its_pointer_moves(spark, tmp_path):
    table, pointer = f"{tmp_path}/table", f"{tmp_path}/pointer"
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    seen = lambda: sorted(r["v"] for r in ingest.active_rows(spark, table, pointer).collect())
    ingest.publish(rows("a", "b"), table, pointer, "d1", "1")
    ingest.publish(rows("x"), table, pointer, "d2", "1")
    assert seen() == ["a", "b", "x"]
    rows("half").withColumns({"dataset_id": F.lit("d1"), "version_id": F.lit("2")}).write.mode("append").partitionBy("dataset_id", "version_id").parquet(table)
    assert seen() == ["a", "b", "x"]  # written, but not yet pointed to
    ingest.publish(rows("c"), table, pointer, "d1", "2")
    assert seen() == ["c", "x"]


def page(spark, html, url="https://h.example/m/1/"):
    return spark.createDataFrame([(1, url, html), (2, url, None), (3, url, "")], "page_id long, url string, html string")


def test_embedded_objects(spark):
    html = '<script id="a" type="application/json">{"a": undefined, "b": ["undefined", {"c": 1}]}</script><script type="application/json">{broken</script><SCRIPT type="application/json">[{"d": null}]</SCRIPT>'
    got = [(r["page_id"], r["place"], json.loads(r["data"])) for r in pages.embedded_objects(page(spark, html)).collect()]
    assert got == [(1, 0, {"a": None, "b": ["undefined", {"c": 1}]}), (1, 1, {"c": 1}), (1, 2, {"d": None})]


def event(**more):
    return json.dumps({"@type": "SportsEvent", "name": "A - B", "url": "/m/1", "startDate": "2024-01-01T12:00:00+02:00"} | more)


def ld(*events):
    return "".join(f'<script type="application/ld+json">{e}</script>' for e in events)


def test_the_only_event_of_a_page(spark):
    found = lambda *events: [(r["name"], None if r["starts_at"] is None else r["starts_at"].isoformat()) for r in pages.sports_events(page(spark, ld(*events))).collect()]
    own = event(url="https://h.example/m/1")
    assert found(own, event(url="https://h.example/m/2")) == [("A - B", "2024-01-01T10:00:00")]
    assert found(own, own) == [] and found() == [] and found(event(url="https://h.example/m/1", **{"@type": "Event"})) == []
    assert found(event(url="https://h.example/m/1", startDate="2024-01-01T12:00:00")) == [("A - B", None)]


def stream(*texts):
    return "".join(f"<script>self.__next_f.push([1,{json.dumps(t)}])</script>" for t in texts)


def test_stream_records(spark):
    html = stream('1:{"a":', '1}\n2:T5,é\nxy', '3:["q"]\n4:I not json\n')
    assert pages.flight_records(html) == {"1": {"a": 1}, "2": "é\nxy", "3": ["q"], "4": None}
    got = {(r["page_id"], r["key"]): json.loads(r["data"]) for r in pages.stream_records(page(spark, html)).collect()}
    assert got == {(1, "1"): {"a": 1}, (1, "2"): "é\nxy", (1, "3"): ["q"], (1, "4"): None}
    for broken in ("1:T9,abc", "no key"):
        with pytest.raises(ValueError):
            pages.flight_records(stream(broken))


def test_scoreboards(spark):
    rows = spark.createDataFrame([("1 / 2/3", "210 cs", "31:05"), ("1/2", "", "31:5"), (None, None, None)], "kda string, cs_text string, clock string")
    got = [(r["kills"], r["deaths"], r["assists"], r["cs"], r["seconds"], r["gold"]) for r in pages.scoreboard(rows).collect()]
    assert got == [(1, 2, 3, 210, 1865, None), (None,) * 6, (None,) * 6]
