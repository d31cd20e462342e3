"""Reviewed JSON documents: strict shapes, bad documents set aside with their reasons, records known by their content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.functions import moments, text

#: The lists of an alias document and the kind of their records; what a record must have (fixed values).
ALIAS_LISTS = {"aliases": "team", "competition_aliases": "competition"}
ALIAS_TEXTS = ("provider", "game", "name", "competition_key", "target_provider", "target_id")
ALIAS_TIMES = ("valid_from", "valid_until")
EVIDENCE = ("sources", "reason")


def whole_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, text) of the files of a folder, each read whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.decode("content", "utf-8").alias("text"))


def _is_object(c: Column) -> Column:
    return F.json_object_keys(c).isNotNull() & F.ltrim(c).startswith("{")


def _first_issue(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, null if none does; a rule that is null does not hold."""
    return reduce(lambda c, rule: c.when(rule[1], rule[0]), list(rules.items())[1:], F.when(next(iter(rules.values())), next(iter(rules))))


def _tagged(records: str, kind: str) -> Column:
    return F.transform(records, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("json")))


def alias_records(files: DataFrame) -> DataFrame:
    """All records of alias documents, sound or not: path, place, issue (null if sound), alias_id, kind and the record's fields.

    ``files``: path, text. A document that is no JSON object, or has another list or one that
    is no list, gives one row with its issue and no place. A record has exactly the fields
    of ALIAS_TEXTS (not empty), ALIAS_TIMES (with an offset; the first before the second)
    and evidence, an object with sources and a reason. alias_id is the digest of kind and
    record, whatever the order of its fields.
    """
    lists = "struct<" + ",".join(f"{name}:array<string>" for name in ALIAS_LISTS) + ">"
    parsed = F.from_json("text", lists)
    keys = F.json_object_keys("text")
    known = F.array(*map(F.lit, ALIAS_LISTS))
    present = [F.array_contains(keys, name) & parsed[name].isNull() for name in ALIAS_LISTS]
    rules = {"not-an-object": ~F.coalesce(_is_object(F.col("text")), F.lit(False)), "unknown-list": F.size(F.array_except(keys, known)) > 0, "not-a-list": reduce(lambda a, b: a | b, present)}
    whole = files.select("path", _first_issue(rules).alias("issue"), *[F.coalesce(parsed[name], F.array().cast("array<string>")).alias(name) for name in ALIAS_LISTS])
    tagged = F.concat(*[_tagged(name, kind) for name, kind in ALIAS_LISTS.items()])
    rows = whole.where("issue is null").select("path", F.posexplode(tagged).alias("place", "r")).select("path", "place", "r.kind", "r.json")

    fields = (*ALIAS_TEXTS, *ALIAS_TIMES, "evidence")
    record = F.from_json("json", ", ".join(f"{c} string" for c in fields))
    rows = rows.withColumn("record", record).withColumn("keys", F.json_object_keys("json"))
    times = [moments.instant(F.col(f"record.{c}")) for c in ALIAS_TIMES]
    evidence = F.from_json(F.col("record.evidence"), ", ".join(f"{c} string" for c in EVIDENCE))
    blank = lambda c: F.coalesce(c, F.lit("")).isin("", "[]", "{}", "false", "0")
    either = lambda columns: reduce(lambda a, b: a | b, columns)
    checks = {
        "not-an-object": ~F.coalesce(_is_object(F.col("json")), F.lit(False)),
        "unknown-field": F.size(F.array_except("keys", F.array(*map(F.lit, fields)))) > 0,
        "missing-field": F.size(F.array_except(F.array(*map(F.lit, fields)), "keys")) > 0,
        "empty-text": either([F.coalesce(F.col(f"record.{c}"), F.lit("")) == "" for c in ALIAS_TEXTS]),
        "time-without-offset": either([t.isNull() for t in times]),
        "empty-interval": times[1] <= times[0],
        "no-evidence": ~F.coalesce(_is_object(F.col("record.evidence")), F.lit(False)) | either([blank(evidence[c]) for c in EVIDENCE]),
    }
    digest = text.fingerprint({"kind": F.col("kind")} | {c: F.col(f"record.{c}") for c in fields})
    issue = _first_issue(checks)
    out = rows.select("path", "place", issue.alias("issue"), digest.alias("alias_id"), "kind", *[F.col(f"record.{c}").alias(c) for c in ALIAS_TEXTS], *[t.alias(c) for t, c in zip(times, ALIAS_TIMES, strict=True)], F.col("record.evidence").alias("evidence"))
    return out.unionByName(whole.where("issue is not null").select("path", "issue"), allowMissingColumns=True)


def accepted(records: DataFrame) -> DataFrame:
    """Records of documents without any issue, each content once; a document with one bad record gives none."""
    bad = records.where("issue is not null").select("path").distinct()
    return records.join(bad, "path", "left_anti").drop("path", "place", "issue").dropDuplicates(["alias_id"])


def quarantined(records: DataFrame) -> DataFrame:
    """(path, place, issue): why documents were set aside."""
    return records.where("issue is not null").select("path", "place", "issue")
