"""Facts from raw HTML pages: titles and links, embedded JSON documents, JSON-LD events, listings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def titles_and_links(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links and lang of every page, by expressions alone."""
    return pages.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit('<a href="[^"]*"')).alias("n_links"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
    )


def without_undefined(text: str) -> str:
    """A JavaScript object literal with ``undefined`` outside strings as null."""
    parts = re.split(r'("(?:[^"\\]|\\.)*")', text)
    return "".join(p if k % 2 else re.sub(r"\bundefined\b", "null", p) for k, p in enumerate(parts))


def nested_objects(value) -> Iterator[dict]:
    """Every object inside a JSON value, outer ones first."""
    stack = [value]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            yield top
            stack.extend(reversed(list(top.values())))
        elif isinstance(top, list):
            stack.extend(reversed(top))


def _script_values(html: str, kind: str) -> Iterator[object]:
    for body in re.findall(rf'<script[^>]*type="{re.escape(kind)}"[^>]*>(.*?)</script>', html or "", re.S | re.I):
        try:
            yield json.loads(without_undefined(body))
        except ValueError:
            continue


def embedded_objects(pages: DataFrame, kind: str = "application/json") -> DataFrame:
    """(page_id, place, data): every object of the pages' embedded JSON scripts, as JSON text; unreadable scripts give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                objects = [x for value in _script_values(html, kind) for x in nested_objects(value)]
                rows += [(page_id, k, json.dumps(x, sort_keys=True, ensure_ascii=False)) for k, x in enumerate(objects)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "data"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, place int, data string")


def sports_events(pages: DataFrame) -> DataFrame:
    """(page_id, name, starts_at): the only SportsEvent of a page's JSON-LD whose URL path is the page's; other pages give none.

    A start without an explicit offset is null.
    """
    found = embedded_objects(pages, "application/ld+json")
    fields = F.from_json("data", "`@type` string, name string, url string, startDate string")
    events = found.select("page_id", fields.alias("e")).where(F.col("e.`@type`") == "SportsEvent").join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    path = lambda c: F.rtrim(F.try_parse_url(c, F.lit("PATH")), F.lit("/"))
    own = events.where(path(F.col("e.url")) == path(F.col("page_url")))
    single = own.groupBy("page_id").agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    start = F.when(F.col("e.startDate").rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp("e.startDate"))
    return single.select("page_id", F.col("e.name").alias("name"), start.alias("starts_at"))


def flight_records(html: str) -> dict[str, object]:
    """Records of a React stream: ``key:json`` lines, and text records ``key:Tbytes,`` of a hexadecimal byte length.

    ValueError if a record has no key or is cut off.
    """
    stream = "".join(json.loads(x) for x in re.findall(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)', html or ""))
    raw, at, out = stream.encode(), 0, {}
    while at < len(raw):
        head = re.compile(rb"([0-9a-f]+):(?:T([0-9a-f]+),)?").match(raw, at)
        if not head:
            raise ValueError("a record of the page's stream has no key")
        key = head[1].decode()
        if head[2]:
            end = head.end() + int(head[2], 16)
            if end > len(raw):
                raise ValueError("a record of the page's stream is cut off")
            out[key] = raw[head.end() : end].decode(errors="replace")
            at = end
            continue
        end = raw.find(b"\n", head.end())
        end = len(raw) if end < 0 else end
        try:
            out[key] = json.loads(raw[head.end() : end])
        except ValueError:
            out[key] = None
        at = end + 1
    return out


def stream_records(pages: DataFrame) -> DataFrame:
    """(page_id, key, data) of every page's React stream records, data as JSON text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, json.dumps(v, sort_keys=True, ensure_ascii=False)) for i, html in zip(frame["page_id"], frame["html"], strict=True) for k, v in flight_records(html).items()]
            yield pd.DataFrame(rows, columns=["page_id", "key", "data"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, key string, data string")


def scoreboard(rows: DataFrame) -> DataFrame:
    """Adds kills, deaths, assists, cs and seconds parsed from the texts ``kda``, ``cs_text`` and ``clock``; gold, shown as a difference, stays null."""
    number = lambda c, pattern, k: F.regexp_extract(c, pattern, k).try_cast("int")
    kda = r"^\s*(\d+)\s*/\s*(\d+)\s*/\s*(\d+)\s*$"
    return rows.withColumns(
        {
            "kills": number("kda", kda, 1),
            "deaths": number("kda", kda, 2),
            "assists": number("kda", kda, 3),
            "cs": number("cs_text", r"(\d+)", 1),
            "seconds": number("clock", r"^(\d+):(\d{2})$", 1) * 60 + number("clock", r"^(\d+):(\d{2})$", 2),
            "gold": F.lit(None).cast("int"),
        }
    )
