"""The match list: each match of a span of days with its snapshot, score, maps and last sighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import moments
from oddslake.plans.series import MAP, TARGETS, completed, distinct_bans, folded_maps

#: Sources and their parts (fixed values).
LIVE, ARCHIVE, RETIRED = "loltv", "oracles-elixir", "sofascore"
STATUSES = ("scheduled", "live", "finished", "cancelled", "postponed", "walkover")
WITHOUT_MAPS = ("scheduled", "cancelled", "postponed", "walkover")
SOURCED = "sourced-format"

#: What a snapshot says.
PAYLOAD = f"struct<format:string,completionBasis:string,patch:string,stage:string,currentScore:struct<home:int,away:int>,maps:array<{MAP}>>"


def known_format(source: Column, payload: Column, home: Column, away: Column, match_format: Column) -> Column:
    """The format a snapshot vouches for, null if none: an archive's only with a complete series of that format."""
    named = F.coalesce(payload["format"], match_format)
    result = completed(payload["maps"], home, away, match_format)
    vouched = (source != ARCHIVE) | ((payload["completionBasis"] == SOURCED) & result.isNotNull() & (match_format == named))
    return F.when(named.isin(*TARGETS) & payload["maps"].isNotNull() & F.coalesce(vouched, F.lit(False)), named)


def listed_matches(matches: DataFrame, snapshots: DataFrame, links: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """One row for each match within ``days`` of ``today``: format, status, score, patch, stage, updated_at and maps.

    ``matches``: match_id, league_id, home_id, away_id, starts_at, source, format,
    registered_at. ``snapshots``: snapshot_id, match_id, source, status, observed_at,
    payload (PAYLOAD). ``links``: match_id, provider, last_seen_at.

    Snapshots of the retired source are passed over, and its matches too unless the live
    source has seen them. A walkover of the live source comes first, then the newest complete
    archive, then the newest usable snapshot. Maps whose wins exceed the score are not shown.
    """
    shown = matches.where(moments.within_days(F.col("starts_at"), today, days))
    rows = snapshots.where(F.col("source") != RETIRED).select("match_id", "snapshot_id", F.col("source").alias("s_source"), F.col("status").alias("s_status"), "observed_at", F.col("payload").cast(PAYLOAD).alias("payload"))
    rows = rows.join(shown.select("match_id", "home_id", "away_id", F.col("format").alias("m_format")), "match_id")
    vouched = known_format(F.col("s_source"), F.col("payload"), F.col("home_id"), F.col("away_id"), F.col("m_format"))
    rows = rows.withColumn("format", vouched).where(F.col("format").isNotNull() | (F.col("s_source") == LIVE))
    result = completed(F.col("payload.maps"), F.col("home_id"), F.col("away_id"), F.col("m_format"))
    rows = rows.withColumn("score", F.when(F.col("s_source") == ARCHIVE, result.cast("struct<home:int,away:int>")).otherwise(F.col("payload.currentScore")))
    whole = (F.col("s_source") == ARCHIVE) & (F.col("s_status") == "finished") & (F.size("payload.maps") > 0)
    when, snap = F.struct("observed_at", "snapshot_id"), F.struct("s_source", "s_status", "observed_at", "snapshot_id", "payload", "format", "score")
    newest = lambda p: F.max_by(snap, F.when(p, when))
    best = rows.groupBy("match_id").agg(
        newest(F.col("s_source") == LIVE).alias("live"),
        newest(whole).alias("archive"),
        newest(F.lit(True)).alias("last"),
        newest(F.size("payload.maps") > 0).alias("detailed"),
    )
    best = best.withColumn("chosen", F.when(F.col("live.s_status") == "walkover", F.col("live")).otherwise(F.coalesce("archive", "last")))
    seen = links.groupBy("match_id", F.col("provider").alias("_provider")).agg(F.max("last_seen_at").alias("last_seen_at"))
    out = shown.join(best, "match_id", "left").where((F.col("source") != RETIRED) | F.col("live").isNotNull())
    out = out.withColumn("_provider", F.coalesce("chosen.s_source", "source")).join(seen, ["match_id", "_provider"], "left")
    status = F.when(F.col("chosen.s_status").isin(*STATUSES), F.col("chosen.s_status")).otherwise("scheduled")
    out = out.withColumn("status", status).withColumn("score", F.when(F.col("status") != "scheduled", F.col("chosen.score")))
    detail = F.coalesce("archive", "detailed")
    out = out.withColumns({c: F.coalesce(F.col(f"chosen.payload.{c}"), detail["payload"][c]) for c in ("patch", "stage")})
    out = out.withColumn("updated_at", F.coalesce("last_seen_at", F.when(F.col("chosen").isNotNull(), F.col("chosen.observed_at")).otherwise(F.col("registered_at"))))
    maps = _maps(rows, out.select("match_id", "status", "home_id", "away_id", "chosen", "archive"))
    named = out.select("match_id", "league_id", "home_id", "away_id", "starts_at", F.coalesce("chosen.format", "format").alias("format"), "status", "score", "patch", "stage", "updated_at")
    return named.join(maps, "match_id", "left").withColumn("maps", F.coalesce("maps", F.array().cast(f"array<{MAP}>")))


def _maps(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(match_id, maps): the maps of each match that may be shown, folded from its snapshots in order, a complete archive's last."""
    chosen = chosen.where(~F.col("status").isin(*WITHOUT_MAPS) & (F.col("chosen.format").isNotNull() | (F.col("chosen.s_source") == LIVE)))
    picked = chosen.select("match_id", "status", F.col("chosen.score").alias("now_score"), F.col("archive.snapshot_id").alias("archive_id"), F.coalesce(F.substring("chosen.format", 3, 1).try_cast("int"), F.lit(5)).alias("most"))
    history = rows.join(picked, "match_id").where((F.col("s_source") != ARCHIVE) | F.col("archive_id").isNull() | (F.col("archive_id") == F.col("snapshot_id")))
    last = (F.col("s_source") == ARCHIVE) & F.col("archive_id").isNotNull()
    seen = history.withColumn("map", F.explode("payload.maps")).withColumn("number", F.col("map.number"))
    teams = F.array_sort(F.array_distinct(F.transform("map.sides", lambda s: s["teamId"])))
    sound = F.col("number").between(1, F.col("most")) & (F.size("map.sides") == 2) & (teams == F.array_sort(F.array("home_id", "away_id")))
    score = F.col("now_score")
    live = (F.col("status") == "live") & F.col("score").eqNullSafe(score) & score.isNotNull() & (F.col("number") == score["home"] + score["away"] + 1)
    seen = seen.where(sound & ((F.col("map.status") != "live") | F.coalesce(live, F.lit(False))))
    dated = F.col("map").withField("bans", distinct_bans(F.col("map.bans"))).withField("updatedAt", F.coalesce("map.updatedAt", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss")))
    kept = folded_maps(seen.select("match_id", "number", F.struct(last.alias("last"), "observed_at").alias("observed_at"), F.col("snapshot_id").alias("id"), dated.alias("map")))
    listed = kept.groupBy("match_id").agg(F.array_sort(F.collect_list("map")).alias("maps")).join(chosen.select("match_id", "home_id", "away_id", F.col("chosen.score").alias("score")), "match_id")
    wins = lambda team: F.size(F.filter("maps", lambda m: m["winnerId"] == F.col(team)))
    beyond = (wins("home_id") > F.col("score.home")) | (wins("away_id") > F.col("score.away"))
    return listed.where(~F.coalesce(beyond, F.lit(False))).select("match_id", "maps")
