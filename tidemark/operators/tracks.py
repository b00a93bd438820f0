"""Tracks: from recognition responses to clean lists, and back from text to links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars

#: Shape of a response; anything may be missing.
RESPONSE = "track struct<title:string,subtitle:string,url:string>, matches array<struct<id:string>>"


def parse_responses(rows: DataFrame, body: str = "response", start: str = "start_s") -> DataFrame:
    """Add title, artist, start_time, start_time_seconds, track_url and match_count from a JSON response.

    A row without a track (missing, null, or a body that is no JSON) has all of them null. Names
    are unknown only where their key is missing; an explicit null stays null.
    """
    track = F.get_json_object(body, "$.track")
    has = F.coalesce(F.size(F.json_object_keys(track)) >= 0, F.lit(False)) & track.isNotNull()
    ids = F.transform(F.from_json(body, RESPONSE)["matches"], lambda m: m["id"])
    count = F.coalesce(scalars.match_count(ids), F.lit(0))
    seconds = F.col(start).cast("double")
    when = lambda value: F.when(has, value)
    return (
        rows.withColumn("title", when(scalars.json_or(track, "title", "Unknown")))
        .withColumn("artist", when(scalars.json_or(track, "subtitle", "Unknown")))
        .withColumn("start_time", when(scalars.hms(seconds)))
        .withColumn("start_time_seconds", when(seconds))
        .withColumn("track_url", when(scalars.json_or(track, "url", "")))
        .withColumn("match_count", when(count).cast("int"))
        .withColumn("found", has)
    )


def attach(segments: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with their responses; a segment without one stays, so that totals are right."""
    return segments.join(responses, keys, "left")


def dedup(tracks: DataFrame, series: list[str], order: str) -> DataFrame:
    """The first track of each key in a series, by segment order. A hot series is spread by its keys."""
    keyed = tracks.withColumn("__key", scalars.track_key(F.col("artist"), F.col("title")))
    first = Window.partitionBy(*series, "__key").orderBy(order)
    return keyed.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__key")


def counts(segments: DataFrame, series: str) -> DataFrame:
    """(series, total_segments, total_tracks_found, unique_tracks)."""
    key = scalars.track_key(F.col("artist"), F.col("title"))
    found = F.col("title").isNotNull() | F.col("artist").isNotNull()
    return segments.groupBy(series).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count(F.when(found, 1)).alias("total_tracks_found"),
        F.count_distinct(F.when(found, key)).alias("unique_tracks"),
    )


def last_url(tracks: DataFrame, file: str, order: str) -> DataFrame:
    """(file, key, url): by 'title - artist', the address of the last track that has the key."""
    key = F.concat_ws(" - ", F.coalesce("title", F.lit("")), F.coalesce("artist", F.lit("")))
    return tracks.groupBy(file, key.alias("key")).agg(F.max_by(F.coalesce("track_url", F.lit("")), order).alias("url"))


def link_lines(lines: DataFrame, tracks: DataFrame, file: str, order: str) -> DataFrame:
    """Text lines with the address of their track; a left join on (file, key), whatever its size."""
    p = scalars.line_parts(F.col("line"))
    keyed = lines.withColumn("key", F.when(p["valid"], F.concat_ws(" - ", p["title"], p["artist"])))
    return keyed.join(last_url(tracks, file, order), [file, "key"], "left")
