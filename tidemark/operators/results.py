"""Result files: listing, naming, siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalars


def recent(listing: DataFrame, created: Column, tie: list[Column], n: int = model.RECENT) -> DataFrame:
    """The newest results by creation minute; equal minutes by ``tie``. Planned as a top-n, not a sort."""
    minute = F.date_format(created, "yyyy-MM-dd HH:mm")
    return listing.withColumn("created", minute).orderBy(F.col("created").desc(), *tie).limit(n)


def first_match(files: DataFrame, wanted: DataFrame, task: str) -> DataFrame:
    """(task, path): of the files that start with the task's ``prefix`` and end in .mp3 the first by name; null where there is none.

    The prefix is a time stamp of 16 characters, so this is an equality join on it.
    """
    named = files.withColumn("__name", scalars.base_name(F.col("path"))).where(F.col("__name").endswith(".mp3"))
    keyed = named.groupBy(F.substring("__name", 1, 16).alias("__prefix")).agg(F.min_by("path", "__name").alias("path"))
    return wanted.join(keyed, F.col("prefix") == F.col("__prefix"), "left").select(task, "path")


def listing(results: DataFrame, texts: DataFrame) -> DataFrame:
    """(filename, track_count, created, json_path, txt_path) from readable result files and the text files there are.

    Only names that end in _tracklist.json are listed, so a repeated analysis, x_tracklist(1), is not.
    """
    own = results.where(F.col("json_path").endswith("_tracklist.json"))
    sibling = F.regexp_replace("json_path", "\\.json$", ".txt")
    there = texts.select(F.col("path").alias("__path")).distinct()
    joined = own.join(there, sibling == F.col("__path"), "left")
    return joined.select(
        scalars.display_name(F.col("json_path")).alias("filename"), "track_count", F.date_format("modified", "yyyy-MM-dd HH:mm").alias("created"), "json_path", F.coalesce("__path", F.lit("")).alias("txt_path")
    )


def views(asked: DataFrame, there: DataFrame) -> DataFrame:
    """(name, http_status, json_name) from asked (name) and the files there are (name).

    json_name is the list of the same name with every .txt replaced, where it exists: without it, lines
    are shown without addresses. Existence comes before the kind of file.
    """
    names = there.select(F.col("name").alias("__there")).distinct()
    known = asked.join(names, F.col("name") == F.col("__there"), "left")
    status = scalars.view_status(F.col("__there").isNotNull(), F.col("name"))
    json = names.withColumnRenamed("__there", "__json")
    joined = known.withColumn("http_status", status).join(json, F.replace(F.col("name"), F.lit(".txt"), F.lit(".json")) == F.col("__json"), "left")
    return joined.select("name", "http_status", F.when(F.col("http_status") == 200, F.col("__json")).alias("json_name"))


def unique_names(requests: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add json_name: x_tracklist.json, then (1), (2), ... for the same stem, in order."""
    stem = scalars.stem(F.col(name))
    nth = F.row_number().over(Window.partitionBy("__stem").orderBy(*order)) - 1
    numbered = requests.withColumn("__stem", stem).withColumn("__nth", nth)
    suffix = F.when(F.col("__nth") == 0, "").otherwise(F.concat(F.lit("("), F.col("__nth").cast("string"), F.lit(")")))
    return numbered.withColumn("json_name", F.concat("__stem", F.lit("_tracklist"), suffix, F.lit(".json"))).drop("__stem", "__nth")


def free_names(requests: DataFrame, existing: DataFrame, name: str, order: list[str]) -> DataFrame:
    """As :func:`unique_names`, passing over names that exist already.

    The k-th request of a stem takes the k-th free number: numbers up to requests plus existing
    files of the stem are laid out, taken ones removed by an anti-join, and the rest matched by rank.
    """
    asked = requests.withColumn("__stem", scalars.stem(F.col(name))).withColumn("__nth", F.row_number().over(Window.partitionBy("__stem").orderBy(*order)))
    parsed = existing.select(F.regexp_extract("name", "^(.*)_tracklist(?:\\((\\d+)\\))?\\.json$", 1).alias("__stem"), F.coalesce(F.nullif(F.regexp_extract("name", "_tracklist\\((\\d+)\\)\\.json$", 1), F.lit("")), F.lit("0")).cast("long").alias("__number")).distinct()
    many = asked.groupBy("__stem").agg(F.count(F.lit(1)).alias("__asked")).join(parsed.groupBy("__stem").agg(F.count(F.lit(1)).alias("__there")), "__stem", "left")
    numbers = many.select("__stem", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__asked") + F.coalesce("__there", F.lit(0)))).alias("__number"))
    free = numbers.join(parsed, ["__stem", "__number"], "left_anti")
    ranked = free.withColumn("__nth", F.row_number().over(Window.partitionBy("__stem").orderBy("__number")))
    joined = asked.join(ranked, ["__stem", "__nth"])
    suffix = F.when(F.col("__number") == 0, "").otherwise(F.concat(F.lit("("), F.col("__number").cast("string"), F.lit(")")))
    return joined.withColumn("json_name", F.concat("__stem", F.lit("_tracklist"), suffix, F.lit(".json"))).drop("__stem", "__nth", "__number")
