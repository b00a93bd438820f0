"""Scalar rules: parameters by length, formats, tiers, guards, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import model


def auto_min_duration(seconds: Column) -> Column:
    """Least segment length by signal length; an exact hour belongs to the next tier."""
    return F.when(seconds < 3600, 30).when(seconds < 7200, 45).when(seconds < 10800, 60).otherwise(90).cast("int")


def auto_threshold(seconds: Column) -> Column:
    """Peak threshold by signal length."""
    return F.when(seconds < 3600, 0.30).when(seconds < 7200, 0.25).when(seconds < 10800, 0.20).otherwise(0.15)


def override(manual: Column, auto: Column) -> Column:
    """A manual value unless it is null or zero."""
    return F.coalesce(F.nullif(manual, F.lit(0)), auto)


def hms(seconds: Column) -> Column:
    """HH:MM:SS, cut to whole seconds; hours may have more digits."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60)))


def confidence(matches: Column) -> Column:
    """Fewer distinct matches are surer."""
    return F.when(matches <= 5, "high").when(matches <= 15, "medium").otherwise("low")


def valid_ids(ids: Column) -> Column:
    """Match ids that count: not null, empty, zero or false (as text or as themselves)."""
    return F.filter(ids, lambda x: x.isNotNull() & ~x.cast("string").isin("", "0", "0.0", "false"))


def match_count(ids: Column) -> Column:
    """Distinct valid ids."""
    return F.size(F.array_distinct(valid_ids(ids)))


def duplicate_ids(ids: Column) -> Column:
    """Valid ids beyond the distinct ones."""
    return F.size(valid_ids(ids)) - match_count(ids)


def json_or(document: Column, key: str, default: str) -> Column:
    """A key's text in a JSON object; the default only where the key is missing, null where it is null."""
    missing = ~F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))
    return F.when(missing, default).otherwise(F.get_json_object(document, f"$.{key}"))


def track_key(artist: Column, title: Column) -> Column:
    """What makes two tracks the same: lower-cased artist and title; a null counts as unknown."""
    known = lambda c: F.lower(F.coalesce(c, F.lit("Unknown")))
    return F.concat(known(artist), F.lit("_"), known(title))


def txt_line(start: Column, title: Column, artist: Column, matches: Column) -> Column:
    """A line of a text tracklist; the count only where there is one."""
    head = F.concat_ws(" - ", start, title, artist)
    return F.when(matches.isNull(), head).otherwise(F.concat(head, F.format_string(" [%d matches]", matches)))


def txt_path(json_path: Column) -> Column:
    """The text file beside a JSON file; a path without .json gets .txt added."""
    return F.when(F.instr(json_path, ".json") > 0, F.replace(json_path, F.lit(".json"), F.lit(".txt"))).otherwise(F.concat(json_path, F.lit(".txt")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """A file's name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")


def display_name(path: Column) -> Column:
    return F.replace(stem(path), F.lit("_tracklist"), F.lit(""))


def line_parts(line: Column) -> Column:
    """time, title, artist, confidence, valid of a text line: three parts by ' - ', the last cut at ' ['."""
    text = F.trim(line, F.lit(" \t\n\r\x0b\x0c"))
    parts = F.split(text, " - ", 3)
    last = F.get(parts, F.lit(2))
    cut = F.split(last, " \\[", -1)
    return F.struct(
        (F.size(parts) >= 3).alias("valid"),
        F.get(parts, F.lit(0)).alias("time"),
        F.get(parts, F.lit(1)).alias("title"),
        F.get(cut, F.lit(0)).alias("artist"),
        F.when(F.size(cut) > 1, F.concat(F.lit(" ["), F.get(cut, F.lit(1)))).otherwise("").alias("confidence"),
    )


def escape(text: Column) -> Column:
    """Text that is safe inside HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def rendered(line: Column, url: Column) -> Column:
    """A line of the view: a link where there is an address, else the line itself, escaped either way."""
    p = line_parts(line)
    link = F.concat(escape(p["time"]), F.lit(' - <a href="'), escape(url), F.lit('">'), escape(p["title"]), F.lit("</a> - "), escape(p["artist"]), escape(p["confidence"]))
    return F.when(p["valid"] & (F.coalesce(url, F.lit("")) != ""), link).otherwise(escape(line))


def allowed_extension(name: Column) -> Column:
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*model.EXTENSIONS)


def too_large(size: Column) -> Column:
    return size > model.MAX_FILE_BYTES


def too_long(seconds: Column, cap: float = model.MAX_DURATION_S) -> Column:
    """Longer than the cap; an unknown duration (null or 0) passes."""
    return F.coalesce((seconds != 0) & (seconds > cap), F.lit(False))


def upload_status(name: Column, size: Column) -> Column:
    """HTTP status of an upload, first rule first."""
    return F.when(F.coalesce(name, F.lit("")) == "", 400).when(~allowed_extension(name), 400).when(too_large(size), 413).otherwise(200)


def download_status(known: Column, status: Column, kind: Column, exists: Column) -> Column:
    """HTTP status of a result download: unknown task, not completed, wrong format, no file."""
    return F.when(~known, 404).when(status != "completed", 400).when(~kind.isin("json", "txt"), 400).when(~exists, 404).otherwise(200)


def view_status(exists: Column, name: Column) -> Column:
    """HTTP status of a view: existence comes before the kind of file."""
    return F.when(~exists, 404).when(~name.endswith(".txt"), 400).otherwise(200)


def percent(line: Column) -> Column:
    """The last word before the first % sign, as a number; null where it is none."""
    word = F.regexp_extract(F.split_part(line, F.lit("%"), F.lit(1)), "(\\S+)\\s*$", 1)
    return F.when(F.instr(line, "%") > 0, word.try_cast("double"))


def log_kind(line: Column) -> Column:
    """What a downloader's log line reports."""
    return (
        F.when(line.contains("[download]") & line.contains("%"), "progress")
        .when(line.contains("[ExtractAudio]") | line.contains("Post-process"), "convert")
        .when(line.contains("Destination:"), "destination")
        .otherwise("other")
    )


def download_progress(pct: Column) -> Column:
    return 2 + (pct * 0.05).cast("int")


def recognition_progress(current: Column, total: Column) -> Column:
    return 25 + F.try_divide(current * 65, total).cast("int")


def percent_text(pct: Column) -> Column:
    """A percentage without decimals, halves to even."""
    return F.concat(F.bround(pct, 0).cast("long").cast("string"), F.lit("%"))


def minutes(seconds: Column) -> Column:
    """Whole minutes, rounded down."""
    return F.floor(seconds / 60).cast("int")


def too_long_text(seconds: Column, cap: float = model.MAX_DURATION_S) -> Column:
    """What an overlong file is told; null for others."""
    return F.when(too_long(seconds, cap), F.format_string(model.TOO_LONG, minutes(seconds), F.lit(int(cap // 60))))


def url_status(url: Column, given: Column) -> Column:
    """HTTP status of an address request: the key missing, an empty address, accepted."""
    return F.when(~given, 422).when(F.coalesce(url, F.lit("")) == "", 400).otherwise(200)


def upload_name(name: Column, now: Column) -> Column:
    """The name under which an upload is stored: its time to the second, and its own name."""
    return F.concat(F.date_format(now, "yyyyMMdd_HHmmss"), F.lit("_"), name)


def iso_time(now: Column) -> Column:
    """A time in ISO form; microseconds only where there are any."""
    whole = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(now, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def task_id() -> Column:
    """A random name for a task."""
    return F.uuid()


def served_status(exists: Column) -> Column:
    """HTTP status of a stored file."""
    return F.when(exists, 200).otherwise(404)


def progress_event(kind: Column, pct: Column, current: Column, total: Column) -> Column:
    """progress and status of a task after an event; pct and current of total count where the event has them."""
    progress = F.when(kind == "download", download_progress(pct)).when(kind == "recognise", recognition_progress(current, total))
    for name, value in model.PROGRESS.items():
        progress = progress.when(kind == name, value)
    status = F.when(kind.isin("url", "start_download", "download", "destination", "convert"), "downloading").when(kind == "done", "completed").when(kind == "failed", "error").otherwise("processing")
    return F.struct(progress.cast("int").alias("progress"), status.alias("status"))
