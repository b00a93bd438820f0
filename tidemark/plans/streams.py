"""Queries of tasks, logs and result files: state machines in batch and stream, and files that are written and read again.

What is written goes to a new place in the folder that executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalars
from tidemark.operators import recognize, results, signal, tasks
from tidemark.sources import files, logs, replace
from tidemark.streaming import lifecycle
from tidemark.streaming import tasks as task_stream

#: How late events may come.
LATE = "2 hours"
_KINDS = {"signup": "pending", "view": "downloading", "click": "processing", "purchase": "completed", "error": "error"}


def _history(events: DataFrame) -> DataFrame:
    """Events as those of tasks: one task for each user and three days."""
    status = F.coalesce(*[F.when(F.col("event_type") == k, s) for k, s in _KINDS.items()])
    task = F.col("user_id") * 100 + F.floor((F.dayofmonth("ts") - 1) / 3)
    return events.select(task.cast("long").alias("task_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), status.alias("status"), F.pmod("event_id", F.lit(101)).cast("int").alias("progress"), F.concat(F.lit("event "), F.col("event_id")).alias("message"))


def _watermark(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("at") - F.expr(f"INTERVAL {LATE}")).first()[0]


def task_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks through their state machine; those still open are swept as of the stream's last watermark."""
    history = _history(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return tasks.lifecycle(history, "task_id", F.lit(_watermark(history)))


def task_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream of the table, with keyed state and timers."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = _history(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))
    timed = source.withColumn("at", F.col("at").cast("timestamp"))
    with lifecycle.state_store(spark):
        out = task_stream.run_available(lifecycle.states(timed, "task_id", LATE), "task_id", task_stream.state_root(spark))
    return out.withColumn("at", F.col("at").cast("timestamp_ntz")).select("task_id", "status", "progress", "message", "at", "seq", "accepted", "refused")


def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written to a file each, replaced by later states, and read again, interrupted ones marked."""
    history, folder = _history(spark.read.parquet(f"{sf_dir}/events.parquet")), task_stream.state_root(spark)
    for until in (5, 31):  # the second write replaces files of the first
        last = tasks.latest(history.where(F.dayofmonth("at") <= until), "task_id", ["at", "seq"], ["status", "progress", "message"])
        replace.upsert_tasks(last.withColumn("filepath", F.lit("gone")).withColumn("task_id", F.col("task_id").cast("string")), folder)
    back = tasks.interrupt(files.read_tasks(spark, folder))
    return back.select(F.col("task_id").cast("long").alias("task_id"), "status", "progress", "message", "error")


def log_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaders' logs, of 500 lines a file, followed as a stream and parsed."""
    events, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), task_stream.state_root(spark)
    line = F.when(F.col("event_type") == "view", F.format_string("[download] %s%% of 5.23MiB", F.pmod("event_id", F.lit(101)).cast("string"))).when(F.col("event_type") == "click", F.lit("[ExtractAudio] x")).otherwise(F.col("event_type"))
    rows = events.select((F.col("event_id") / 500).cast("long").alias("part"), F.struct("event_id", line.alias("line")).alias("e"))
    texts = rows.groupBy("part").agg(F.sort_array(F.collect_list("e")).alias("all"))
    replace.replace_files(texts, f"{folder}/logs", F.format_string("%09d.log", "part"), F.concat(F.array_join("all.line", "\n"), F.lit("\n")))
    stream = logs.follow(spark, f"{folder}/logs", "*.log")
    stream.writeStream.format("parquet").option("path", f"{folder}/lines").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("file string, position long, line string").parquet(f"{folder}/lines")
    return found.select("file", "position", scalars.log_kind(F.col("line")).alias("kind"), scalars.percent(F.col("line")).alias("pct"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks, a hundred to a list."""
    name = F.format_string("set%06d_tracklist", (F.col("p_partkey") / 100).cast("long"))
    seconds = F.col("p_partkey").cast("double") % 100 * 30
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        name.alias("name"), "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), scalars.hms(seconds).alias("start_time"), seconds.alias("start_time_seconds"), F.when(F.col("p_size") % 3 > 0, F.lit("u")).alias("track_url"), F.col("p_size").alias("match_count")
    )


def tracklist_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklists as JSON, written and read again."""
    folder = task_stream.state_root(spark)
    replace.write_tracklists(_tracks(spark, sf_dir).withColumn("name", F.concat("name", F.lit(".json"))), folder, "name", "p_partkey")
    return files.read_tracklists(spark, folder).withColumn("file", scalars.base_name(F.col("file"))).withColumn("pos", F.col("pos").cast("int"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklists as text, written by task and read again."""
    folder = task_stream.state_root(spark)
    files.write_lines(_tracks(spark, sf_dir), folder, "name", "p_partkey")
    back = files.read_lines(spark, f"{folder}/name=*")
    return back.select(F.regexp_extract("file", "name=([^/]*)", 1).alias("name"), F.col("pos").cast("int").alias("pos"), "line")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the lists of even numbers as JSON, and those that three does not divide as text."""
    folder, tracks = task_stream.state_root(spark), _tracks(spark, sf_dir)
    number = (F.col("p_partkey") / 100).cast("long")
    replace.write_tracklists(tracks.where(number % 2 == 0).withColumn("name", F.concat("name", F.lit(".json"))), folder, "name", "p_partkey")
    line = scalars.txt_line(F.col("start_time"), F.col("title"), F.col("artist"), F.col("match_count"))
    texts = tracks.where(number % 3 != 0).groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    replace.replace_files(texts, folder, F.concat("name", F.lit(".txt")), F.col("text"))
    return folder


def view_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the asked files can be viewed, and with which list of addresses."""
    there = files.listing(spark, _stored(spark, sf_dir)).select(scalars.base_name(F.col("path")).alias("name"))
    lists = _tracks(spark, sf_dir).select("name").distinct()
    asked = lists.select(F.explode(F.array(F.concat("name", F.lit(".txt")), F.concat("name", F.lit(".json")))).alias("name"))
    return results.views(asked, there)


def result_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results with their text files, and the sizes of both."""
    folder = _stored(spark, sf_dir)
    there = files.listing(spark, folder)
    counts = files.read_tracklists(spark, folder).groupBy(F.col("file").alias("json_path")).agg(F.count(F.lit(1)).alias("track_count"))
    plain = there.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    own = counts.withColumn("json_path", F.regexp_replace("json_path", "^file:/+", "/")).join(plain.select(F.col("path").alias("json_path"), "modified"), "json_path")
    found = results.listing(own, plain.where(F.col("path").endswith(".txt")))
    sized = found.join(plain.select(F.col("path").alias("txt_path"), F.col("size").alias("txt_bytes")), "txt_path", "left")
    return sized.select("filename", "track_count", scalars.base_name(F.col("json_path")).alias("json_name"), scalars.base_name(F.col("txt_path")).alias("txt_name"), "txt_bytes")


def slice_recognize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of two chunks, cut into segments across the chunks' border, each recognised by its number of samples and their sum."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("series_id"), "embedding")
    half = lambda k: F.struct(F.lit(k).alias("chunk"), F.lit(1).alias("sr"), F.lit(32 * k).cast("long").alias("start"), F.slice("embedding", 32 * k + 1, 32).alias("samples"))
    parts = rows.select("series_id", F.explode(F.array(half(0), half(1))).alias("c")).select("series_id", "c.*")
    cut = F.pmod(F.col("series_id").cast("long"), F.lit(40)) + 10
    bounds = rows.select("series_id", F.array(F.lit(0).cast("long"), cut, F.lit(64).cast("long")).alias("bounds"))
    found = signal.segments(bounds, "series_id", "bounds", F.lit(1))
    pieces = signal.slice_segments(parts, found).groupBy("series_id", "seg").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "samples"))), lambda p: p["samples"])).alias("samples"))
    whole = pieces.join(found.select("series_id", "seg", "start_s"), ["series_id", "seg"])
    answers = recognize.recognize(whole, _counted)
    n = F.get_json_object("response", "$.matches[0].id").cast("int")
    total = F.round(F.get_json_object("response", "$.matches[1].id").cast("double"), 6)
    return answers.select(F.col("series_id").cast("long").alias("vec_id"), "seg", "start_s", n.alias("n"), total.alias("total"))


def _counted(samples: list[float], start: float) -> dict:
    return {"track": {"title": "x"}, "matches": [{"id": len(samples)}, {"id": sum(samples)}]}


QUERIES = {f.__name__: f for f in (task_lifecycle, task_lifecycle_stream, task_files, log_follow, tracklist_files, text_files, view_files, result_listing, slice_recognize)}

_HISTORY = f"""history AS (
    SELECT user_id * 100 + (day(ts) - 1) // 3 AS task_id, ts AS "at", event_id AS seq,
           CASE event_type {" ".join(f"WHEN '{k}' THEN '{s}'" for k, s in _KINDS.items())} END AS status, (event_id % 101)::INT AS progress, 'event ' || event_id AS message
    FROM events)"""

_OPEN = ", ".join(f"'{s}'" for s in model.OPEN_STATUS)
_MAY = " OR ".join(f"(f.status {'IS NULL' if s is None else f"= '{s}'"} AND e.status IN ({', '.join(repr(t) for t in after)}))" for s, after in model.TRANSITIONS.items() if after)

# a fold, event by event
_LIFECYCLE = f"""WITH RECURSIVE {_HISTORY}, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY "at", seq) AS nth FROM history
), fold AS (
    SELECT DISTINCT task_id, 0::BIGINT AS nth, NULL::VARCHAR AS status, NULL::INT AS progress, NULL::VARCHAR AS message, NULL::TIMESTAMP AS "at", NULL::BIGINT AS seq, 0::BIGINT AS accepted, 0::BIGINT AS refused FROM history
    UNION ALL
    SELECT task_id, nth, CASE WHEN good THEN new_status WHEN stale THEN 'error' ELSE status END, CASE WHEN good THEN new_progress WHEN stale THEN 0 ELSE progress END,
           CASE WHEN good THEN new_message WHEN stale THEN '{model.INTERRUPTED}' ELSE message END, CASE WHEN good THEN new_at WHEN stale THEN "at" + INTERVAL 24 HOURS ELSE "at" END,
           CASE WHEN good THEN new_seq ELSE seq END, accepted + good::BIGINT, refused + (NOT good)::BIGINT
    FROM (SELECT *, may AND NOT stale AS good FROM (
        SELECT f.*  REPLACE (f.nth + 1 AS nth), e.status AS new_status, e.progress AS new_progress, e.message AS new_message, e.at AS new_at, e.seq AS new_seq, coalesce({_MAY}, false) AS may,
               coalesce({_MAY}, false) AND coalesce(f.status IN ({_OPEN}) AND e.at > f.at + INTERVAL 24 HOURS, false) AS stale
        FROM fold f JOIN numbered e ON e.task_id = f.task_id AND e.nth = f.nth + 1))
), last AS (
    SELECT *, coalesce(status IN ({_OPEN}) AND (SELECT max(ts) - INTERVAL {LATE} FROM events) > "at" + INTERVAL 24 HOURS, false) AS swept FROM fold QUALIFY nth = max(nth) OVER (PARTITION BY task_id)
)
SELECT task_id, CASE WHEN swept THEN 'error' ELSE status END AS status, CASE WHEN swept THEN 0 ELSE progress END AS progress, CASE WHEN swept THEN '{model.INTERRUPTED}' ELSE message END AS message,
       CASE WHEN swept THEN "at" + INTERVAL 24 HOURS ELSE "at" END AS "at", seq, accepted, refused FROM last"""

_TRACKS = """tracks AS (
    SELECT printf('set%06d_tracklist', p_partkey // 100) AS name, p_partkey, p_name AS title, p_brand AS artist, p_partkey % 100 * 30 AS s, CASE WHEN p_size % 3 > 0 THEN 'u' END AS track_url, p_size AS match_count,
           (row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1)::INT AS pos FROM part
), timed AS (SELECT *, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS start_time FROM tracks)"""

SQL = {
    "task_lifecycle": _LIFECYCLE,
    "task_lifecycle_stream": _LIFECYCLE,
    "task_files": f"""WITH {_HISTORY}, last AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY "at" DESC, seq DESC) = 1)
        SELECT task_id, CASE WHEN status IN ({_OPEN}) THEN 'error' ELSE status END AS status, CASE WHEN status IN ({_OPEN}) THEN 0 ELSE progress END AS progress,
               CASE WHEN status IN ({_OPEN}) THEN '{model.INTERRUPTED}' ELSE message END AS message, CASE WHEN status IN ({_OPEN}) THEN '{model.INTERRUPTED_ERROR}' END AS error FROM last""",
    "log_follow": """WITH lines AS (
            SELECT event_id, CASE event_type WHEN 'view' THEN printf('[download] %d%% of 5.23MiB', event_id % 101) WHEN 'click' THEN '[ExtractAudio] x' ELSE event_type END AS line, event_type FROM events)
        SELECT printf('%09d.log', event_id // 500) AS file, (sum(strlen(line) + 1) OVER (PARTITION BY event_id // 500 ORDER BY event_id) - strlen(line) - 1)::BIGINT AS position,
               CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'convert' ELSE 'other' END AS kind, CASE WHEN event_type = 'view' THEN (event_id % 101)::DOUBLE END AS pct FROM lines""",
    "tracklist_files": f"WITH {_TRACKS} SELECT name || '.json' AS file, pos, title, artist, start_time, s::DOUBLE AS start_time_seconds, track_url, match_count FROM timed",
    "text_files": f"WITH {_TRACKS} SELECT name, pos, start_time || ' - ' || title || ' - ' || artist || ' [' || match_count || ' matches]' AS line FROM timed",
    "view_files": """WITH lists AS (SELECT DISTINCT p_partkey // 100 AS k, printf('set%06d_tracklist', p_partkey // 100) AS name FROM part)
        SELECT name || '.txt' AS name, CASE WHEN k % 3 <> 0 THEN 200 ELSE 404 END AS http_status, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN name || '.json' END AS json_name FROM lists
        UNION ALL SELECT name || '.json', CASE WHEN k % 2 = 0 THEN 400 ELSE 404 END, NULL FROM lists""",
    "result_listing": f"""WITH {_TRACKS}, lines AS (SELECT name, p_partkey // 100 AS k, start_time || ' - ' || title || ' - ' || artist || ' [' || match_count || ' matches]' AS line FROM timed)
        SELECT replace(name, '_tracklist', '') AS filename, count(*)::BIGINT AS track_count, name || '.json' AS json_name, CASE WHEN k % 3 <> 0 THEN name || '.txt' ELSE '' END AS txt_name,
               CASE WHEN k % 3 <> 0 THEN (sum(strlen(line)) + count(*) - 1)::BIGINT END AS txt_bytes FROM lines WHERE k % 2 = 0 GROUP BY name, k""",
    "slice_recognize": """WITH cut AS (SELECT vec_id, embedding, vec_id % 40 + 10 AS cut FROM embeddings
        ), two AS (SELECT vec_id, 0 AS seg, 0.0::DOUBLE AS start_s, embedding[1:cut] AS own FROM cut UNION ALL SELECT vec_id, 1, cut::DOUBLE, embedding[cut + 1:] FROM cut)
        SELECT vec_id, seg, start_s, len(own)::INT AS n, round(list_sum([x::DOUBLE FOR x IN own]), 6) AS total FROM two""",
}
