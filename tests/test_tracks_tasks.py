"""Responses, dedup, text lines, naming, listing, task files and streams."""

import datetime
import json

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import results, tasks, tracks
from tidemark.sources import files
from tidemark.streaming import tasks as task_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_responses(spark):
    bodies = [
        json.dumps({"track": {"title": "T", "subtitle": "A", "url": "u"}, "matches": [{"id": "1"}, {"id": "1"}, {"id": ""}, {"id": None}, {}, {"id": "2"}]}),
        json.dumps({"track": {}}),
        json.dumps({"track": {"title": None}}),
        json.dumps({"matches": []}),
        json.dumps({"track": None}),
        "no json",
        None,
    ]
    rows = tracks.parse_responses(spark.createDataFrame(list(enumerate(bodies)), "i int, response string").withColumn("start_s", F.lit(3661.9))).orderBy("i").collect()
    assert (rows[0].title, rows[0].artist, rows[0].track_url, rows[0].match_count, rows[0].start_time) == ("T", "A", "u", 2, "01:01:01")
    assert (rows[1].title, rows[1].artist, rows[1].track_url, rows[1].match_count) == ("Unknown", "Unknown", "", 0)
    assert rows[2].title is None and rows[2].artist == "Unknown"
    assert not any(r.found for r in rows[3:]) and all(r.title is None for r in rows[3:])


def test_dedup_keeps_first_and_follows_the_key(spark):
    rows = [(0, "ΑΣ", "x"), (1, "ας", "X"), (2, "a_b", "c"), (3, "a", "b_c"), (4, "İ", "y"), (5, "q", "z"), (6, None, "z"), (7, "unknown", "Z")]
    found = tracks.dedup(spark.createDataFrame(rows, "seg int, artist string, title string").withColumn("s", F.lit(1)), ["s"], "seg")
    assert sorted(r.seg for r in found.collect()) == [0, 2, 4, 5, 6]


def test_text_lines(spark):
    line = scalars.txt_line(F.lit("00:00:01"), F.lit("a - b"), F.lit("c [live] [x]"), F.lit(3))
    assert one(spark, line) == "00:00:01 - a - b - c [live] [x] [3 matches]"
    p = one(spark, scalars.line_parts(line))
    assert (p.valid, p.title, p.artist, p.confidence) == (True, "a", "b - c", " [live]")
    assert not one(spark, scalars.line_parts(F.lit("no parts"))).valid
    html = one(spark, scalars.rendered(F.lit("1 - <b> - c [2 matches]"), F.lit('u"')))
    assert html == '1 - <a href="u&quot;">&lt;b&gt;</a> - c [2 matches]'
    assert one(spark, scalars.txt_path(F.lit("a.json/b.json"))) == "a.txt/b.txt" and one(spark, scalars.txt_path(F.lit("a"))) == "a.txt"
    assert one(spark, scalars.hms(F.lit(360000.0))) == "100:00:00"


def test_progress_lines(spark):
    assert one(spark, scalars.percent(F.lit("[download]  44.5% of ~5%"))) == 44.5
    assert one(spark, scalars.percent(F.lit("[download] n/a% of 5%"))) is None and one(spark, scalars.percent(F.lit("none"))) is None
    assert [one(spark, scalars.percent_text(F.lit(x))) for x in (44.5, 45.5)] == ["44%", "46%"]
    assert one(spark, scalars.download_progress(F.lit(99.0))) == 6 and one(spark, scalars.recognition_progress(F.lit(1), F.lit(3))) == 46


def test_guards(spark):
    assert one(spark, scalars.allowed_extension(F.lit("a.b.MP3"))) and not one(spark, scalars.allowed_extension(F.lit("mp3")))
    assert not one(spark, scalars.too_large(F.lit(500 * 1024 * 1024))) and one(spark, scalars.too_large(F.lit(500 * 1024 * 1024 + 1)))
    assert not one(spark, scalars.too_long(F.lit(0.0))) and not one(spark, scalars.too_long(F.lit(7200.0))) and one(spark, scalars.too_long(F.lit(7200.1)))
    assert [one(spark, scalars.upload_status(F.lit(n), F.lit(1))) for n in ("", "a.txt", "a.mp3")] == [400, 400, 200]
    assert one(spark, scalars.view_status(F.lit(False), F.lit("a.json"))) == 404 and one(spark, scalars.view_status(F.lit(True), F.lit("a.json"))) == 400


def test_names_pass_over_existing(spark):
    asked = spark.createDataFrame([(1, "x.mp3"), (2, "x.wav"), (3, "y.mp3")], "i int, name string")
    there = spark.createDataFrame([("x_tracklist.json",), ("x_tracklist(2).json",), ("other.json",)], "name string")
    found = {r.i: r.json_name for r in results.free_names(asked, there, "name", ["i"]).collect()}
    assert found == {1: "x_tracklist(1).json", 2: "x_tracklist(3).json", 3: "y_tracklist.json"}


def test_files(spark, tmp_path):
    track = {"title": "t", "artist": "a", "track_url": "u", "match_count": 1}
    (tmp_path / "x_tracklist.json").write_text(json.dumps([track, track | {"track_url": "v"}], indent=2))
    (tmp_path / "x_tracklist(1).json").write_text(json.dumps([track]))
    (tmp_path / "bad_tracklist.json").write_text("{not json")
    (tmp_path / "x_tracklist.txt").write_text("00:00:00 - t - a [1 matches]\nplain\n")
    read = files.read_tracklists(spark, str(tmp_path))
    assert read.count() == 3
    lines = files.read_lines(spark, str(tmp_path)).withColumn("file", F.lit(0))
    linked = tracks.link_lines(lines, read.where(F.col("file").endswith("x_tracklist.json")).withColumn("file", F.lit(0)), "file", "pos").orderBy("pos").collect()
    assert [r.url for r in linked] == ["v", None]  # the last of equal tracks
    modified = datetime.datetime(2024, 1, 1, 10, 30)
    rows = spark.createDataFrame([("/o/x_tracklist.json", 2, modified), ("/o/x_tracklist(1).json", 1, modified)], "json_path string, track_count int, modified timestamp")
    texts = spark.createDataFrame([("/o/x_tracklist.txt",)], "path string")
    assert [tuple(r) for r in results.listing(rows, texts).collect()] == [("x", 2, "2024-01-01 10:30", "/o/x_tracklist.json", "/o/x_tracklist.txt")]
    assert files.listing(spark, str(tmp_path), "*.txt").count() == 1


def test_task_files_and_interruption(spark, tmp_path):
    for i, status in enumerate(["pending", "downloading", "processing", "completed", "error"]):
        (tmp_path / f"t{i}.json").write_text(json.dumps({"status": status, "progress": 7, "message": "m"}))
    (tmp_path / "bad.json").write_text("{")
    read = files.read_tasks(spark, str(tmp_path))
    assert read.count() == 5 and tasks.interrupted_count(read).first().interrupted == 3
    after = {r.task_id: (r.status, r.progress) for r in tasks.interrupt(read).collect()}
    assert after == {"t0": ("error", 0), "t1": ("error", 0), "t2": ("error", 0), "t3": ("completed", 7), "t4": ("error", 7)}
    kept = tasks.drop_volatile(read.withColumn("filepath", F.lit("x")).withColumn("_analyzer", F.lit(1)))
    assert kept.columns == read.columns


def test_lookup_prefers_memory(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    memory, disk = spark.createDataFrame([(1, "m")], "id int, status string"), spark.createDataFrame([(1, "d"), (2, "d")], "id int, status string")
    found = {r.id: (r.origin, r.http_status, r.status) for r in tasks.lookup(ids, memory, disk, "id", ["status"]).collect()}
    assert found == {1: ("memory", 200, "m"), 2: ("disk", 200, "d"), 3: (None, 404, None)}


def test_stream_equals_batch(spark, tmp_path):
    schema = "task_id int, seq int, status string"
    for k in range(3):
        spark.createDataFrame([(t, 10 - 3 * k - t % 2, f"s{k}") for t in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = task_stream.run_available(task_stream.latest_stream(stream, "task_id", ["seq"], ["status"]), "task_id", str(tmp_path / "root"))
    assert sorted(found.collect()) == sorted(tasks.latest(batch, "task_id", ["seq"], ["status"]).collect())
    for epoch, rows in enumerate(([(1, "a"), (2, "a")], [(1, "b")])):
        task_stream.upsert(spark.createDataFrame(rows, "task_id int, status string"), epoch, str(tmp_path / "state"))
    assert sorted(map(tuple, task_stream.read_upserts(spark, str(tmp_path / "state"), "task_id").collect())) == [(1, "b"), (2, "a")]


def test_tracklists_round_trip(spark, tmp_path):
    rows = [("a", 1, "T1", "A", "00:00:01", 1.0, "u", 3), ("a", 0, "T0", None, "00:00:00", 0.0, "", 1), ("b", 0, "U \"q\"", "B", "00:00:09", 9.0, "v", None)]
    table = spark.createDataFrame(rows, "task string, seg int, title string, artist string, start_time string, start_time_seconds double, track_url string, match_count int").repartition(3)
    files.write_tracklists(table, str(tmp_path / "json"), "task", "seg")
    back = files.read_tracklists(spark, str(tmp_path / "json"), "*").orderBy("file", "pos").collect()
    assert [(r.pos, r.title, r.artist, r.match_count) for r in back] == [(0, "T0", None, 1), (1, "T1", "A", 3), (0, "U \"q\"", "B", None)]
    one_file = next((tmp_path / "json" / "task=a").glob("*.txt")).read_text()
    assert len(json.loads(one_file)) == 2 and one_file.startswith("[") and "\n  " in one_file
    files.write_lines(table.where("artist is not null"), str(tmp_path / "txt"), "task", "seg")
    lines = files.read_lines(spark, str(tmp_path / "txt")).orderBy("file", "pos").collect()
    assert [r.line for r in lines] == ["00:00:01 - T1 - A [3 matches]", "00:00:09 - U \"q\" - B"]


def test_log_as_batch_and_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.log").write_text("[download]  44.5% of 3MiB\nother\n")
    batch = files.read_log(spark, str(tmp_path / "log"))
    assert sorted(r.line for r in batch.collect()) == ["[download]  44.5% of 3MiB", "other"]
    stream = files.read_log(spark, str(tmp_path / "log"), stream=True).select(scalars.percent(F.col("line")).alias("pct"))
    query = stream.writeStream.format("memory").queryName("log_lines").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(str(r.pct) for r in spark.table("log_lines").collect()) == ["44.5", "None"]


def test_entry_without_a_tokenizer_library():
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = "import sys\nsys.modules['tiktoken'] = None\nimport __spark_entry__ as e\nassert 'segments' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
