"""Logs that grow, and files that are replaced by two-phase commit."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import tasks
from tidemark.sources import files, logs, replace, stores


def drain(spark, folder, work, **options):
    """Lines that a run of the stream brings, over one checkpoint."""
    got = []

    def keep(batch, epoch):
        got.extend((r.file, r.position, r.line) for r in batch.collect())

    stream = logs.follow(spark, f"file://{folder}", **options)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(got)


def test_appended_lines_come_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"
    a.write_bytes(b"one\ntwo\r\nhal")
    b.write_bytes(b"")
    (folder / ".hidden").write_bytes(b"x\n")
    (folder / "other.txt").write_bytes(b"x\n")
    run = lambda: drain(spark, folder, tmp_path, pattern="*.log")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert run() == []
    with a.open("ab") as out:
        out.write(b"f\n\n\xff z\n")
    b.write_bytes(b"begun")
    assert run() == [("a.log", 9, "half"), ("a.log", 14, ""), ("a.log", 15, "� z")]
    b.write_bytes(b"begun\nnext\n")
    (folder / "c.log").write_bytes(b"new\n")
    assert run() == [("b.log", 0, "begun"), ("b.log", 6, "next"), ("c.log", 0, "new")]
    a.write_bytes(b"cut\n")  # shorter: a new file
    assert run() == [("a.log", 0, "cut")]


@pytest.mark.parametrize("split", [1, 5, 64, 1 << 20])
def test_ranges_lose_and_repeat_no_line(spark, tmp_path, split):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = ["x" * (i * 7 % 23) for i in range(60)] + ["long " * 20_000, "", "end"]
    (folder / "a").write_text("".join(f"{x}\n" for x in lines) + "no end")
    reader = logs.LogReader({"path": str(folder), "split": str(max(split, 5000) if split == 1 else split)})
    got = [x for p in reader.partitions({}, reader.latestOffset()) for batch in reader.read(p) for x in batch.column(2).to_pylist()]
    assert got == lines
    if split == 5:
        assert [r[2] for r in drain(spark, folder, tmp_path, split=9000)] == lines


def test_log_feeds_progress(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "t1.log").write_text("[download] Destination: x\n[download]  45.5% of 5MiB\n[ExtractAudio] y\n")
    from tidemark.functions import scalars

    out = []
    stream = logs.follow(spark, str(folder)).select("position", scalars.log_kind(F.col("line")).alias("kind"), scalars.percent(F.col("line")).alias("pct"))
    stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [(r.kind, r.pct) for r in sorted(out)] == [("destination", None), ("progress", 45.5), ("convert", None)]


def test_replaced_files(spark, tmp_path):
    path = f"file://{tmp_path}/tasks"
    first = spark.createDataFrame([("a", "pending", 0, "/tmp/x"), ("b", "processing", 30, None)], "task_id string, status string, progress int, filepath string")
    replace.upsert_tasks(first, path)
    replace.upsert_tasks(spark.createDataFrame([("a", "completed", 100, None), ("c", "pending", None, None)], first.schema), path)
    names = stores.names(*stores.of(path))
    assert set(names) == {"a.json", "b.json", "c.json"} and replace.leftovers(path) == []
    assert json.loads((tmp_path / "tasks/a.json").read_text()) == {"status": "completed", "progress": 100}
    read = {r.task_id: (r.status, r.progress) for r in files.read_tasks(spark, path).collect()}
    assert read == {"a": ("completed", 100), "b": ("processing", 30), "c": ("pending", None)}
    replace.upsert_tasks(tasks.interrupt(files.read_tasks(spark, path)), path)  # the boot repair, over the files that it reads
    read = {r.task_id: (r.status, r.message) for r in files.read_tasks(spark, path).collect()}
    assert read == {"a": ("completed", None), "b": ("error", model.INTERRUPTED), "c": ("error", model.INTERRUPTED)}


def test_a_failed_task_leaves_old_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(8, numPartitions=4).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit("old").alias("text"))
    replace.replace_files(rows, path, F.col("name"), F.col("text"))

    @F.udf("string")
    def fails(name):
        if name == "7.txt":
            raise RuntimeError("no")
        return "new"

    with pytest.raises(Exception, match="no"):
        replace.replace_files(rows, path, F.col("name"), fails("name"))
    assert {p.read_text() for p in (tmp_path / "out").glob("*.txt")} == {"old"}
    with pytest.raises(Exception, match="no file name"):
        replace.replace_files(spark.createDataFrame([("../x", "y")], "name string, text string"), path, F.col("name"), F.col("text"))
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_file()]) == 8


def test_a_task_that_runs_twice(tmp_path):
    """Only what is committed is moved; what an attempt left behind goes."""
    import pyarrow as pa

    writer = replace.FilesWriter(str(tmp_path))
    batch = lambda text: iter([pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([text])], ["name", "text"])])
    writer.write(batch("lost"))
    kept = writer.write(batch("kept"))
    writer.commit([kept, None])
    assert (tmp_path / "a").read_text() == "kept" and replace.leftovers(str(tmp_path)) == []


def test_tracklists_round_trip(spark, tmp_path):
    track = lambda i, t: (t, i, f"title {i}", "artist é", "00:00:01", 1.0, None if i else "u", i)
    schema = "file string, pos int, title string, artist string, start_time string, start_time_seconds double, track_url string, match_count int"
    rows = spark.createDataFrame([track(i, t) for t in ("x_tracklist.json", "y_tracklist.json") for i in (2, 0, 1)], schema)
    replace.write_tracklists(rows, str(tmp_path), "file", "pos")
    back = files.read_tracklists(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r.file.rsplit("/", 1)[1], r.pos, r.title, r.track_url) for r in back] == [(f, i, f"title {i}", None if i else "u") for f in ("x_tracklist.json", "y_tracklist.json") for i in range(3)]


def test_appended_events(spark, tmp_path):
    path = str(tmp_path / "events")
    for k in range(2):
        files.append_events(spark.createDataFrame([("a", k, f"s{k}")], "task_id string, seq int, status string"), path)
    assert [tuple(r) for r in tasks.latest(spark.read.parquet(path), "task_id", ["seq"], ["status"]).collect()] == [("a", "s1")]


def test_many_task_files_need_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.json").write_text(f'{{"status": "pending", "progress": {i}}}')
    for name, text in {"a b%20.json": '{"progress": -1}', "empty.json": "", "_x.json": "{}", "x.txt": "{}", "corrupt.json": "{"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "folder.json").mkdir()
    read = files.read_tasks(spark, f"file://{tmp_path}")
    assert read.rdd.getNumPartitions() == 4  # the session's, whatever the number of files
    assert {r.task_id: r.progress for r in read.collect()} == {str(i): i for i in range(300)} | {"a b%20": -1}
    assert files.read_tasks(spark, f"{tmp_path}/1?.json").count() == 10
    assert files.whole_texts(spark, str(tmp_path), "{1,a}*.json").count() == 112


def test_many_logs_need_few_tasks(tmp_path):
    for i in range(200):
        (tmp_path / f"{i:03}.log").write_text(f"a {i}\nb {i}\nhalf")
    reader = logs.LogReader({"path": str(tmp_path)})
    shares = reader.partitions({}, reader.latestOffset())
    assert len(shares) <= 4
    lines = [x for s in shares for batch in reader.read(s) for x in batch.column(2).to_pylist()]
    assert lines == [f"{x} {i}" for i in range(200) for x in "ab"]
    later = reader.partitions(reader.latestOffset() | {"007.log": 4}, reader.latestOffset())
    assert [x for s in later for batch in reader.read(s) for x in batch.column(2).to_pylist()] == ["b 7"]
