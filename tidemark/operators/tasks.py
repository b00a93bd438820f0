"""Task state: an append-only log of events, its latest state, and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model

def latest(events: DataFrame, task: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each task: an aggregate with partial states, so no task's history is gathered."""
    state = F.max_by(F.struct(*columns), F.struct(*order)).alias("__state")
    return events.groupBy(task).agg(state).select(task, "__state.*")


def interrupt(tasks: DataFrame) -> DataFrame:
    """Tasks that were under way become errors; others stay."""
    open_task = F.col("status").isin(*model.OPEN_STATUS)
    return (
        tasks.withColumn("progress", F.when(open_task, 0).otherwise(F.col("progress")))
        .withColumn("message", F.when(open_task, model.INTERRUPTED).otherwise(F.col("message")))
        .withColumn("error", F.when(open_task, model.INTERRUPTED_ERROR).otherwise(F.col("error")))
        .withColumn("status", F.when(open_task, "error").otherwise(F.col("status")))
    )


def interrupted_count(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count(F.when(F.col("status").isin(*model.OPEN_STATUS), 1)).alias("interrupted"))


def stale(files: DataFrame, modified: Column, now: Column, hours: int = model.STALE_HOURS) -> DataFrame:
    """Files older than so many hours; exactly as old stays."""
    return files.where(modified < now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def swept_count(files: DataFrame, modified: Column, now: Column, hours: int = model.STALE_HOURS) -> DataFrame:
    """How many files a sweep removes."""
    return stale(files, modified, now, hours).agg(F.count(F.lit(1)).alias("swept"))


def lookup(asked: DataFrame, memory: DataFrame, disk: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each asked key's state, from memory, else from disk, with the HTTP status: 404 where neither has it."""
    m = memory.select(F.col(key), F.struct(*columns).alias("__memory"))
    d = disk.select(F.col(key), F.struct(*columns).alias("__disk"))
    joined = asked.join(m, key, "left").join(d, key, "left").withColumn("__state", F.coalesce("__memory", "__disk"))
    origin = F.when(F.col("__memory").isNotNull(), "memory").when(F.col("__disk").isNotNull(), "disk")
    return joined.select(key, origin.alias("origin"), F.when(F.col("__state").isNull(), 404).otherwise(200).alias("http_status"), "__state.*")


def drop_volatile(tasks: DataFrame) -> DataFrame:
    return tasks.drop(*model.VOLATILE_KEYS)


def tail(lines: DataFrame, task: str, order: str, n: int = 5) -> DataFrame:
    """The last n lines of each task; the rank limit applies before the shuffle."""
    back = Window.partitionBy(task).orderBy(F.col(order).desc())
    return lines.withColumn("__nth", F.row_number().over(back)).where(F.col("__nth") <= n).drop("__nth")


def error_text(lines: DataFrame, task: str, order: str, line: str) -> DataFrame:
    """(task, error): the last five lines in order, or that the error is unknown."""
    kept = tail(lines, task, order).groupBy(task).agg(F.sort_array(F.collect_list(F.struct(order, line))).alias("__lines"))
    text = F.array_join(F.transform("__lines", lambda x: x[line]), "\n")
    return kept.select(task, F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown error")).alias("error"))


def lifecycle(events: DataFrame, task: str, now: Column | None = None, stale_hours: int = model.STALE_HOURS) -> DataFrame:
    """(task, status, progress, message, at, seq, accepted, refused) from (task, at, seq, status, progress, message): each task's events in order through its state machine.

    Events that TRANSITIONS does not allow are refused and change nothing. A task that stays open for
    longer than so many hours is swept: it becomes an error at that moment, and later events are
    refused; ``now`` sweeps those that are still open. Repeated events (one task, at and seq) count
    once. A task without an accepted event has a null status. Windows run over one order of a
    task's events, row by row; no row holds a task's history.
    """
    once = events.groupBy(task, "at", "seq").agg(F.min(F.struct("status", "progress", "message")).alias("__e")).select(task, "at", "seq", "__e.*")
    line = Window.partitionBy(task).orderBy("at", "seq")
    upto, before = line.rowsBetween(Window.unboundedPreceding, Window.currentRow), line.rowsBetween(Window.unboundedPreceding, -1)
    ever = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(False))
    status = F.coalesce("status", F.lit(""))
    rows = once.withColumn("__start", F.first(F.when(status.isin(*model.START_STATUS), F.col("status")), ignorenulls=True).over(upto))
    started = F.col("__start").isNotNull()
    rows = rows.withColumn("__under_way", ever((status == "processing") & started, before))
    rows = rows.withColumn("__ends", ((status == "error") & started) | ((status == "completed") & F.col("__under_way")))
    moves = ((status == F.coalesce("__start", F.lit("-"))) & ~F.col("__under_way")) | ((status == "processing") & started) | F.col("__ends")
    rows = rows.withColumn("__moves", moves & ~ever(F.col("__ends"), before))
    held = F.last(F.when(F.col("__moves"), F.col("at")), ignorenulls=True).over(before)
    rows = rows.withColumn("__late", F.col("__moves") & F.coalesce(F.col("at") > held + F.expr(f"INTERVAL {int(stale_hours)} HOURS"), F.lit(False)))
    rows = rows.withColumn("__moves", F.col("__moves") & ~ever(F.col("__late"), upto))
    state = F.max_by(F.struct("status", "progress", "message", "at", "seq"), F.when(F.col("__moves"), F.struct("at", "seq")))
    found = rows.groupBy(task).agg(state.alias("__s"), F.max("__late").alias("__swept"), F.count(F.when(F.col("__moves"), 1)).alias("accepted"), F.count(F.when(~F.col("__moves"), 1)).alias("refused"))
    ends = F.col("__s.at") + F.expr(f"INTERVAL {int(stale_hours)} HOURS")
    swept = F.col("__s.status").isin(*model.OPEN_STATUS) & (F.col("__swept") | (F.lit(False) if now is None else now > ends))
    pick = lambda name, other: F.when(swept, other).otherwise(F.when(F.col("accepted") > 0, F.col(f"__s.{name}"))).alias(name)
    return found.select(task, pick("status", F.lit("error")), pick("progress", F.lit(0)), pick("message", F.lit(model.INTERRUPTED)), pick("at", ends), pick("seq", F.col("__s.seq")), "accepted", "refused")
