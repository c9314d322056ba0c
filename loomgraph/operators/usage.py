"""Time operators on a usage log (ts, kind, user, amount)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(calls: DataFrame, path: str) -> None:
    """Adds calls to a usage log, a folder for each day, so that reports read the days they need."""
    calls.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def last_hours(events: DataFrame, hours: int = 5) -> DataFrame:
    """(calls, amount) in the trailing window from the newest event."""
    newest = events.agg(F.max("ts").alias("now"))  # one row
    w = events.join(F.broadcast(newest)).where(F.col("ts") >= F.col("now") - F.expr(f"interval {hours} hours"))
    return w.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("amount"))


def throttle(events: DataFrame, seconds: int, budget: float, key: str = "event_type") -> DataFrame:
    """Each event with the sum over its key's trailing seconds and whether it is over the budget.

    Days part the work: an event's window may reach into the day before, whose tail is added to each day, so that a hot key is sorted day by day.
    """
    day = F.date_trunc("day", F.col("ts"))
    copies = F.array(F.struct(day.alias("d"), F.lit(True).alias("own")), F.struct(F.date_trunc("day", F.col("ts") + F.expr(f"interval {seconds} seconds")).alias("d"), F.lit(False).alias("own")))
    e = events.select("event_id", "ts", F.col(key).alias("key"), "value", F.explode(copies).alias("c")).where("c.own or c.d <> date_trunc('day', ts)")
    e = e.withColumn("secs", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("key", "c.d").orderBy("secs").rangeBetween(-seconds * 1_000_000, 0)
    e = e.withColumn("spent", F.round(F.sum("value").over(w), 4)).where("c.own")
    return e.select("event_id", "key", "spent", (F.col("spent") > budget).alias("over"))


def daily(events: DataFrame, shift_hours: int = -7) -> DataFrame:
    """(day, key, calls): calls by day of a fixed time zone."""
    day = F.date_format(F.col("ts") + F.expr(f"interval {shift_hours} hours"), "yyyy-MM-dd")
    return events.groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("calls"))


def report(events: DataFrame) -> DataFrame:
    """(event_type, calls, amount, largest)."""
    return events.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("amount"), F.max("value").alias("largest"))


def running(events: DataFrame) -> DataFrame:
    """(event_type, day, calls, so_far): running totals over daily partial sums, so that no key's events are sorted as such."""
    d = events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"))
    return d.select("event_type", "day", "calls", F.sum("calls").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("calls"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "calls")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, calls): runs of a user's events no further apart than the gap."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("calls"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")


def call_class(status: str) -> str:
    """SQL expression: what to do about a provider's answer."""
    return f"CASE WHEN {status} = 429 THEN 'wait' WHEN {status} >= 500 THEN 'retry' WHEN {status} >= 400 THEN 'fail' ELSE 'ok' END"
