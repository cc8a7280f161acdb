"""Work queues, rates and histories as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lithoscope.functions.text import format_eta


def claim_batch(queue: DataFrame, n: int) -> DataFrame:
    """The n pending rows to work on next: high priority first, then the oldest, then the smaller id."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), "queued_at", "id").limit(n).withColumn("status", F.lit("processing"))


def requeue(queue: DataFrame, max_attempts: int, now: Column) -> DataFrame:
    """Rows in work put back with one attempt more and no priority; failed at the last attempt."""
    busy = F.col("status") == "processing"
    again = F.col("attempts") + 1
    return queue.select(
        *[c for c in queue.columns if c not in ("status", "attempts", "priority", "queued_at")],
        F.when(~busy, F.col("status")).when(again >= max_attempts, "failed").otherwise("pending").alias("status"),
        F.when(busy, again).otherwise(F.col("attempts")).alias("attempts"),
        F.when(busy, 0).otherwise(F.col("priority")).alias("priority"),
        F.when(busy, now).otherwise(F.col("queued_at")).alias("queued_at"),
    )


def recover_orphans(queue: DataFrame) -> DataFrame:
    """Rows that a dead worker left in work become pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def acknowledge(queue: DataFrame, done: DataFrame, soft: bool = False) -> DataFrame:
    """Without the rows done(id); `soft` keeps them as done."""
    if not soft:
        return queue.join(done.select("id").distinct(), "id", "left_anti")
    d = done.select("id").distinct().withColumn("is_done", F.lit(True))
    return queue.join(d, "id", "left").withColumn("status", F.when(F.col("is_done"), "done").otherwise(F.col("status"))).drop("is_done")


def enqueue(queue: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose target isn't queued yet are added."""
    return queue.unionByName(new.join(queue.select(key), key, "left_anti").dropDuplicates([key]).select(*queue.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: of old and new rows the one with the greatest `order`, new before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new"))).alias("r"))
    return best.select(*keys, *[f"r.{c}" for c in rest if c != "_new"])


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def prune_history(history: DataFrame, now: Column, keep_seconds: int = 86_400) -> DataFrame:
    return history.where(F.col("timestamp") >= now - keep_seconds)


def queue_eta(history: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """`queue_name, count_now, eta`: time to empty from the last two measurements, at least a second.

    Where the queue doesn't shrink between them, rates(queue_name, rate), in items a
    minute, count. An empty queue, or one without either, has no time.
    """
    w = Window.partitionBy("queue_name").orderBy(F.desc("timestamp"))
    last = history.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("queue_name").agg(
        F.max(F.when(F.col("r") == 1, F.col("queue_count"))).alias("count_now"), F.max(F.when(F.col("r") == 2, F.col("queue_count"))).alias("before"),
        F.max(F.when(F.col("r") == 1, F.col("timestamp"))).alias("t1"), F.max(F.when(F.col("r") == 2, F.col("timestamp"))).alias("t0"))
    rate = (F.col("before") - F.col("count_now")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
    last = last.withColumn("rate", F.lit(None).cast("double")) if rates is None else last.join(rates.groupBy("queue_name").agg(F.max("rate").cast("double").alias("rate")), "queue_name", "left")
    pace = F.when(rate > 0, rate).when(F.col("rate") > 0, F.col("rate") / 60)
    seconds = F.when(F.col("count_now") > 0, F.greatest(F.lit(1), F.floor(F.col("count_now") / pace)))
    seconds = F.when(pace.isNotNull(), seconds)
    return last.select("queue_name", "count_now", format_eta(seconds).alias("eta"))


def sliding_rate(events: DataFrame, key: str, second: Column, window: int = 60) -> DataFrame:
    """`key, second, n, rate`: events of the trailing window, both ends included, at each second with an event.

    Seconds are summed first, so that the window runs over few rows per key.
    """
    per = events.groupBy(key, second.alias("second")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("second").rangeBetween(-window, 0)
    return per.select(key, "second", F.sum("c").over(w).alias("n")).withColumn("rate", F.col("n") * 60.0 / window)


def time_left(depth: Column, rate: Column) -> Column:
    """Seconds in which a queue of a depth is empty at a rate a minute; null without a rate."""
    return F.when(rate > 0, F.floor(depth / rate * 60))


def oldest_pending(queue: DataFrame) -> DataFrame:
    """The one pending row that has waited longest; ties go to the smaller id."""
    return queue.where("status = 'pending'").orderBy("queued_at", "id").limit(1)


def debounce(events: DataFrame, key: str, ts: str, event: str, gap_seconds: float) -> DataFrame:
    """`flush, key, event`: bursts of events with no gap of `gap_seconds` give one flush; of each key the last event stays.

    Bursts are global: a gap is one in the events of all keys. The order is worked out
    over whole seconds within each day, and the days are stitched by one row each, so
    that no task orders all events.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(key).alias("key"), us.alias("us"), F.col(event).alias("event"), F.floor(us / 1_000_000).alias("sec"))
    sec = e.groupBy("sec").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).withColumn("day", F.floor(F.col("sec") / 86_400))
    gap = F.lit(int(gap_seconds * 1e6))
    w = Window.partitionBy("day").orderBy("sec")
    inside = sec.withColumn("new", F.coalesce(F.col("lo") - F.lag("hi").over(w) > gap, F.lit(False)).cast("int")).withColumn("within", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = inside.groupBy("day").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum("new").alias("n"))
    d = Window.orderBy("day")  # one row a day
    days = days.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(d) > gap, F.lit(True)).cast("int"))
    front = F.sum(F.col("opens") + F.col("n")).over(d.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    burst = inside.select("sec", "day", "within").join(days.select("day", front.alias("front")), "day").select("sec", (F.col("front") + F.col("within")).alias("flush"))
    return e.join(burst, "sec").groupBy("flush", "key").agg(F.max_by("event", F.struct("us", "event")).alias("event"))


def latest_status(heartbeats: DataFrame, name: str = "daemon", ts: str = "ts") -> DataFrame:
    """One row per kind of daemon (the name without its number): state, depth and rate of the newest row.

    `state` is `running` where any of them runs; `last_error` is the newest that isn't empty.
    """
    kind = F.regexp_replace(name, r"-\d+$", "")
    err = F.nullif(F.col("error"), F.lit(""))
    zero = lambda c: F.coalesce(F.max_by(c, ts), F.lit(0)).alias(c) if c in heartbeats.columns else F.lit(0).alias(c)
    return heartbeats.groupBy(kind.alias("kind")).agg(F.when(F.bool_or(F.col("state") == "running"), "running").otherwise(F.max_by("state", ts)).alias("state"), zero("queue_depth"), zero("rate"), F.max_by(err, F.when(err.isNotNull(), F.col(ts))).alias("last_error"), F.max(ts).alias("seen"))
