"""Problem 4: conversations from single message rows, by keyed streaming state.

Rows stream in by arrival and are buffered in the state of their session, early or late,
until the event-time watermark passes the session's last row by `idle`. Then the session
closes: the row of the smallest id of each uuid is kept, the rows are put in order and
judged, and one record with the conversation and its verdict comes out. State, order and
verdict are expressions of the engine; Python only takes texts out of JSON.

A session that is known to be large is spread over shards, each with a state of its own.
Its shards' records hold their part of the rows, and it is put together and judged from
these by aggregates, so that no task holds it whole. The same is done with a session that
came out in several records because its rows lay further apart than `idle`.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from lithoscope.session import materialise, need, scratch_path

COLUMNS = ("row_id", "session_id", "uuid", "parent_uuid", "type", "message", "content", "recorded_at")
KEPT = ("session_id", "uuid", "row_id", "parent_uuid", "role", "text", "recorded_at")
#: State lives on disk and in a bounded part of memory, not on the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: The session of the row that ends a finite input, and its time.
END, END_TIME = "\0end", "9000-01-01 00:00:00"


def text_of(message: str | None, content: str | None) -> str | None:
    """The text of a row; null where there is none or only white space."""
    if message is None:
        text = content
    else:
        try:
            body = json.loads(message)
        except (ValueError, RecursionError):
            return None
        text = body.get("content") if isinstance(body, dict) else None
        if isinstance(text, list):
            blocks = [b.get("text") for b in text if isinstance(b, dict) and b.get("type") == "text"]
            text = " ".join(b for b in blocks if isinstance(b, str))
    return text if isinstance(text, str) and text.strip() else None


def _texts(message: pd.Series, content: pd.Series) -> pd.Series:
    none = lambda x: x if isinstance(x, str) else None
    return pd.Series([text_of(none(m), none(c)) for m, c in zip(message, content)], dtype=object)


def _text(message: str, content: str) -> Column:
    return F.pandas_udf(_texts, "string")(message, content)


def large_sessions(rows: DataFrame, shard_rows: int = 5000) -> DataFrame:
    """`session_id, shards` of the sessions of more than `shard_rows` rows."""
    n = rows.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    return n.select("session_id", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))


def prepared(rows: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Rows with role, text, event time and the key of their state; large(session_id, shards) has the sessions to be spread.

    A row without a time is buffered by the time at which it was stored, else by now.
    """
    role = F.lower(F.regexp_replace("type", r"(?U)^\s+|\s+$", ""))
    key = F.coalesce("uuid", F.concat(F.lit("\0row "), F.col("row_id").cast("string")))
    stored = [F.col("stored_at").cast("timestamp")] if "stored_at" in rows.columns else []
    rows = rows.select(*[F.col(f"`{c}`") for c in COLUMNS], F.coalesce(F.col("recorded_at").cast("timestamp"), *stored, F.current_timestamp()).alias("event")).where("session_id is not null")
    rows = rows.withColumn("shards", F.lit(1)) if large is None else rows.join(large, "session_id", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    return rows.select(
        "session_id", "shards", key.alias("uuid"), "row_id", "parent_uuid",
        F.when(role.isin("user", "assistant"), role).alias("role"),
        F.when(role.isin("user", "assistant"), _text("message", "content")).alias("text"),
        F.col("recorded_at").cast("timestamp").alias("recorded_at"), "event", F.pmod(F.xxhash64(key), F.col("shards")).cast("int").alias("shard"),
    )


def validated(buffered: DataFrame) -> DataFrame:
    """`session_id, shards, shard, kept, n_rows, n_turns, first_role, last_role, n_missing, broken` of buffered sessions (rows).

    `kept` has the rows in order, one for each uuid. The verdict is of a whole session,
    and so null for a shard of one.
    """
    by_uuid = F.sort_array(F.col("rows"))
    out = buffered.withColumn("rows", by_uuid)
    first = F.filter("rows", lambda x, i: (i == 0) | (F.get(F.col("rows"), i - 1)["uuid"] != x["uuid"]))
    out = out.withColumn("kept", F.sort_array(F.transform(first, lambda x: F.struct(x["recorded_at"].alias("recorded_at"), x["row_id"].alias("row_id"), x["uuid"].alias("uuid"), x["parent_uuid"].alias("parent_uuid"), x["role"].alias("role"), x["text"].alias("text")))))
    out = out.withColumn("turns", F.transform(F.filter("kept", lambda x: x["text"].isNotNull()), lambda x: x["role"]))
    parents = F.filter(F.transform("kept", lambda x: x["parent_uuid"]), lambda x: x.isNotNull())
    out = out.withColumn("missing", F.size(F.array_except(parents, F.transform("kept", lambda x: x["uuid"]))))
    whole = lambda c, name: F.when(F.col("shards") == 1, c).alias(name)
    n, opens, closes = F.size("turns"), F.try_element_at("turns", F.lit(1)), F.try_element_at("turns", F.lit(-1))
    broken = (n == 0) | (opens != "user") | (closes != "assistant") | (F.col("missing") > 0)
    return out.select("session_id", "shards", "shard", "kept", whole(F.size("kept").cast("bigint"), "n_rows"), whole(n.cast("bigint"), "n_turns"), whole(opens, "first_role"), whole(closes, "last_role"), whole(F.col("missing").cast("bigint"), "n_missing"), whole(broken, "broken"))


def closed_sessions(rows: DataFrame, large: DataFrame | None = None, lateness: str = "60 days", idle: str = "30 days") -> DataFrame:
    """Streaming: the records (see `validated`) of sessions as they close.

    A session closes when the watermark, which is `lateness` behind the newest row of
    all, passes its last row by `idle`. A row that is later than that is dropped by the
    engine; a row that comes after `idle` without one begins a new record.
    """
    got = prepared(rows, large).withWatermark("event", lateness)
    # by uuid and id first: their order is that of the sort when the session closes
    entry = F.struct("uuid", "row_id", "parent_uuid", "role", "text", "recorded_at")
    state = got.groupBy("session_id", "shards", "shard", F.session_window("event", idle)).agg(F.collect_list(entry).alias("rows"))
    return validated(state)


def drain(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, lateness: str = "36500 days", idle: str = "3650 days", shard_rows: int = 5000) -> DataFrame:
    """Run the stream over all files under `path` and return the records of all sessions.

    The files are taken in micro-batches of `files_per_batch` (all at once, unless
    given). A last row far in the future then closes all sessions, so that what comes
    out has been through the same stream; with the defaults nothing is too late.
    Output and checkpoint are in the shared folder.
    """
    out, checkpoint, last = (scratch_path(spark, x) for x in ("sessions", "sessions-state", "sessions-end"))
    whole = spark.read.schema(schema).parquet(path)
    files = whole.inputFiles()
    options = {"pathGlobFilter": path.rstrip("/").rsplit("/", 1)[-1]} if len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1]) else {}
    folder = path.rstrip("/").rsplit("/", 1)[0] if options else path  # a stream reads folders
    if files_per_batch:
        options["maxFilesPerTrigger"] = files_per_batch
    large = materialise(large_sessions(whole, shard_rows), "large-sessions")
    columns = [c for c in (*COLUMNS, "stored_at") if c in schema.names]
    fixed = {"session_id": F.lit(END), "uuid": F.lit(END), "row_id": F.lit(0), "recorded_at": F.lit(END_TIME).cast("timestamp_ntz")}
    end = spark.range(1).select(*[fixed.get(c, F.lit(None)).cast(schema[c].dataType).alias(c) for c in columns])
    end.where("false").write.parquet(last)
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        for final in (False, True):
            if final:
                end.write.mode("append").parquet(last)
            source = spark.readStream.schema(schema).options(**options).parquet(folder).select(*columns)
            ending = spark.readStream.schema(end.schema).parquet(last)
            stream = closed_sessions(source.unionByName(ending), large, lateness, idle)
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # not in the stream: the engine would filter before the watermark
    return spark.read.schema(stream.schema).parquet(out).where(F.col("session_id") != END)


def _in_parts(records: DataFrame) -> DataFrame:
    """`session_id` of the sessions that several records make up."""
    n = records.groupBy("session_id").agg(F.count("*").alias("n"), F.max("shards").alias("shards"))
    return n.where("n > 1 or shards > 1").select("session_id")


def rows_of(records: DataFrame) -> DataFrame:
    """The kept rows (KEPT): of a session in several records once more one for each uuid."""
    rows = records.select("session_id", F.explode("kept").alias("r")).select("session_id", "r.*").select(*KEPT)
    parts = _in_parts(records)
    again = rows.join(parts, "session_id", "left_semi").groupBy("session_id", "uuid").agg(F.min_by(F.struct(*KEPT[2:]), "row_id").alias("r")).select("session_id", "uuid", "r.*")
    return rows.join(parts, "session_id", "left_anti").unionByName(again.select(*KEPT))


def verdicts(records: DataFrame) -> DataFrame:
    """`session_id, n_rows, n_turns, first_role, last_role, n_missing, broken`, one row per session.

    Defined results: rows of a null session belong to none; a row without a uuid
    stands for itself; rows without a time come first; texts that are null, blank
    or in broken JSON make no turn.
    """
    parts = materialise(_in_parts(records), "sessions-in-parts")
    columns = ("session_id", "n_rows", "n_turns", "first_role", "last_role", "n_missing", "broken")
    whole = records.join(parts, "session_id", "left_anti").select(*columns)
    return whole.unionByName(judge(rows_of(records.join(parts, "session_id", "left_semi"))).select(*columns))


def batch_kept(rows: DataFrame) -> DataFrame:
    """The kept rows without a stream, for comparison in tests."""
    p = prepared(rows)
    first = F.min_by(F.struct("row_id", "parent_uuid", "role", "text", "recorded_at"), "row_id").alias("r")
    return p.groupBy("session_id", "uuid").agg(first).select("session_id", "uuid", "r.*").select(*KEPT)


def judge(kept: DataFrame) -> DataFrame:
    """The verdicts on sessions from their kept rows (KEPT), by aggregates: no task holds a session."""
    order = F.struct("recorded_at", "row_id")
    turn = F.col("text").isNotNull()
    when = lambda c: F.when(turn, F.col(c) if isinstance(c, str) else c)
    per = kept.groupBy("session_id").agg(
        F.count("*").alias("n_rows"),
        F.count(when("row_id")).alias("n_turns"),
        F.min_by(when("role"), when(order)).alias("first_role"),
        F.max_by(when("role"), when(order)).alias("last_role"),
    )
    parents = kept.where("parent_uuid is not null").select("session_id", F.col("parent_uuid").alias("uuid")).distinct()
    missing = parents.join(kept.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").groupBy("session_id").agg(F.count("*").alias("n_missing"))
    out = per.join(missing, "session_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    broken = (F.col("n_turns") == 0) | (F.col("first_role") != "user") | (F.col("last_role") != "assistant") | (F.col("n_missing") > 0)
    return out.withColumn("broken", broken)


def conversations(records: DataFrame, judged: DataFrame) -> DataFrame:
    """`session_id, turn, role, text, recorded_at` of the sound sessions, turns numbered from 0.

    A session in one record is in order already. Otherwise numbers are per session and
    month, plus the count of the months before, so that no task holds a whole session.
    """
    sound = judged.where("not broken").select("session_id")
    parts = materialise(_in_parts(records), "sessions-in-parts")
    whole = records.join(parts, "session_id", "left_anti").join(sound, "session_id", "left_semi")
    whole = whole.select("session_id", F.posexplode(F.filter("kept", lambda x: x["text"].isNotNull())).alias("turn", "r")).select("session_id", "turn", "r.role", "r.text", "r.recorded_at")
    turns = rows_of(records.join(parts, "session_id", "left_semi")).where("text is not null").join(sound, "session_id", "left_semi")
    turns = turns.withColumn("month", F.coalesce(F.date_format("recorded_at", "yyyyMM"), F.lit("")))
    counts = turns.groupBy("session_id", "month").agg(F.count("*").alias("n"))
    w = Window.partitionBy("session_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("session_id", "month", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("front"))
    number = F.row_number().over(Window.partitionBy("session_id", "month").orderBy("recorded_at", "row_id")) - 1
    spread = turns.withColumn("in_month", number).join(counts, ["session_id", "month"]).select("session_id", (F.col("front") + F.col("in_month")).cast("int").alias("turn"), "role", "text", "recorded_at")
    return whole.unionByName(spread)
