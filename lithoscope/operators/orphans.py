"""Problem 2: references to records that do not exist, by bitmaps of keys.

Keys are integers (names get one from a dictionary). For each period the keys
that are referred to, and the keys that are available before the period, are
compressed bitmaps: 64-bit words by key range, of which only words with a set bit
are rows. `references AND NOT available` leaves the bits of keys that are missing
for sure or become available within the period; they are decoded and only their
rows are compared by exact time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lithoscope.session import materialise, need

#: Rows of one key and period are spread over so many tasks when rows are looked up.
SALTS = 8
#: The period of rows without a time.
NEVER = -1
#: Known names up to this number are sent to all tasks and drop their rows first.
FEW_NAMES = 100_000


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def _words(df: DataFrame) -> DataFrame:
    """`word, period, bits` of rows `key, period`: built map-side, then merged."""
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    return df.groupBy(F.shiftright("key", 6).alias("word"), "period").agg(F.bit_or(bit).alias("bits"))


def missing_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """`key, period` of refs(key, period) whose key isn't available before the period.

    parents(key, period) has the first period of each available key.
    """
    have = _words(parents).groupBy("word").agg(F.collect_list(F.struct("period", "bits")).alias("have"))
    asked = _words(refs)
    before = F.aggregate(F.filter("have", lambda x: x["period"] < F.col("period")), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x["bits"]))
    left = asked.join(have, "word", "left").select("word", "period", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(before, F.lit(0).cast("bigint")))).alias("bits"))
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")
    bits = left.where("bits != 0").select("word", "period", "bits", at).where(F.expr("shiftright(bits, at) & 1 = 1"))
    return bits.select((F.shiftleft("word", 6) + F.col("at")).alias("key"), "period")


def dictionary(names: DataFrame) -> DataFrame:
    """`name, key`: an integer for each distinct name.

    Written to the shared folder, so that a lost task can't give other numbers.
    """
    return materialise(names.where("name is not null").select("name").distinct().select("name", F.monotonically_increasing_id().alias("key")), "dictionary")


def orphans(refs: DataFrame, parents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`period, src_key, ref_key` of refs(src_key, ref, ts) without a usable parent(ref, since).

    `ref` is an integer or a name. A reference is a case unless a parent with its
    key has `since` not after `ts`, or its key is in known(ref), which is looked up by
    distinct keys, so that a hot key is no matter. Defined results: a null `ref` is no reference;
    a null `ts` can't be after any `since`, so it is a case, of the null period;
    parents with a null key or `since` are unusable; repeats count once.
    """
    refs = refs.where("ref is not null")
    parents = parents.where("ref is not null and since is not null")
    # one row for each source, key and period: a case if its earliest time is
    firsts = refs.groupBy("src_key", "ref", F.date_format("ts", "yyyy-MM").alias("month"), month_number(F.col("ts")).alias("period")).agg(F.min("ts").alias("ts"))
    since = parents.groupBy("ref").agg(F.min("since").alias("since"))

    asked = firsts.where("period is not null").select("ref", "period").distinct()
    have = since.select("ref", month_number(F.col("since")).alias("period"))
    if known is not None:  # at the distinct keys, where no key has more than a row per period
        asked = asked.join(known, "ref", "left_anti")
    named = refs.schema["ref"].dataType.simpleString() == "string"
    if named:
        codes = dictionary(asked.select(F.col("ref").alias("name")))
        asked = asked.join(codes, F.col("ref") == F.col("name")).select("key", "period")
        have = have.join(codes, F.col("ref") == F.col("name")).select("key", "period")
    else:
        asked, have = (x.select(F.col("ref").cast("bigint").alias("key"), "period") for x in (asked, have))
    left = missing_keys(asked, have)
    left = left.join(codes, "key").select(F.col("name").alias("ref"), "period") if named else left.select(F.col("key").alias("ref"), "period")

    timeless = firsts.where("period is null")
    if known is not None:
        left = left.unionByName(timeless.select("ref", F.lit(NEVER).alias("period")).distinct().join(known, "ref", "left_anti"))
    left = left.join(since, "ref", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = firsts.withColumn("period", F.coalesce("period", F.lit(NEVER))).withColumn("salt", F.pmod(F.xxhash64("src_key"), F.lit(SALTS)).cast("int"))
    late = rows.join(left, ["ref", "period", "salt"]).where("since is null or ts is null or ts < since").select("month", "src_key", "ref")
    if known is None:
        late = late.unionByName(timeless.select("month", "src_key", "ref"))
    return late.select(F.col("month").alias("period"), "src_key", F.col("ref").cast("string").alias("ref_key"))


def orphan_report(symbol_refs: DataFrame, external_refs: DataFrame, file_paths: DataFrame, symbols: DataFrame, files: DataFrame, known_externals: DataFrame) -> DataFrame:
    """`src_table, period, src_key, ref_key`: all orphans of the index's three reference tables, distinct."""
    live = lambda df, key: need(df, key, "indexed_at", "removed_at").where("removed_at is null").select(F.col(key).alias("ref"), F.col("indexed_at").alias("since"))
    trimmed = F.regexp_replace("callee_name", r"(?U)^\s+|\s+$", "")
    names = need(external_refs, "caller_id", "callee_name", "recorded_at").select(F.col("caller_id").cast("string").alias("src_key"), trimmed.alias("ref"), F.col("recorded_at").alias("ts")).where("ref != ''")
    known = need(known_externals, "callee_name").select(F.regexp_replace("callee_name", r"(?U)^\s+|\s+$", "").alias("ref")).distinct()
    if known.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        names, known = names.join(F.broadcast(known), "ref", "left_anti"), None
    parts = {
        "symbol_refs": orphans(need(symbol_refs, "caller_id", "callee_id", "recorded_at").select(F.col("caller_id").cast("string").alias("src_key"), F.col("callee_id").alias("ref"), F.col("recorded_at").alias("ts")), live(symbols, "id")),
        "external_refs": orphans(names, live(symbols, "name"), known),
        "file_paths": orphans(need(file_paths, "path", "file_id", "seen_at").select(F.col("path").alias("src_key"), F.col("file_id").alias("ref"), F.col("seen_at").alias("ts")), live(files, "file_id")),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("src_table"), "period", "src_key", "ref_key")
        out = df if out is None else out.unionByName(df)
    return out
