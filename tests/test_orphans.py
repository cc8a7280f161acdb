from datetime import datetime as D

import pytest

from lithoscope.operators.orphans import missing_keys, orphan_report, orphans

REFS = "src_key string, ref bigint, ts timestamp_ntz"
PARENTS = "ref bigint, since timestamp_ntz"


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_missing_late_deleted_and_same_month(spark):
    parents = spark.createDataFrame([(1, D(2025, 1, 5)), (2, D(2025, 3, 10)), (2, D(2025, 3, 20)), (None, D(2020, 1, 1)), (9, None)], PARENTS)
    refs = spark.createDataFrame(
        [("a", 1, D(2025, 1, 4)), ("a", 1, D(2025, 1, 6)), ("b", 1, D(2025, 2, 1)), ("b", 2, D(2025, 3, 10)), ("c", 2, D(2025, 2, 1)), ("c", 3, D(2025, 2, 1)), ("c", 3, D(2025, 2, 1)), ("d", None, D(2025, 2, 1)), ("e", 1, None), ("f", 9, D(2025, 5, 5)), (None, 3, D(2025, 2, 2))],
        REFS,
    )
    got = {tuple(r) for r in orphans(refs, parents).collect()}
    assert got == {("2025-01", "a", "1"), ("2025-02", "c", "2"), ("2025-02", "c", "3"), (None, "e", "1"), ("2025-05", "f", "9"), ("2025-02", None, "3")}


def test_empty_tables(spark):
    assert found(orphans(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS))) == []
    one = spark.createDataFrame([("a", 5, D(2025, 1, 1))], REFS)
    assert found(orphans(one, spark.createDataFrame([], PARENTS))) == [("2025-01", "a", "5")]


def test_bitmaps_cover_word_edges_and_signs(spark):
    keys = [0, 63, 64, 127, 128, 2**40, 2**62, -1, -64, -65]
    refs = spark.createDataFrame([(k, 10) for k in keys], "key bigint, period int")
    parents = spark.createDataFrame([(63, 9), (64, 10), (2**40, 3), (-1, 1)], "key bigint, period int")
    assert {r["key"] for r in missing_keys(refs, parents).collect()} == set(keys) - {63, 2**40, -1}


@pytest.mark.parametrize("few", [0, 100_000])
def test_names_hot_key_and_clashing_columns(spark, monkeypatch, few):
    monkeypatch.setattr("lithoscope.operators.orphans.FEW_NAMES", few)
    t = D(2025, 6, 1)
    ext = spark.createDataFrame([(i, " log.debug ", t, 1) for i in range(60)] + [(1, "  ", t, 1), (2, None, t, 1), (3, "known", t, 1), (4, "Here", t, 1), (5, "here", t, 1), (6, "known", None, 1), (7, "late", None, 1)], "caller_id bigint, callee_name string, recorded_at timestamp_ntz, period int")
    sym = spark.createDataFrame([(1, "here", D(2025, 1, 1), None, "x"), (2, "log.debug", D(2025, 1, 1), D(2025, 2, 1), "x")], "id bigint, name string, indexed_at timestamp_ntz, removed_at timestamp_ntz, ref string")
    none = spark.createDataFrame([], "caller_id bigint, callee_id bigint, recorded_at timestamp_ntz")
    paths = spark.createDataFrame([("p", 7, t)], "path string, file_id bigint, seen_at timestamp_ntz")
    files = spark.createDataFrame([(7, D(2025, 1, 1), None)], "file_id bigint, indexed_at timestamp_ntz, removed_at timestamp_ntz")
    known = spark.createDataFrame([("known", "p")], "callee_name string, package string")
    got = {tuple(r) for r in orphan_report(none, ext, paths, sym, files, known).collect()}
    assert got == {("external_refs", "2025-06", str(i), "log.debug") for i in range(60)} | {("external_refs", "2025-06", "4", "Here"), ("external_refs", None, "7", "late")}
