import numpy as np
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from lithoscope.functions import text as T
from lithoscope.functions.vectors import bands, cosine, hamming, pack_float32, simhash64, unpack_float32


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def test_count_params(spark):
    cases = {"": 0, "   ": 0, "x int": 1, "x int, y string": 2, "items List<int, string>": 1, "m Map<string, List<int>>": 1, "fn func(a, b int), n int": 2, "a,": 2}
    df = spark.createDataFrame(list(cases.items()), "v string, n int")
    assert {r["v"]: r["g"] for r in df.select("v", T.count_params("v").alias("g")).collect()} == cases


def test_parse_branch(spark):
    cases = {"HEAD -> main, origin/main": "main", "HEAD, tag: v1.0, feature/x": "tag: v1.0", "HEAD, origin/main, feature/x": "feature/x", "HEAD, origin/main": "", "": ""}
    df = spark.createDataFrame(list(cases.items()), "v string, n string")
    assert {r["v"]: r["g"] for r in df.select("v", T.parse_branch("v").alias("g")).collect()} == cases


def test_truncate_eta_age_paths(spark):
    assert [one(spark, "hello", T.truncate("v", n)) for n in (10, 5)] == ["hello", "hello"] and one(spark, "abcdefghij", T.truncate("v", 6)) == "abc..."
    eta = {0: "0s", 59: "59s", 60: "1m", 119: "1m", 3599: "59m", 3600: "1h", 86399: "23h", 86400: "1d"}
    df = spark.createDataFrame(list(eta.items()), "v bigint, n string")
    assert {r["v"]: r["g"] for r in df.select("v", T.format_eta("v").alias("g")).collect()} == eta
    assert one(spark, "K:\\a\\b.Py", T.dirname("v")) == "K:/a" and one(spark, "K:\\a\\b.Py", T.extension("v")) == ".py"
    assert one(spark, "src/**/x.py", T.glob_directory("v")) == "src" and one(spark, "**", T.glob_directory("v")) == "."
    assert one(spark, "/a/b/c.py", T.strip_prefix("v", "/a/b/")) == "c.py"


def test_like_has_no_escape(spark):
    assert one(spark, "C:\\Src\\x", T.like("v", "%\\src\\%")) and one(spark, "a_b", T.like("v", "a_B")) and one(spark, "axb", T.like("v", "a_b"))


def test_normhash_ignores_case_and_blanks(spark):
    a, b = (one(spark, s, T.normhash("v")) for s in ("def Foo(x):\n    return  X", " def foo(x): return x "))
    assert a == b


@given(st.text(max_size=40))
def test_simhash_against_plain_votes(s):
    import hashlib

    votes = [0] * 64
    for i in range(len(s) - 3):
        h = int.from_bytes(hashlib.md5(s[i : i + 4].encode("utf-8", "replace")).digest()[8:], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    assert simhash64(s) % 2**64 == want


def test_bands_find_all_near_values(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        h = int(rng.integers(0, 2**63))
        g = h
        for b in rng.choice(64, 3, replace=False):
            g ^= 1 << int(b)
        rows.append(tuple(x - 2**64 if x >= 2**63 else x for x in (h, g)))
    df = spark.createDataFrame(rows, "h bigint, g bigint")
    key = lambda c: F.transform(bands(c, 3), lambda x: F.concat_ws(":", x["band"], x["slice"]))
    assert df.where(F.arrays_overlap(key("h"), key("g"))).count() == 200
    assert df.where(hamming("h", "g") == 3).count() == 200


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r["r"] for r in df.select(cosine("a", "b").alias("r")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-7 and got[1] == 0.0 and got[2] is None
    import pandas as pd

    assert unpack_float32(pack_float32(pd.Series([[1.5, -2.0]])))[0] == [1.5, -2.0]
