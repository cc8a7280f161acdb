import random

from lithoscope.operators import search
from lithoscope.operators.textindex import TextIndex

DOCS = "id bigint, title string, text string"


def scores(df):
    return {r["doc"]: round(r["score"], 9) for r in df.collect()}


def make(seed, ids):
    r = random.Random(seed)
    return [(i, r.choice(["Alpha", "élan vital", None]), " ".join(r.choice("alpha beta gamma delta élan x1".split()) for _ in range(r.randint(0, 12)))) for i in ids]


def test_scores_equal_a_scan_through_updates(spark, tmp_path):
    live = {r[0]: r for r in make(1, range(60))}
    index = TextIndex(spark, str(tmp_path / "a"), 4).build(spark.createDataFrame(list(live.values()) + [(None, "alpha", "alpha")], DOCS), "id", ["title", "text"])
    steps = [(make(2, range(50, 80)), []), (make(3, range(0, 10)), [20, 21, 999]), ([], [55]), (make(4, [20, 55]), [])]
    for k in range(len(steps) + 1):
        scan = spark.createDataFrame(list(live.values()), DOCS)
        for q in ("alpha", "beta elan", "gamma DELTA x1", "nothing", "", "alpha!"):
            for strict in (False, True):
                assert scores(index.bm25(q, strict)) == scores(search.bm25(scan, "id", ["title", "text"], q, strict)), (k, q)
        if k < len(steps):
            new, gone = steps[k]
            index.update(spark.createDataFrame(new, DOCS), "id", ["title", "text"], spark.createDataFrame([(g,) for g in gone], "doc bigint"))
            live = {i: r for i, r in live.items() if i not in gone} | {r[0]: r for r in new}
    small = index.compact(str(tmp_path / "b"))
    assert scores(small.bm25("beta")) == scores(index.bm25("beta")) and small.docs.count() == len(live)
    assert small.postings.select("gen").distinct().count() == 1 and index.postings.select("gen").distinct().count() > 3


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), 8).build(spark.createDataFrame(make(5, range(40)), DOCS), "id", ["text"])
    plan = index.postings_of(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)" in plan
    assert index.postings_of([]).count() == 0


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a")).build(spark.createDataFrame([], DOCS), "id", ["title", "text"])
    assert index.bm25("alpha").count() == 0 and index.stats().first()["n"] == 0
    index.update(spark.createDataFrame([(1, None, "alpha")], DOCS), "id", ["title", "text"])
    assert list(scores(index.bm25("alpha"))) == [1]
