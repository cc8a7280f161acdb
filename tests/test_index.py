"""Operators on a small hand-made index."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from lithoscope.operators import analysis, browse, clones, incremental, lint, search
from lithoscope.operators.components import components
from lithoscope.plans.index import CodeIndex

SYM = "id bigint, file_id bigint, name string, kind string, line int, end_line int, content_hash string, params string, nesting_depth int, param_count int, description string, ext string, snippet string, indexed_at timestamp_ntz, removed_at timestamp_ntz"


def sym(i, f, name, kind="function", line=1, end=None, snippet=None, desc=None, ext=".py", params="", pc=0, removed=None):
    return (i, f, name, kind, line, end, f"h{i}", params, 0, pc, desc, ext, snippet, D(2025, 1, 1), removed)


def write(spark, folder, symbols, refs=(), paths=None, external=(), blocks=None):
    t = D(2025, 1, 1)
    paths = paths or [(f"src/f{f}.py", f) for f in sorted({s[1] for s in symbols})]
    tables = {
        "symbols": (symbols, SYM),
        "files": ([(f, f"s{f}", 1, t, None) for f in sorted({p[1] for p in paths})], "file_id bigint, hash string, size bigint, indexed_at timestamp_ntz, removed_at timestamp_ntz"),
        "file_paths": ([(p, 0, f, t) for p, f in paths], "path string, mtime bigint, file_id bigint, seen_at timestamp_ntz"),
        "symbol_refs": ([(a, b, t) for a, b in refs], "caller_id bigint, callee_id bigint, recorded_at timestamp_ntz"),
        "external_refs": ([(a, b, t) for a, b in external], "caller_id bigint, callee_name string, recorded_at timestamp_ntz"),
        "code_blocks": (blocks or [(s[0], s[0], 0, s[12], s[6], s[4], s[5], None) for s in symbols], "id bigint, symbol_id bigint, block_index int, content string, content_hash string, start_line int, end_line int, description string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return CodeIndex(spark, str(folder))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def where(tmp_path_factory):
    n = iter(range(100))
    return lambda: tmp_path_factory.mktemp(f"ix{next(n)}")


def test_thresholds_are_strict_and_scores_are_ratios(spark, where):
    methods = [sym(10 + i, 1, f"m{i}", "method", 2 + 10 * i, 8 + 10 * i) for i in range(12)]
    ix = write(spark, where(), [sym(1, 1, "Big", "class", 1, 120), sym(2, 2, "f", line=1, end=81), sym(3, 2, "g", line=100, end=140), sym(4, 3, "NoEnd", "class", 1)] + methods)
    assert [(r[3], r[4]) for r in rows(lint.fat_class(ix, 10))] == [("Big (12 methods)", 1.2)]
    assert rows(lint.fat_class(ix, 12)) == []
    assert [(r[3], r[4]) for r in rows(lint.long_function(ix, 40))] == [("f (80 lines)", 2.0)]


def test_wide_rules(spark, where):
    files = [sym(100 + i, 100 + i, f"g{i}") for i in range(12)]
    ix = write(spark, where(), [sym(1, 1, "main"), sym(2, 1, "other")] + files, [(1, 100 + i) for i in range(12)] + [(1, 2)], [("app/main.py", 1)] + [(f"d{i % 6}/g{i}.py", 100 + i) for i in range(12)], [(1, "x"), (1, "x"), (1, None)])
    assert [(r[0], r[3]) for r in rows(lint.wide_module(ix, 10))] == [("app/main.py", "12 file dependencies")]
    assert [r[3] for r in rows(lint.wide_package(ix, 5))] == ["6 packages"] and rows(lint.wide_package(ix, 6)) == []
    assert [r[3] for r in rows(lint.high_fan_out(ix, 8))] == ["main (14 callees)"]
    assert rows(lint.dep_spread(ix, 100)) == [("app/main.py", 1, "dep_spread", "600% spread (12 deps, 2 symbols)", 6.0)]
    assert {r[3] for r in rows(lint.unused_symbol(ix, 0))} == {"main"}


def test_split_class_and_components(spark, where):
    ms = [sym(10 + i, 1, f"m{i}", "method", 2 + i, 2 + i) for i in range(4)]
    ix = write(spark, where(), [sym(1, 1, "C", "class", 1, 50)] + ms, [(10, 11), (12, 13)])
    assert [r[3] for r in rows(lint.split_class(ix, 2))] == ["C (2 disconnected method groups)"] and rows(lint.split_class(ix, 3)) == []
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a bigint, b bigint")
    assert {(r["node"], r["component"]) for r in components(e, "a", "b").collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}
    hub = spark.createDataFrame([(0, i) for i in range(1, 300)], "a bigint, b bigint")
    assert components(hub, "a", "b").where("component = 0").count() == 300
    assert components(e.where("false"), "a", "b").count() == 0


def test_mixed_abstraction(spark, where):
    callers = [sym(200 + i, 200 + i, f"c{i}") for i in range(5)]
    targets = [sym(10 + i, 10 + i, f"t{i}") for i in range(4)]
    refs = [(1, 10 + i) for i in range(4)] + [(200 + i, t) for i in range(5) for t in (10, 11)]
    ix = write(spark, where(), [sym(1, 1, "f")] + callers + targets, refs)
    assert [r[3] for r in rows(lint.mixed_abstraction(ix, 2))] == ["f mixes 2 high-level + 2 low-level deps"]


def test_clones(spark, where):
    ix = write(spark, where(), [sym(1, 1, "a", snippet="def F(x):\n  return X"), sym(2, 2, "b", snippet="def f(x): return x"), sym(3, 2, "c", snippet="def f(x): return x"), sym(4, 3, "d", snippet="completely other text of some length"), sym(5, 3, "e", snippet=None)])
    got = rows(clones.exact_clones(ix))
    assert [(r[1], r[3], r[4]) for r in got] == [("src/f1.py", "a", 3)]
    near = rows(clones.near_clones(ix, 3))
    assert {r[0] for r in near} >= {2, 3} or near == []
    assert [r[2] for r in rows(lint.duplicate_symbol(ix, -1))] == ["exact_clone"]


def test_near_pairs_with_crowded_slice(spark):
    # all values share their low 16 bits: the crowded slice is cut once more
    vals = [(i << 16) | 5 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "h bigint")
    got = {(r["a"], r["b"]) for r in clones.near_pairs(df, 3, hot=50).collect()}
    want = {(a, b) for a in vals for b in vals if a < b and bin(a ^ b).count("1") <= 3}
    assert got == want


def test_semantic_pairs_are_exact_and_strict(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, 0.0]), (3, [0.9, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "id bigint, v array<float>")
    got = {(r["a"], r["b"]) for r in clones.semantic_pairs(df, 0.2, block=2).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_search(spark, where):
    ix = write(spark, where(), [sym(1, 1, "alpha_debounce", snippet="debounce timer reset"), sym(2, 1, "bravo", snippet="unrelated code here", desc="x"), sym(3, 2, "Title", "heading", snippet="debounce")], paths=[("src/a.py", 1), ("README.md", 2)])
    emb = spark.createDataFrame([("h1", "m", [0.9, 0.1, 0.0]), ("h2", "m", [1.0, 0.0, 0.0]), ("h3", "m", None)], "content_hash string, model string, vector array<float>")
    hits = search.hybrid_search(ix, emb, "debounce", [1.0, 0.0, 0.0], 5).collect()
    assert {h["name"] for h in hits} == {"alpha_debounce", "bravo"}
    raw = {r["doc"]: r["rank"] for r in search.top(search.vector_scores(ix, emb, [1.0, 0.0, 0.0], "m"), 5).collect()}
    assert raw == {2: 0, 1: 1}
    assert search.bm25(ix.symbols, "id", ["name", "description"], "  ").count() == 0
    assert search.query_terms("how does it work?", strict=True) == [] and search.query_terms("Caché it") == ["cache", "it"]
    md = search.hybrid_search(ix, emb, "debounce", None, 5, exts=(".md",)).collect()
    assert [h["name"] for h in md] == ["Title"]
    back = search.reranked(search.hybrid_search(ix, emb, "debounce", [1.0, 0.0, 0.0], 5), lambda t: [1]).collect()
    assert len(back) == 2 and back[0]["name"] == hits[1]["name"]
    broken = search.reranked(search.hybrid_search(ix, emb, "debounce", [1.0, 0.0, 0.0], 5), lambda t: 1 / 0).collect()
    assert [b["name"] for b in broken] == [h["name"] for h in hits]


def test_bm25_against_fts5(spark):
    import sqlite3

    docs = ["red fox red", "lazy dog and red cat", "fox", "dog dog dog dog red fox", "nothing here"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", enumerate(docs))
    want = {r[0]: -r[1] for r in con.execute("select rowid, rank from t where t match 'red fox'")}
    got = {r["doc"]: r["score"] for r in search.bm25(spark.createDataFrame(list(enumerate(docs)), "id bigint, x string"), "id", ["x"], "red fox").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_metrics(spark):
    r = search.retrieval_metrics(spark.createDataFrame([(1,), (2,), (None,)], "rank int")).first()
    assert abs(r["p_at_1"] - 1 / 3) < 1e-12 and abs(r["mrr"] - 0.5) < 1e-12


def test_browse_tree_detail_and_deps(spark, where):
    ix = write(spark, where(), [sym(1, 1, "C", "class", 1, 20), sym(2, 1, "m", "method", 2, 5, params="a, b", snippet="x"), sym(3, 2, "caller", line=3)], [(3, 2)])
    assert [r["text"] for r in browse.symbol_tree(ix).orderBy("path", "line").collect()] == ["  class C (1-20)", "    method m(a, b) (2-5)", "  function caller (3-3)"]
    d = browse.detail(ix, "m").first()
    assert d["callers"] == ["caller"] and d["callees"] == [] and d["blocks"] == ["x"]
    assert rows(browse.adjacency(browse.file_dependencies(ix), "src")) == [("f2.py", "f2.py -> f1.py")]
    assert rows(browse.resolve_files(ix, "f1.py")) == [("src/f1.py",)]


def test_suppressions(spark, where):
    v = spark.createDataFrame([("p/a/x.py", 1, "exact_clone", "d", 2.0), ("p/b/x.py", 1, "long_function", "d", 2.0), ("q/x.py", 1, "dip_hint", "d", 2.0)], "path string, line int, rule string, display string, score double")
    s = lambda *r: spark.createDataFrame(list(r), "dir string, rule string")
    left = lambda x: sorted(r["path"] for r in lint.suppress(v, x).collect())
    assert left(s(("p/a", "duplicate_symbol"))) == ["p/b/x.py", "q/x.py"] and left(s(("p/", "*"))) == ["q/x.py"]
    assert left(s(("q", "dip_violation"), ("p/b", "god_file"))) == ["p/a/x.py", "p/b/x.py"] and len(left(s(("p/a/x", "*")))) == 3


def test_symbol_diff_keeps_ids(spark):
    cols = "id bigint, file_id bigint, name string, kind string, line int, content_hash string, description string"
    old = spark.createDataFrame([(1, 1, "f", "function", 1, "a", "d1"), (2, 1, "g", "function", 5, "b", "d2"), (3, 1, "h", "function", 9, "c", None), (4, 1, "f", "function", 20, "z", "d4")], cols)
    new = spark.createDataFrame([(None, 1, "f", "function", 2, "a", None), (None, 1, "g", "function", 6, "x", None), (None, 1, "n", "function", 9, "c", None), (None, 1, "f", "function", 21, "z", None)], cols)
    diff = incremental.symbol_diff(old, new.drop("id"))
    assert {(r["id"], r["name"], r["state"]) for r in diff.collect()} == {(1, "f", "unchanged"), (2, "g", "changed"), (3, "h", "removed"), (4, "f", "unchanged"), (None, "n", "new")}
    out = {r["name"] + str(r["line"]): (r["id"], r["description"]) for r in incremental.apply_symbol_diff(old, new.drop("id"), diff).collect()}
    assert out["f2"] == (1, "d1") and out["g6"] == (2, None) and out["f21"] == (4, "d4") and out["n9"][0] is not None


def test_findings_parse_and_merge(spark):
    rules = spark.createDataFrame([("leak", 1), ("race", 2)], "rule_name string, rule_id bigint")
    a = spark.createDataFrame([(1, '```json\n[{"rule":"leak","message":"m","confidence":0.9},{"rule":"leak","message":"low","confidence":0.1},{"rule":"zzz","message":"m","confidence":1}]\n```'), (2, "no json"), (3, None)], "symbol_id bigint, answer string")
    assert rows(analysis.parse_findings(a, "symbol_id", rules, 0.5)) == [(1, 1, "m", 0.9)]
    old = spark.createDataFrame([(1, 1, "old", 0.5), (2, 2, "keep", 0.5)], "symbol_id bigint, rule_id bigint, message string, confidence double")
    assert {r["message"] for r in analysis.merge_findings(old, analysis.parse_findings(a, "symbol_id", rules, 0.5)).collect()} == {"m", "keep"}
    asked = analysis.ask(spark.createDataFrame([(1, "p"), (2, "boom")], "id bigint, prompt string"), "id", lambda p: 1 / 0 if p == "boom" else p.upper())
    assert {tuple(r) for r in asked.collect()} == {(1, "P"), (2, "")}


def test_reference_resolution(spark, where):
    ix = write(spark, where(), [sym(1, 1, "f"), sym(2, 1, "A.g"), sym(3, 2, "g"), sym(4, 3, "g"), sym(5, 3, "v", "variable")], external=[(1, "g"), (1, "A.g"), (4, "g"), (3, "g"), (1, "v"), (1, "nowhere")])
    assert {tuple(r) for r in incremental.resolve_references(ix.external, ix.symbols).collect()} == {(1, "g", 3), (1, "A.g", 2)}
    assert F is not None
