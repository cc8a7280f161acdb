"""Problems 1, 3, 4 and 6 on hand-made cases and against plain versions."""

import json
import random
from datetime import datetime as D, timedelta

import numpy as np

from lithoscope.llm import conversations, neardup, neighbours, sources

BLOCK = "id bigint, symbol_id bigint, block_index int, content string, unified string"
PATHS = "path string, file_id bigint, generated boolean"


def test_attribute_globs_and_precedence(spark):
    rx = lambda g: __import__("re").compile("(?i)" + sources.glob_regex(g))
    assert rx("*.min.js").match("a/b/x.MIN.js") and not rx("*.min.js").match("a/xmin.js")
    assert rx("/gen/*.py").match("gen/a.py") and not rx("/gen/*.py").match("gen/b/a.py") and rx("a/**/z").match("a/z") and rx("[ab]?.c").match("x/bz.c")
    rules = sources.parse_attributes("# c\n*.x linguist-generated\nlib/** -vendored\nbad\n*.y vendored=false generated=true text\n")
    assert [(a, v) for _, _, a, v in rules] == [("generated", True), ("vendored", False), ("vendored", False), ("generated", True)]
    paths = spark.createDataFrame([(p, p) for p in ("r/a.x", "r/sub/a.x", "r/sub/b.x", "q/a.x")], "path string, unified string")
    attrs = spark.createDataFrame([("/r", "*.x generated\nb.x -generated"), ("r\\sub", "a.x -generated"), ("r/none", None)], "dir string, content string")
    got = {r["path"]: r["says_generated"] for r in sources.declared(paths, attrs).collect()}
    assert got == {"r/a.x": True, "r/sub/a.x": False, "r/sub/b.x": False, "q/a.x": None}


def test_macros_quotes_and_unspecified(spark):
    rules = sources.parse_attributes('[attr]made generated -text\n"a b/*.c" made\n*.h !vendored -generated\n*.z -made\n\n*.q\n"x\\"y" vendored\n')
    assert [(n, a, v) for n, _, a, v in rules] == [(1, "generated", True), (2, "vendored", None), (2, "generated", False), (6, "vendored", True)]
    assert __import__("re").match(rules[0][1], "a b/x.c") and __import__("re").match(rules[-1][1], 'x"y')
    paths = spark.createDataFrame([("r/lib/a.h", "r/lib/a.h"), ("r/lib/a.c", "r/lib/a.c")], "path string, unified string")
    attrs = spark.createDataFrame([("r", "lib/** vendored generated\n*.h !vendored -generated")], "dir string, content string")
    got = {r["path"]: (r["says_generated"], r["says_vendored"]) for r in sources.declared(paths, attrs).collect()}
    assert got == {"r/lib/a.h": (False, None), "r/lib/a.c": (True, True)}


def test_repositories_are_found_in_the_tree(spark):
    names = ["srv/code/one/src/a.py", "srv/code/one/b.py", "srv/code/two/lib/x/c.py", "work/r1/a.c", "work/r2/b.c", "lone/x/y.py", "top.py", "declared/deep/er/in/z.py", "declared/deep/er/q.py"]
    paths = spark.createDataFrame([(n,) for n in names], "unified string")
    attrs = spark.createDataFrame([("/declared/deep", "x"), ("/declared/deep/er", "y")], "dir string, content string")
    root = lambda a: {r["unified"]: "/".join(r["unified"].split("/")[: r["depth"]]) for r in sources.repository_depths(paths, a).collect()}
    want = {names[0]: "srv/code/one", names[1]: "srv/code/one", names[2]: "srv/code/two", names[3]: "work/r1", names[4]: "work/r2", names[7]: "declared/deep/er/in", names[8]: "declared/deep/er"}
    assert root(None) == want
    assert root(attrs) == want | {names[7]: "declared/deep", names[8]: "declared/deep"}


def test_attributes_count_apart_and_teach_other_repositories(spark):
    # 6 repositories declare what lies in `made/`; one that declares nothing has such a directory too
    files = [(f"/c/r{r}/made/x{i}.py", 100 * r + i, None) for r in range(7) for i in range(3)] + [(f"/c/r{r}/own/x{i}.py", 1000 + 100 * r + i, None) for r in range(7) for i in range(3)]
    files += [(f"/c/r{r}/.gitattributes", 5000 + r, None) for r in range(6)] + [("/c/r0/vendor/v.py", 9000, None), ("/c/r1/vendor/v.py", 9001, None)]
    symbols = spark.createDataFrame([(i, f, "") for i, (_, f, _) in enumerate(files)], "id bigint, file_id bigint, path string")
    said = lambda p: ("made/** generated\nvendor/** -generated" + ("\nvendor/** -vendored" if "/r1/" in p else "")) if p.endswith("attributes") else "x = first + second"
    blocks = spark.createDataFrame([(i, i, 0, said(p), None) for i, (p, _, _) in enumerate(files)], BLOCK)
    paths = spark.createDataFrame(files, PATHS)
    attributes = sources.attribute_files(paths, symbols, blocks)
    assert attributes.count() == 6
    got = {r["path"]: r for r in sources.classify_paths(paths, symbols, blocks, attributes).collect()}
    foreign = {p for p, r in got.items() if r["foreign"]}
    assert foreign == {p for p, _, _ in files if "/made/" in p} | {"/c/r0/vendor/v.py"}
    assert got["/c/r6/made/x0.py"]["mined"] and got["/c/r6/made/x0.py"]["by_attribute"] is None and got["/c/r1/vendor/v.py"]["by_attribute"] is False
    assert sources.attribute_files(paths.where("path like '%.py'"), symbols, blocks) is None


def test_contents():
    e = sources.block_evidence
    assert e("// Code generated by foo 1.2.3. DO NOT EDIT.\nx = 1")[3] and e("/*\n * Bundled copy of zip-1.2.0; report\n * bugs to zip upstream\n */")[4]
    assert not any(e("# writes the DO NOT EDIT banner of generated files\nprint('Code generated by x 1.2.3. DO NOT EDIT.')")[3:])
    assert not any(e("// Version 2 of the handler; the licence file is at the root.")[3:])
    mini = "function(e,t){" + "var a=b(c),d=[];if(!x)return y[1]||z;" * 20 + "}"
    chars, dense, data, *_ = e(mini)
    assert dense > 0.9 * chars and data == 0
    chars, dense, data, *_ = e("T = [\n" + "  0x1f, 0x22, 12, 3.5,\n" * 40 + "]")
    assert data > 0.9 * chars
    chars, dense, data, *_ = e('K = "' + "Zm9vYmFy" * 60 + '"')
    assert data > 0.9 * chars
    assert e(None) == e("") == (0, 0, 0, False, False)
    assert e("# " + "word " * 400)[1] == 0


def test_headers_without_a_version():
    e = lambda t: sources.block_evidence(t)[3:]
    for t in ("// Automatically generated file, do not edit\nint x;", "#!/usr/bin/env python\n# WARNING: this file was automatically\n# generated from schema.yml\nx = 1", "/*\n Do not edit by hand! Generated from x.tmpl\n*/\nint x;", "// (c) Acme\n\n// This file is auto-generated.\nx();"):
        assert e(t) == (True, False), t
    for t in ("/* Bundled copy of zippy, MIT license */\nint x;", "# Vendored copy of tiny http (BSD licence)\nx = 1"):
        assert e(t) == (False, True), t
    for t in ("# writes the DO NOT EDIT banner of generated files", "# Emits the banner that marks output of the generator.", "// Compares our parser with the upstream release notes.", "# Rules on how third-party notices are shown to the user.", "# skips vendored copies and minified bundles", "x = 1\n# Automatically generated file, do not edit", "# Bundled copy of the licence is shown", "# This class was created to parse dates", "# Do not edit generated files here"):
        assert e(t + "\ny = 2") == (False, False), t


def test_classify_paths(spark):
    paths = [("/a/src/x.py", 1, None), ("/a/node_modules/k/x.py", 2, None), ("/a/src/copy.py", 2, None), ("K:\\a\\src\\y.min.js", None, None), ("/a/src/data.c", 3, None), ("/a/src/z.py", 99, None), (None, 1, None), ("/a/src/x.py", 1, None), ("/a/codegen/vendors/gen_min.py", 4, None)]
    blocks = [(1, 10, 0, "def f():\n    return 1", None), (2, 20, 0, None, None), (3, 30, 0, "T = {\n" + '  "abc", 1, 2,\n' * 50 + "}", None), (4, 40, 0, "", None), (5, None, 0, "x", None)]
    symbols = spark.createDataFrame([(10, 1, "x"), (20, 2, "x"), (30, 3, "x"), (40, 4, "x"), (None, 4, "x")], "id bigint, file_id bigint, path string")
    run = lambda p, a=None: {r["path"]: r["foreign"] for r in sources.classify_paths(spark.createDataFrame(p, PATHS), symbols, spark.createDataFrame(blocks, BLOCK), a).collect()}
    want = {"/a/src/x.py": False, "/a/node_modules/k/x.py": True, "/a/src/copy.py": True, "K:\\a\\src\\y.min.js": True, "/a/src/data.c": True, "/a/src/z.py": False, "/a/codegen/vendors/gen_min.py": False}
    assert run(paths) == want
    own = spark.createDataFrame([("/a", "src/x.py generated\nsrc/data.c -generated -vendored")], "dir string, content string")
    assert run(paths, own) == want | {"/a/src/x.py": True, "/a/src/data.c": False}
    assert run([]) == {}


def test_repeated_blocks_count_once(spark):
    data, code = "T = {\n" + '  "abc", 1, 2,\n' * 20 + "}", "\n".join(f"total_{c} = first_name + second_name" for c in "abcdefghij")
    blocks = [(1, 10, 0, data, None), (2, 10, 1, code, None), *[(3, 20, 0, data, None), (4, 20, 0, data, None), (5, 20, 1, code, None)], *[(6, 30, 0, data, None), (6, 30, 0, data + "\n" + data, None), (7, 30, 1, code, None)]]
    symbols = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id bigint, file_id bigint")
    for repeats in (1, 5):
        rows = blocks + blocks[:1] * (repeats - 1)
        got = {r["file_id"]: r["data"] for r in sources.content_evidence(symbols, spark.createDataFrame(rows, BLOCK)).collect()}
        assert got == {1: False, 2: True, 3: True}  # other ids or contents are no repeats


def test_mined_shapes(spark):
    rows = [(i, f"r{i % 6}", f"srv/code/r{i % 6}/odd/x{i}.py", 3, True, False) for i in range(30)] + [(100 + i, f"r{i % 6}", f"srv/code/r{i % 6}/own/x{i}.py", 3, i == 0, False) for i in range(30)]
    got = {r["shape"] for r in sources.mined_shapes(spark.createDataFrame(rows, "file_id bigint, root string, unified string, depth int, shown boolean, declares boolean")).collect()}
    assert got == {"dir:odd"}


def brute(rows, t=0.6):
    sets = {}
    for h, x in rows:
        w = neardup.WORD.findall(x.lower()) if h is not None and x is not None else []
        if len(w) >= 30:
            sets[h] = frozenset(zip(w, w[1:], w[2:]))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    rows = []
    for c in range(25):
        base = [f"w{r.randint(0, 60) if c % 3 else r.randint(0, 5000)}" for _ in range(r.choice([31, 60, 200]))]
        for v in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 99)}"
            if v % 3 == 2:
                w = w[20:] + w[:20]
            rows.append((f"k{c}-{v}", " ".join(w)))
    rows += [("same-a", "boiler plate text " * 20), ("same-b", "Boiler Plate; text\n" * 21), ("short", "a b c"), ("null", None), (None, "x " * 40), ("empty", ""), rows[0], rows[0], ("long", "tok " * 20000 + "end")]
    rows += [(f"hot{i}", " ".join(f"h{j}" for j in range(40)) + f" tail{i} more{i}") for i in range(40)]
    df = spark.createDataFrame([(h, t, 1) for h, t in rows], "content_hash string, content string, id int")
    want = brute(rows)
    assert len(want) > 800
    for hot, bits in ((4096, None), (3, None), (4096, 5), (3, 3)):  # salted joins and a full sketch give the same pairs
        got = [tuple(x)[:2] for x in neardup.similar_pairs(df, "content_hash", "content", hot=hot, bits=bits).collect()]
        assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(neardup, "GROUP_ROWS", 3)
    monkeypatch.setattr(neardup, "BITMAP_IDS", 2)
    found = neardup.similar_pairs(df, "content_hash", "content")
    got = [tuple(x)[:2] for x in found.collect()]
    assert set(got) == want and len(got) == len(want)
    label = {}
    for h, _ in rows:
        label[h] = h
    for _ in range(6):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    classes = neardup.groups(df, "id", "content_hash", found).collect()
    assert len(classes) == len(rows) and {(r["hash"], r["class"]) for r in classes} == set(label.items())
    assert all(r["n_links"] == sum(r["hash"] in p for p in want) for r in classes)
    assert neardup.similar_pairs(df.where("false"), "content_hash", "content").count() == 0


ROWS = "row_id bigint, session_id string, uuid string, parent_uuid string, type string, message string, content string, recorded_at timestamp_ntz, stored_at timestamp_ntz, text string"


def test_conversations(spark, tmp_path):
    n = iter(range(1, 1000))
    t = lambda m: D(2025, 1, 1, 0, m)
    row = lambda s, u, ty, text, m, parent=None, message=None: (next(n), s, u, parent, ty, message, text, t(m) if m is not None else None, t(0), "x")
    rows = [
        row("ok", "a", " User", "hi", 1), row("ok", "b", "ASSISTANT", None, 2, "a", json.dumps({"content": [{"type": "text", "text": "yo"}, {"type": "x"}]})), row("ok", "c", "system", "later", 3, "b"),
        row("noturn", "a", "system", "x", 1), row("blank", "a", "user", " \n", 1), row("blank", "b", "assistant", "x", 2),
        row("noanswer", "a", "user", "x", 1), row("noanswer", "b", "assistant", None, 2, None, '{"content": "cut'),
        row("torn", "a", "user", "x", 1), row("torn", "b", "assistant", "y", 2, "gone"),
        row("dup", "a", "user", "x", 5), row("dup", "b", "assistant", "y", 6), row("dup", "b", "user", "stored again", 9),
        row("tie", "a", "user", "x", 1), row("tie", "b", "assistant", "y", 1), row("late", "b", "assistant", "y", 9), row("late", "a", "user", "x", 1), row(None, "a", "user", "x", 1),
    ]
    rows.append(rows[0])
    big = [row("big", f"u{i}", "user" if i % 2 == 0 else "assistant", f"t{i}", i % 60, f"u{i - 1}" if i else None) for i in range(120)]
    df = spark.createDataFrame(rows + big, ROWS)
    path = str(tmp_path / "rows.parquet")
    df.repartition(3).write.parquet(path)
    flat = lambda x: sorted(map(str, x.collect()))
    for options in ({}, {"files_per_batch": 1}, {"shard_rows": 50}, {"files_per_batch": 1, "shard_rows": 1}, {"idle": "2 minutes"}):
        records = conversations.drain(spark, path, df.schema, **options)
        assert flat(conversations.rows_of(records)) == flat(conversations.batch_kept(df)), options
        v = conversations.verdicts(records)
        assert flat(v) == flat(conversations.judge(conversations.batch_kept(df)).select(*v.columns)), options
        assert {r["session_id"] for r in v.where("broken").collect()} == {"noturn", "blank", "noanswer", "torn"}
        turns = conversations.conversations(records, v).orderBy("session_id", "turn").collect()
        assert [(r["session_id"], r["turn"], r["role"], r["text"]) for r in turns if r["session_id"] in ("ok", "late")] == [("late", 0, "user", "x"), ("late", 1, "assistant", "y"), ("ok", 0, "user", "hi"), ("ok", 1, "assistant", "yo")]
        assert [r["turn"] for r in turns if r["session_id"] == "big"] == list(range(120))
    large = conversations.large_sessions(df, 50)
    assert [tuple(r) for r in large.collect()] == [("big", 3)]
    assert conversations.prepared(df, large).where("session_id = 'big'").select("shard").distinct().count() == 3
    empty = str(tmp_path / "empty.parquet")
    df.where("false").write.parquet(empty)
    assert conversations.drain(spark, empty, df.schema).count() == 0


def test_sessions_close_as_the_watermark_passes(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    row = lambda i, s, u, ty, day, parent=None: (i, s, u, parent, ty, None, f"t{i}", D(2025, 1, 1) + timedelta(days=day), D(2025, 1, 1), "x")

    def feed(rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        stream = conversations.closed_sessions(spark.readStream.schema(spark.createDataFrame([], ROWS).schema).parquet(source), lateness="10 days", idle="5 days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {r["session_id"]: (r["broken"], [x["row_id"] for x in r["kept"]]) for r in spark.read.schema(stream.schema).parquet(out).collect()}

    assert feed([row(1, "a", "u1", "user", 0), row(2, "b", "v1", "user", 1)]) == {}
    # a late row that is still in time, and a row stored again: both are buffered
    assert feed([row(4, "a", "u2", "assistant", 3, "u1"), row(3, "c", "w1", "user", 9), row(9, "a", "u1", "user", 4)]) == {}
    assert feed([row(5, "b", "v0", "user", 0)]) == {}
    # the watermark is at day 20: a and b have closed, c is still open
    done = feed([row(6, "d", "x1", "user", 30)])
    assert done == {"a": (False, [1, 4]), "b": (True, [5, 2]), "c": (True, [3])}
    # too late for a: the row is dropped
    assert feed([row(7, "a", "u3", "user", 5), row(8, "d", "x2", "assistant", 31, "x1")]) == done
    assert feed([row(10, "e", "y1", "user", 60)])["d"] == (False, [6, 8])


def test_text_of():
    t = conversations.text_of
    assert t(None, "a") == "a" and t("{", "a") is None and t("[]", "a") is None and t('{"content": 5}', None) is None and t('{"content": [1, {"type": "text", "text": "x"}]}', None) == "x" and t("null", "a") is None


def test_graph_recall_and_ties():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 32))
    x = np.repeat(base, 30, 0) + 0.25 * rng.normal(size=(1800, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, entry = neighbours.build_graph(x)
    assert graph.shape == (1800, neighbours.DEGREE) and not (graph == np.arange(1800)[:, None]).any()
    got, _ = neighbours.beam_search(x, graph, x, entry, neighbours.BEAM)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    truth = np.argsort(-s, 1)[:, :5]
    hit = sum(len(set(a) & set(b.tolist())) for a, b in zip(truth.tolist(), got))
    assert hit / truth.size >= 0.9


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 8))
    x = np.repeat(base, 20, 0) + 0.2 * rng.normal(size=(400, 8))
    rows = [(i, "m", [float(np.float32(c)) for c in v], "x") for i, v in enumerate(x)]
    rows += [(1000, "m", rows[0][2], "x"), (1001, "m", [2 * c for c in rows[0][2]], "x"), (1002, "m", [0.0] * 8, "x"), (1003, "m", None, "x"), (1004, "m", [1.0], "x"), (None, "m", rows[0][2], "x"), (1005, None, rows[0][2], "x"), (1006, "other", [1.0, 2.0], "x"), (1007, "m", [float("nan")] * 8, "x"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "id bigint, model string, vector array<float>, rank string")
    got = neighbours.nearest(df, "id", shard_rows=120).collect()
    ids = [r[0] for r in rows[:402]]
    m = np.array([r[2] for r in rows[:402]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    want = {(ids[i], ids[j]) for i in range(402) for j in sorted(np.flatnonzero(s[i] >= 0.85), key=lambda j: (-round(s[i, j], 9), ids[j]))[:5]}
    found = {(r["id"], r["other"]) for r in got}
    assert len(found & want) >= 0.97 * len(want) and all(r["similarity"] >= 0.85 - 1e-9 for r in got) and len(got) == len(found)
    assert max(r["rank"] for r in got) == 5 and not {1002, 1003, 1004, 1006, 1007} & {i for p in found for i in p}
    pairs = {tuple(r) for r in neighbours.neighbour_pairs(spark.createDataFrame([(1, 2), (2, 1), (5, 3)], "id bigint, other bigint")).collect()}
    assert pairs == {(1, 2), (3, 5)}
    assert neighbours.nearest(df.where("false"), "id").count() == 0


def test_nearest_of_many_equal_vectors(spark):
    """700 copies (some doubled in length) among 1,400 vectors, and 100 different vectors that all tie for one."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 128))
    x = np.concatenate([np.repeat(base, 20, 0) + 0.2 * rng.normal(size=(600, 128)), np.repeat(base[:1], 700, 0), np.eye(128)[:1], 0.9 * np.repeat(np.eye(128)[:1], 99, 0) + np.sqrt(0.19) * np.eye(128)[1:100]])
    x[700:1000] *= 2
    ids = rng.permutation(5 * len(x))[: len(x)].tolist()
    rows = [(i, "m", [float(np.float32(c)) for c in v]) for i, v in zip(ids, x)]
    got = neighbours.nearest(spark.createDataFrame(rows, "id bigint, model string, vector array<float>"), "id", shard_rows=500).toPandas()
    m = np.array([r[2] for r in rows])
    s = np.round((m @ m.T) / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)), 9)
    np.fill_diagonal(s, -9)
    by_id = np.array(ids)
    want = {i: by_id[[j for j in np.lexsort((by_id, -s[n])) if s[n, j] >= 0.85][:5]].tolist() for n, i in enumerate(ids)}
    lists = got.sort_values(["id", "rank"]).groupby("id")["other"].agg(list).to_dict()
    exact = [*ids[600:1300], ids[1300]]
    assert len(want[ids[1300]]) == 5 and sum(lists.get(i, []) == want[i] for i in exact) == len(exact)
    assert sum(len(set(lists.get(i, [])) & set(w)) for i, w in want.items()) >= 0.99 * sum(map(len, want.values()))
    assert (got.groupby("id")["rank"].agg(list).map(lambda r: r == list(range(1, len(r) + 1)))).all() and not got.duplicated(["id", "other"]).any()
