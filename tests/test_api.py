from lithoscope.api import Engine, call_tool
from lithoscope.sources.chunk import END, START, STRIPPED, blocks_of, chunk_symbols, embed_halving, with_context


def test_chunks(spark):
    assert blocks_of("", 3, 3, 10) == [(0, "", 3, 3)] == [(i, c, a, b) for i, c, a, b in blocks_of(None, 3, 3, 10)]
    cls = "class A:\n    x = 1\n    def f(self):\n        pass\n    def g(self):\n        pass"
    assert blocks_of(cls, 10, 15, 20, "a.py") == [(0, "class A:\n    x = 1", 10, 11), (1, "    def f(self):\n        pass", 12, 13), (2, "    def g(self):\n        pass", 14, 15)]
    flat = "\n".join(["0123456789"] * 5)
    got = blocks_of(flat, 1, 5, 25)
    assert got == [(0, "\n".join(["0123456789"] * 3), 1, 3), (1, "\n".join(["0123456789"] * 2), 4, 5)]
    assert [b[2:] for b in blocks_of(cls, 10, 15, 20)] == [(10, 12), (13, 14), (15, 15)]  # by size: 36 and 30 characters
    assert blocks_of("x" * 100, 1, 1, 10) == [(0, "x" * 100, 1, 1)]
    df = spark.createDataFrame([(1, cls, 10, 15, "x/a.py"), (2, None, 1, None, None)], "id bigint, snippet string, line int, end_line int, path string")
    assert chunk_symbols(df, 20).groupBy("symbol_id").count().orderBy("symbol_id").collect()[0]["count"] == 3


def test_context():
    text = "a\nb1\nb2\nc\nd"
    assert with_context(text, 2, 3, [], 100) == f"a\n{START}\nb1\nb2\n{END}\nc\nd"
    big = "class\n t\n  x\n o\n  y\n  z\nend"
    assert with_context(big, 2, 3, [(1, 7), (2, 3), (4, 6)], 5) == f"class\n{START}\n t\n  x\n{END}\n o\n{STRIPPED}\nend"


def test_halving():
    def model(t):
        if len(t) > 10:
            raise ValueError("context length exceeded")
        return [float(len(t))]

    assert embed_halving(model, "x" * 35) == [8.0]


def test_engine_verbs(spark, small):
    e = Engine(spark, small, embed=lambda t: [1.0] * 64, model="codevec-s")
    assert e.browse().count() > 0 and e.browse(symbols=True).count() > 0 and e.deps().count() > 0 and e.tags().count() > 0
    name = e.index.symbols.where("snippet is not null").orderBy("id").first()["name"]
    assert e.detail(name).count() >= 1 and e.show(name, max_lines=3).count() >= 1
    assert e.search("return", n=99).count() <= 50
    assert e.summary().first()["symbols"] > 0
    assert [t["name"] for t in call_tool(e, {"id": 1, "method": "tools/list"})["result"]["tools"]][0] == "search"
    assert call_tool(e, {"id": 2, "method": "tools/call", "params": {"name": "tags", "arguments": {}}})["result"]["rows"]
    assert call_tool(e, {"id": 3, "method": "tools/call", "params": {"name": "drop"}})["error"]["code"] == -32601
    assert call_tool(e, {"id": 4, "method": "tools/call", "params": {"name": "tags", "arguments": {"zz": 1}}})["error"]["code"] == -32602
    roots = spark.createDataFrame([("/srv/code",)], "dir string")
    assert e.purge(roots).count() > 0 and e.purge(roots, dry_run=False)["symbols"].count() < e.index.symbols.count()
    rules = spark.createDataFrame([(1, "a", "leak", "error")], "rule_id bigint, analyzer string, rule_name string, severity string")
    old = spark.createDataFrame([], "symbol_id bigint, rule_id bigint, message string, confidence double, stale boolean")
    new = e.analyze(old, rules, lambda p: '[{"rule": "leak", "message": "m", "confidence": 0.9}]', limit=3)
    assert new.count() == 3 and e.findings(new, rules).count() >= 3


def test_server_lines(spark, small):
    import json

    from lithoscope.api import serve_line

    e = Engine(spark, small)
    ask = lambda **x: json.loads(serve_line(e, json.dumps({"jsonrpc": "2.0", **x})))
    assert ask(id=1, method="initialize")["result"]["capabilities"] == {"tools": {}}
    tools = {t["name"]: t["inputSchema"]["required"] for t in ask(id=2, method="tools/list")["result"]["tools"]}
    assert len(tools) == 9 and tools["knowledge_store"] == ["concept", "pattern", "body"]
    assert json.loads(serve_line(e, "{broken"))["error"]["code"] == -32700 and serve_line(e, "  ") is None
    assert serve_line(e, json.dumps({"method": "notifications/initialized"})) is None and ask(id=3, method="nope")["error"]["code"] == -32601
    call = lambda name, **a: ask(id=4, method="tools/call", params={"name": name, "arguments": a})
    assert "result" in call("knowledge_store", concept="c", pattern="**", body="b") and e.knowledge.count() == 1
    assert "result" in call("knowledge_session_reset") and call("knowledge_store", concept="c")["error"]["code"] == -32602


def test_many_rules_are_all_asked_about(spark, small):
    rules = spark.createDataFrame([(i, "a", f"r{i:04}", "error") for i in range(2500)], "rule_id bigint, analyzer string, rule_name string, severity string")
    old = spark.createDataFrame([], "symbol_id bigint, rule_id bigint, message string, confidence double, stale boolean")

    def model(prompt):
        return "[" + ", ".join('{"rule": "%s", "message": "m", "confidence": 0.9}' % r for r in ("r0000", "r1500", "r2499") if f"- {r}:" in prompt) + "]"

    new = Engine(spark, small).analyze(old, rules, model, limit=2).collect()
    assert len(new) == 6 and {r["rule_id"] for r in new} == {0, 1500, 2499}


def test_cut_replies_say_so_and_go_on(spark):
    from types import SimpleNamespace

    engine = SimpleNamespace(tags=lambda: spark.range(450).orderBy("id"))
    ask = lambda **x: call_tool(engine, {"id": 1, "method": "tools/call", "params": {"name": "tags", **x}})
    replies = [ask()["result"]] + [ask(offset=n)["result"] for n in (200, 400, 450)]
    assert [r["truncated"] for r in replies] == [True, True, False, False] and [r["offset"] for r in replies] == [0, 200, 400, 450]
    assert [x["id"] for r in replies for x in r["rows"]] == list(range(450))
    assert ask(offset=-1)["error"]["code"] == ask(offset="x")["error"]["code"] == -32602
