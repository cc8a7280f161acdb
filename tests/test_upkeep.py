from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from lithoscope.operators import analysis, knowledge, queues
from lithoscope.streaming import pipeline

Q = "id bigint, status string, priority int, attempts int, queued_at bigint"


def test_claim_and_requeue(spark):
    q = spark.createDataFrame([(1, "pending", 1, 0, 5), (2, "pending", 2, 0, 9), (3, "pending", 1, 0, 1), (4, "processing", 1, 1, 1), (5, "processing", 1, 2, 1)], Q)
    assert [r["id"] for r in queues.claim_batch(q, 2).collect()] == [2, 3]
    r = {x["id"]: (x["status"], x["attempts"], x["priority"]) for x in queues.requeue(q, 3, F.lit(99)).collect()}
    assert r[4] == ("pending", 2, 0) and r[5] == ("failed", 3, 0) and r[1] == ("pending", 0, 1)
    assert {x["status"] for x in queues.recover_orphans(q).collect()} == {"pending"}
    done = spark.createDataFrame([(1,)], "id bigint")
    assert queues.acknowledge(q, done).count() == 4 and queues.acknowledge(q, done, soft=True).where("status = 'done'").count() == 1


def test_debounce_last_event_wins(spark):
    t = lambda s: D(2025, 1, 1, 0, 0, s)
    e = spark.createDataFrame([("a", t(0), "create"), ("b", t(1), "modify"), ("a", t(2), "modify"), ("a", t(30), "remove")], "path string, ts timestamp, event string")
    assert {tuple(r) for r in queues.debounce(e, "path", "ts", "event", 5).collect()} == {(1, "a", "modify"), (1, "b", "modify"), (2, "a", "remove")}


def test_eta(spark):
    h = spark.createDataFrame([("q", 0, 100), ("q", 10, 50), ("up", 0, 1), ("up", 10, 5), ("one", 0, 3), ("empty", 0, 9), ("empty", 10, 0)], "queue_name string, timestamp bigint, queue_count bigint")
    assert {r["queue_name"]: r["eta"] for r in queues.queue_eta(h).collect()} == {"q": "10s", "up": None, "one": None, "empty": None}


def test_eta_falls_back_on_the_rate(spark):
    h = spark.createDataFrame([("up", 0, 1), ("up", 10, 5), ("one", 0, 3), ("fast", 0, 1), ("idle", 0, 3), ("same", 5, 8), ("same", 5, 9), ("empty", 0, 0)], "queue_name string, timestamp bigint, queue_count bigint")
    r = spark.createDataFrame([("up", 60.0), ("one", 1.0), ("fast", 600.0), ("idle", 0.0), ("same", 2.0), ("empty", 5.0)], "queue_name string, rate double")
    got = {x["queue_name"]: x["eta"] for x in queues.queue_eta(h, r).collect()}
    assert got["up"] == "5s" and got["one"] == "3m" and got["fast"] == "1s" and got["idle"] is None and got["empty"] is None and got["same"] in ("4m", "5m")


def test_rate_keeps_both_ends_of_the_window(spark):
    e = spark.createDataFrame([("k", 0), ("k", 60), ("k", 61), ("k", 61)], "key string, sec bigint")
    assert {(r["second"], r["n"]) for r in queues.sliding_rate(e, "key", F.col("sec")).collect()} == {(0, 1), (60, 2), (61, 3)}


def test_status_of_daemons(spark):
    b = spark.createDataFrame([("llm-describer-1", "idle", 1, "old", 4, 0.5), ("llm-describer-2", "running", 0, "", 9, 1.5), ("llm-describer-1", "idle", 2, "", 3, 2.5), ("embedder", "idle", 1, "x", None, None)], "daemon string, state string, ts bigint, error string, queue_depth bigint, rate double")
    got = {r["kind"]: (r["state"], r["queue_depth"], r["rate"], r["last_error"], r["seen"]) for r in queues.latest_status(b, "daemon").collect()}
    assert got == {"llm-describer": ("running", 3, 2.5, "old", 2), "embedder": ("idle", 0, 0.0, "x", 1)}


def test_turns_budget_runs_windows(spark):
    s = "row_id bigint, session_id string, type string, message string, content string, recorded_at timestamp"
    m = '{"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}'
    t = D(2025, 1, 1)
    df = spark.createDataFrame([(1, "s", " User", m, None, t), (2, "s", "user", None, "more", t), (3, "s", "assistant", '{"content": "yes"}', None, t), (4, "s", "system", None, "x", t), (5, "s", "user", '{"content": "cut', None, t), (6, "s", "user", None, "  ", t)], s)
    turns = knowledge.transcript_turns(df)
    assert [(r["row_id"], r["text"]) for r in turns.orderBy("row_id").collect()] == [(1, "a b"), (2, "more"), (3, "yes")]
    # lines count with their role: "assistant: yes" has 14 characters, "user: more" 10, "user: a b" 9
    assert {r["row_id"] for r in knowledge.within_budget(turns, 24).collect()} == {2, 3} and {r["row_id"] for r in knowledge.within_budget(turns, 23).collect()} == {3}
    assert [r["text"] for r in knowledge.transcript_text(turns, 24).collect()] == ["user: more\nassistant: yes"]
    tool = spark.createDataFrame([(7, "s", "assistant", '{"content": [{"type": "tool_use", "input": {"path": "b.py", "n": 3, "filePath": "a.py"}}, {"type": "text", "text": "z"}]}', None, t), (8, "s", "system", '{"content": [{"type": "tool_use", "input": {"path": "c.py"}}]}', None, t)], s)
    files = knowledge.file_references(df.unionByName(tool))
    assert {r["file"] for r in files.collect()} == {"a.py", "b.py"}
    assert [r["text"] for r in knowledge.transcript_text(turns, 14, files).collect()] == ["Files referenced in this session:\na.py\nb.py\n\nassistant: yes"]
    assert [(r["run"], r["n"], r["text"]) for r in knowledge.speaker_runs(turns).orderBy("run").collect()] == [(1, 2, "a b\nmore"), (2, 1, "yes")]
    runs = spark.range(1, 11).select(F.lit("s").alias("session_id"), F.col("id").alias("run"))
    assert [(r["first_run"], r["n_runs"]) for r in knowledge.turn_windows(runs, 4, 1).orderBy("chunk").collect()] == [(1, 4), (3, 4), (6, 4), (9, 2)]
    voices = runs.withColumn("voices", F.concat(F.lit("user: "), F.col("run").cast("string")))
    assert [r["text"] for r in knowledge.window_texts(voices, 4, 1).orderBy("chunk").collect()][1] == "user: 3\nuser: 4\nuser: 5\nuser: 6" 


def test_knowledge(spark):
    k = spark.createDataFrame([(1, "c", "**", "b", 0, None), (2, "c", "proj/*", "b", 1, None), (3, "c", "other/x?.py", "b", 2, None), (4, "c", "**", "b", 3, 1)], "id bigint, concept string, pattern string, body string, created_at bigint, suppressed_at bigint")
    p = spark.createDataFrame([("K:\\proj\\sub\\x.py",), ("a/other/xy.py",)], "path string")
    assert [r["id"] for r in knowledge.surface(k, p, None, F.lit(86400 * 3)).collect()] == [1, 2, 3]
    seen = spark.createDataFrame([(1,)], "id bigint")
    assert [(r["id"], r["age"]) for r in knowledge.surface(k, p.limit(0).unionByName(p.where("path like 'K%'")), seen, F.lit(86400 * 3 + 1)).collect()] == [(2, "3d old")]
    a = spark.createDataFrame([(1, 'x [{"concept": "c", "body": "b"}, {"concept": "", "body": "b"}, {"body": "b"}] y'), (2, "none")], "id bigint, answer string")
    assert [tuple(r) for r in knowledge.parse_knowledge(a, "id", "answer").collect()] == [(1, "c", "**", "b")]
    items = spark.createDataFrame([(1, "todo: drop this"), (2, "two  blanks"), (3, "fine")], "id bigint, body string")
    drop = knowledge.model_filter(lambda p: 'so: {"action": "delete"}' if "todo" in p else "keep", "Only one task? {body}")
    assert {(r["id"], r["body"], r["done"], r["refined_at"]) for r in knowledge.refine(items, [drop, "tidy"], F.lit(7)).collect()} == {(2, "two blanks", "update", None), (3, "fine", "", 7)}


def test_knowledge_life_cycle(spark):
    k = spark.createDataFrame([(1, "a", "**", "one", 5, 5, None), (2, "b", "x/*", "two", 9, 1, None), (3, "c", "**", "three", 1, 1, None), (4, "d", "**", "four", 7, 1, None)], "id bigint, concept string, pattern string, body string, created_at bigint, importance int, suppressed_at bigint")
    new = spark.createDataFrame([("n", "**", "fresh")], "concept string, pattern string, body string")
    assert [(r["id"], r["body"], r["created_at"]) for r in knowledge.store(k, new, F.lit(77)).where("id > 4").collect()] == [(5, "fresh", 77)]
    said = spark.createDataFrame([(2, 1, 'ok {"action": "merge", "body": "both"}'), (3, 4, '{"action": "contradict"}'), (4, 1, "broken {"), (1, 2, '{"action": "contradict"}')], "id bigint, other bigint, answer string")
    left, against = knowledge.deduplicate(k, said, F.lit(99))
    got = {r["id"]: (r["concept"], r["pattern"], r["body"], r["importance"], r["suppressed_at"]) for r in left.collect()}
    assert got == {1: ("a", "x/*", "both", 6, None), 3: ("c", "**", "three", 1, 99), 4: ("d", "**", "four", 1, None)}
    assert [tuple(r) for r in against.collect()] == [(3, 4)]
    s, p = knowledge.Session(), spark.createDataFrame([("x/y",)], "path string")
    assert s.hints(k, p, F.lit(9)).count() == 4 and s.hints(k, p, F.lit(9)).count() == 0
    s.reset()
    assert s.hints(k, p, F.lit(9)).count() == 4


def test_descriptions_and_embeddings(spark):
    b = spark.createDataFrame([(1, 10, 0, None), (2, 10, 1, None), (3, 11, 0, "had"), (4, 12, 0, None)], "id bigint, symbol_id bigint, block_index int, description string")
    s = spark.createDataFrame([(10, None), (11, "kept"), (12, "old")], "id bigint, description string")
    a = spark.createDataFrame([(1, "first"), (2, "second"), (3, "ignored"), (4, "")], "id bigint, answer string")
    blocks, symbols = analysis.apply_descriptions(b, s, a)
    assert {r["id"]: r["description"] for r in blocks.collect()} == {1: "first", 2: "second", 3: "had", 4: None}
    assert {r["id"]: r["description"] for r in symbols.collect()} == {10: "first", 11: "kept", 12: "old"}
    t = spark.createDataFrame([(1, "abc"), (2, None)], "id bigint, text string")
    got = {r["id"]: r["vector"] for r in analysis.embed_texts(t, "id", "text", analysis.hash_vector(4)).collect()}
    assert len(got[1]) == 4 and got[1] != got[2] and all(-1 <= x < 1 for v in got.values() for x in v)


def test_stage_runs_once_and_sets_failures_aside(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id bigint, v string").write.parquet(src)
    stream = lambda: spark.readStream.schema("id bigint, v string").parquet(src)
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        pipeline.stage(stream(), lambda b: b.withColumn("n", F.length("v")), sink, state, ["id"]).awaitTermination()
    assert pipeline.latest(spark, sink, ["id"]).count() == 2
    pipeline.stage(stream(), lambda b: b.select("nothing"), str(tmp_path / "bad"), str(tmp_path / "state2"), ["id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad-failed")).count() == 3
    log = spark.read.parquet(str(tmp_path / "bad-failed-log")).collect()
    assert sum(r["rows"] for r in log) == 3 and "nothing" in log[0]["error"]

    def lost(b):
        raise OSError("disk full")

    query = pipeline.stage(stream(), lost, str(tmp_path / "lost"), str(tmp_path / "state3"), ["id"])
    with pytest.raises(Exception, match="disk full"):
        query.awaitTermination()
    assert not (tmp_path / "lost-failed").exists()


def test_moves_become_two_events(spark):
    e = spark.createDataFrame([(D(2025, 1, 1), "a", "move", "b"), (D(2025, 1, 1), "c", "modify", None)], "ts timestamp, path string, event string, dest string")
    assert {(r["path"], r["event"]) for r in pipeline.as_upserts(e).collect()} == {("a", "remove"), ("b", "create"), ("c", "modify")}
