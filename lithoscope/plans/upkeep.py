"""Queries of queues, incremental maintenance, knowledge and analyzers, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lithoscope.functions import text as T, vectors
from lithoscope.operators import analysis, incremental, knowledge, queues
from lithoscope.plans.index import NESTED, UNDER, VIEWS, CodeIndex, nested
from lithoscope.plans.lookup import _F, findings_table, rules_table
from lithoscope.session import materialise, table
from lithoscope.sources.chunk import chunk_symbols
from lithoscope.sources.extract import extract_symbols
from lithoscope.sources.ignore import ignored_paths
from lithoscope.streaming import pipeline

NOW = 1_767_225_600
#: File names and texts of the extraction query; § stands for a name.
TEMPLATES = (
    ("package.json", '{"name": "§", "description": "about §", "keywords": ["k1", "k2"]}'),
    ("ci.yml", "first:\n  name: §\n  dependencies: [a]\nsecond: plain\n"),
    ("a.go", "package pk\n\ntype § struct {\n\tn int\n}\n\n// func No() {\nfunc (x *§) Run(a int, b string) int {\n\tif a > 0 {\n\t\treturn x.stop(a)\n\t}\n\treturn Free(b)\n}\n\nfunc (x *§) stop(a int) int {\n\treturn a\n}\n\nfunc Free(s string) int { return 1 }\n"),
    ("a.cs", "namespace N.M\n{\n  public class §\n  {\n    private static int Add(int a, List<int, int> b)\n    {\n      return Sum(a);\n    }\n\n    public int Sum(int a)\n    {\n      return other.Take(\"Add(1)\");\n    }\n  }\n}\n"),
    ("a.py", "class §:\n    X = 1\n\n    @staticmethod\n    def make(a, b=(1, 2)):\n        return free(a)\n\n    def _run(self):\n        return self.make(1)\n\n\ndef free(a):\n    return a\n"),
    ("a.ts", "export class § {\n  go(a, b) {\n    if (a) { this.stop(); }\n  }\n  stop() {\n  }\n}\nexport function f(x) {\n  return x;\n}\n"),
)


def queue(spark, d):
    """The events table as a queue: errors are being worked on, the rest is pending."""
    e = table(spark, d, "events")
    rank = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "signup", 2).otherwise(1)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("target_id"), F.when(F.col("event_type") == "error", "processing").otherwise("pending").alias("status"), rank.alias("priority"), F.pmod("event_id", F.lit(4)).cast("int").alias("attempts"), F.col("ts").alias("queued_at"))


def claim_batch(spark, d):
    return queues.claim_batch(queue(spark, d), 100).select("id", "status", "priority")


def requeue(spark, d):
    return queues.requeue(queue(spark, d), 3, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).select("id", "status", "attempts", "priority", F.unix_micros(F.col("queued_at").cast("timestamp")).alias("us"))


def recover_orphans(spark, d):
    return queues.queue_depth(queues.recover_orphans(queue(spark, d)))


def acknowledge(spark, d):
    q = queue(spark, d)
    return queues.queue_depth(queues.acknowledge(q, q.where("priority = 10").select("id"), soft=True))


def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return queues.upsert(e.where("event_type != 'view'"), e.where("event_type = 'view'"), ["user_id", "event_type"], "event_id")


def debounce(spark, d):
    return queues.debounce(table(spark, d, "events"), "user_id", "ts", "event_type", 300)


def sliding_rate(spark, d):
    e = table(spark, d, "events")
    return queues.sliding_rate(e, "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000), 3600).select("event_type", "second", "n", F.round("rate", 6).alias("rate"))


def _history(spark, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("queue_name"), (day * 86_400).alias("timestamp")).agg(F.count("*").alias("queue_count"))


def queue_eta(spark, d):
    rates = table(spark, d, "events").groupBy(F.col("event_type").alias("queue_name")).agg((F.count("*") % 7).alias("rate"))
    return queues.queue_eta(_history(spark, d), rates)


def queue_time_left(spark, d):
    h = _history(spark, d)
    return h.select("queue_name", "timestamp", queues.time_left(F.col("queue_count"), F.col("queue_count") % 4).alias("seconds"))


def oldest_pending(spark, d):
    return queues.oldest_pending(queue(spark, d)).select("id", "target_id", "priority")


def queue_history(spark, d):
    return queues.prune_history(_history(spark, d), F.lit(1_706_000_000), 5 * 86_400)


def daemon_status(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("daemon"), F.when(F.col("value") > 10, "running").otherwise("idle").alias("state"), F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"), (F.col("event_id") % 50).alias("queue_depth"), F.col("value").alias("rate"), F.col("event_id").alias("ts"))
    return queues.latest_status(e)


def symbol_diff(spark, d):
    """The removed rows against the live ones: what re-indexing each file changed."""
    s = table(spark, d, "symbols").select("id", "file_id", "name", "kind", "line", "content_hash", "description", "indexed_at", "removed_at").dropDuplicates(["id"])
    old = s.where("line > 10")
    new = s.where("removed_at is null").withColumn("content_hash", F.when(F.col("nesting_depth" if "nesting_depth" in s.columns else "line") % 3 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")))
    return incremental.symbol_diff(old, new)


def path_upsert(spark, d):
    p = table(spark, d, "file_paths").dropDuplicates(["path", "file_id", "mtime", "seen_at"])
    cut = F.lit("2025-10-01").cast("timestamp_ntz")
    old = p.where(F.col("seen_at") < cut).groupBy("path").agg(F.max_by(F.struct("file_id", "mtime"), F.struct("seen_at", "file_id")).alias("r")).select("path", "r.*")
    new = p.where(F.col("seen_at") >= cut).groupBy("path").agg(F.max_by(F.struct("file_id", "mtime"), F.struct("seen_at", "file_id")).alias("r")).select("path", "r.*")
    return incremental.upsert_paths(old, new)


def stale_findings(spark, d):
    ix = CodeIndex(spark, d)
    removed = ix.raw("files").where("removed_at is not null").select("file_id")
    return incremental.mark_stale(findings_table(ix), ix.symbols, removed).groupBy("stale").agg(F.count("*").alias("n"))


def orphan_files(spark, d):
    ix = CodeIndex(spark, d)
    return incremental.orphan_files(ix.files, ix.paths.where(~T.under("path", "/srv/code/quartzline"))).select("file_id", "hash")


def purge_cascade(spark, d):
    ix = CodeIndex(spark, d)
    index = {"file_paths": ix.paths, "files": ix.files, "symbols": ix.symbols, "code_blocks": ix.blocks, "symbol_refs": ix.refs, "external_refs": ix.external}
    left = incremental.cascade(index, ix.paths.where(T.like("path", "%/old/%")))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), "n") for k, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def purge_folders(spark, d):
    roots = spark.createDataFrame([("/srv/code/quartzline/",), ("K:\\code\\millstone",)], "dir string")
    return incremental.in_folders(CodeIndex(spark, d).paths, roots)


def resolve_references(spark, d):
    ix = CodeIndex(spark, d)
    return incremental.resolve_references(ix.external, ix.symbols)


def enclosing_symbol(spark, d):
    return incremental.enclosing(nested(spark, d).symbols, ("function", "method", "field", "variable"), ("class", "struct", "interface", "function", "method"))


def outermost_callers(spark, d):
    """Calls at the first line of each symbol, by the functions that hold it."""
    s = nested(spark, d).symbols
    calls = s.where("kind in ('field', 'variable', 'function')").select("file_id", F.col("line").alias("at"), F.col("name").alias("callee")).withColumnRenamed("at", "line").distinct()
    return incremental.outermost(calls, s.where("kind in ('class', 'struct', 'interface')"))


def purge_reasons(spark, d):
    ix = CodeIndex(spark, d)
    roots = spark.createDataFrame([("/srv/code/quartzline/",)], "dir string")
    trees = spark.createDataFrame([("/srv/code/hazelnut",), ("/srv/code/quartzline/src",)], "dir string")
    rules = spark.createDataFrame([("/srv/code", "tests/"), ("/srv/code/jaybird", "*.go"), ("/srv", "mock_*")], "dir string, line string")
    return incremental.purge_reasons(ix.paths, roots, ix.paths.where("path not like '%.ts%'"), trees, rules)


def ignored_by_rules(spark, d):
    lines = ["*.md", "vendor/", "gavi*", "*_vipo*", "src/*/valve*", "# note", "", "!x", "/lead", "Makefile"]
    rules = spark.createDataFrame([("/srv/code", x) for x in lines] + [("/srv/code/ironbark", "src/")], "dir string, line string")
    return ignored_paths(CodeIndex(spark, d).paths.select("path").distinct(), rules)


def folder_diff(spark, d):
    old = CodeIndex(spark, d).paths.where("file_id % 2 = 0").select(T.dirname("path").alias("dir")).distinct()
    return incremental.folder_diff(old, CodeIndex(spark, d).paths.where("file_id % 3 = 0").select(T.dirname("path").alias("dir")).distinct())


def snapshot_changes(spark, d):
    ix = CodeIndex(spark, d)
    p = ix.paths.join(ix.files.select("file_id", "hash"), "file_id").groupBy("path").agg(F.min("hash").alias("hash"))
    return pipeline.snapshot_changes(p.where("hash < 'c'"), p.where("hash > '4'").withColumn("hash", F.when(F.length("path") % 4 == 0, F.reverse("hash")).otherwise(F.col("hash"))))


def direct_files(spark, d):
    ix = CodeIndex(spark, d)
    return pipeline.direct_files(ix.paths, ix.paths.where("file_id % 5 = 0").select(T.dirname("path").alias("dir")))


def missing_embeddings(spark, d):
    ix = CodeIndex(spark, d)
    return incremental.missing_embeddings(ix.blocks, ix.raw("block_embeddings"), "codevec-s")


def rescan(spark, d):
    return incremental.rescan(CodeIndex(spark, d).paths, "/srv/code/quartzline", (".py", ".go"), 10)


def transcript_turns(spark, d):
    return knowledge.transcript_turns(table(spark, d, "transcript_rows").dropDuplicates(["row_id"])).select("session_id", "row_id", "role", "text")


def _turns(spark, d):
    return knowledge.transcript_turns(table(spark, d, "transcript_rows").dropDuplicates(["row_id"]))


def transcript_budget(spark, d):
    return knowledge.within_budget(_turns(spark, d), 1500).select("session_id", "row_id", "used")


def transcript_texts(spark, d):
    rows = table(spark, d, "transcript_rows").dropDuplicates(["row_id"])
    return knowledge.transcript_text(_turns(spark, d), 1500, knowledge.file_references(rows)).select("session_id", F.md5("text").alias("text_md5"))


def window_texts(spark, d):
    return knowledge.window_texts(knowledge.speaker_runs(_turns(spark, d)), 4, 1).select("session_id", "chunk", F.md5("text").alias("text_md5"))


def speaker_runs(spark, d):
    return knowledge.speaker_runs(_turns(spark, d)).select("session_id", "run", "role", "n", F.md5("text").alias("text_md5"))


def turn_windows(spark, d):
    return knowledge.turn_windows(knowledge.speaker_runs(_turns(spark, d)), 4, 1)


def _knowledge(spark, d):
    """Notes with globs: from the documents that the knowledge vectors belong to."""
    k = table(spark, d, "knowledge_embeddings").select(F.col("knowledge_id").alias("doc_id"), "created_at").groupBy("doc_id").agg(F.min("created_at").alias("created_at"))
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return docs.join(k, "doc_id").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("concept"), F.when(F.col("source").isNull(), "**").otherwise(F.concat("source", F.lit("/*"))).alias("pattern"), F.col("text").alias("body"), "created_at", F.when(F.length("text") < 150, F.lit(1)).alias("suppressed_at"))


def knowledge_surface(spark, d):
    ix = CodeIndex(spark, d, directory="/srv/code/ironbark")
    return knowledge.surface(_knowledge(spark, d), ix.paths.select("path"), None, F.lit(NOW)).select("id", "concept", "age")


def knowledge_refine(spark, d):
    k = _knowledge(spark, d).withColumn("refined_at", F.lit(None).cast("int"))
    short = knowledge.model_filter(lambda p: '{"action": "delete"}' if len(p) % 3 == 0 else "{}" if len(p) % 3 == 1 else "?", "Is it about one task only? {body}")
    return knowledge.refine(k, [short, "tidy"], F.lit(1)).select("id", F.md5("body").alias("body_md5"), "done")


def knowledge_fact_check(spark, d):
    k = _knowledge(spark, d)
    snippets = k.where("id % 3 != 0").select("id", F.concat(F.lit("1: "), knowledge.search_directory("pattern")).alias("text"))
    model = lambda p: '{"verdict": "refuted"}' if len(p) % 2 else '{"verdict": "confirmed"}'
    return knowledge.fact_check(k, snippets, model, "Claim: {body}\n{snippets}", F.lit(7).cast("bigint")).select("id", "suppressed_at", "fact_checked_at")


def knowledge_stored(spark, d):
    new = spark.createDataFrame([("b", "**", "second"), ("a", "x/*", "first")], "concept string, pattern string, body string")
    return knowledge.store(_knowledge(spark, d).select("id", "concept", "pattern", "body", "created_at"), new, F.lit(NOW)).where(F.col("created_at") == NOW).select("concept", "pattern", "body")


def knowledge_surfaced(spark, d):
    """Counts after two rounds of hints in one session, the second of which shows nothing again."""
    k, ix, s = _knowledge(spark, d).withColumn("surfaced_count", F.lit(2).cast("bigint")), CodeIndex(spark, d, directory="/srv/code/ironbark"), knowledge.Session()
    shown = [s.hints(k, ix.scope.select("path"), F.lit(NOW)) for _ in range(2)]
    return knowledge.count_surfaced(k, shown[0].unionByName(shown[1])).select("id", "surfaced_count")


def _answers(spark, d):
    k = _knowledge(spark, d)
    e = table(spark, d, "knowledge_embeddings").where("vector is not null").groupBy(F.col("knowledge_id").alias("id")).agg(F.min_by(F.struct("model", F.col("vector").alias("v")), "id").alias("e")).select("id", "e.*")
    pairs = knowledge.first_similar(e.join(k.select("id"), "id", "left_semi"), 0.6)
    prompts = knowledge.classify_prompts(pairs, k, "{body_a} | {body_b}")
    kind = F.when(F.col("id") % 3 == 0, F.concat(F.lit('Yes: {"action": "merge", "body": "'), F.length("prompt").cast("string"), F.lit('"}'))).when(F.col("id") % 3 == 1, F.lit('{"action": "contradict"}')).otherwise("no")
    return k, materialise(prompts.select("id", "other", kind.alias("answer")), "answers")


def knowledge_deduplicated(spark, d):
    k, answers = _answers(spark, d)
    return knowledge.deduplicate(k, answers, F.lit(9))[0].select("id", "concept", "pattern", F.md5("body").alias("body_md5"), F.col("suppressed_at").cast("bigint").alias("suppressed_at"))


def knowledge_contradictions(spark, d):
    k, answers = _answers(spark, d)
    return knowledge.deduplicate(k, answers, F.lit(9))[1]


def _embed(text):
    if len(text) % 5 == 0:
        raise ValueError("no")
    return [float(len(text)), float(text.count(" "))]


def knowledge_embedded(spark, d):
    """What a run of the embedder leaves: vectors, rows for the next stage, and the queue."""
    k = _knowledge(spark, d)
    q = k.select(F.col("id"), F.col("id").alias("target_id"), F.when(F.col("id") % 2 == 0, "pending").otherwise("done").alias("status"), F.lit(1).alias("priority"), F.pmod("id", F.lit(3)).cast("int").alias("attempts"), "created_at").withColumnRenamed("created_at", "queued_at")
    done, following, left = knowledge.embed_pending(q, k, _embed, 3, F.lit(NOW).cast("bigint"))
    return done.select(F.lit("vector").alias("part"), F.col("knowledge_id").alias("id"), F.concat_ws(",", F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("value")).unionByName(following.select(F.lit("dedup").alias("part"), F.col("knowledge_id").alias("id"), F.lit("").alias("value"))).unionByName(left.select(F.lit("queue").alias("part"), "id", F.concat("status", F.lit(" "), F.col("attempts").cast("string")).alias("value")))


def _described(spark, d):
    ix = CodeIndex(spark, d)
    answers = analysis.ask(analysis.description_prompts(ix, "{kind} {name} in {path}: {context}", 500), "id", lambda p: "" if len(p) % 7 == 0 else f"{len(p)} characters")
    return analysis.apply_descriptions(ix.blocks, ix.symbols, materialise(answers, "descriptions"))


def described_blocks(spark, d):
    return _described(spark, d)[0].select("id", "description")


def described_symbols(spark, d):
    return _described(spark, d)[1].select("id", "description")


def embed_blocks(spark, d):
    ix = CodeIndex(spark, d)
    e = analysis.embed_blocks(ix, ix.raw("block_embeddings"), "codevec-xs", _embed)
    return e.select("content_hash", F.concat_ws(",", F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("value"), "error")


def knowledge_parse(spark, d):
    k = _knowledge(spark, d).select("id", F.concat(F.lit("```json\n["), F.to_json(F.struct(F.substring("concept", 1, 10).alias("concept"), F.when(F.col("suppressed_at").isNull(), F.col("pattern")).alias("pattern"), F.lit(" b ").alias("body"))), F.lit(", {\"concept\": \"x\"}]\n```")).alias("answer"))
    return knowledge.parse_knowledge(k, "id", "answer")


def knowledge_similar(spark, d):
    e = table(spark, d, "knowledge_embeddings").where("vector is not null").dropDuplicates(["id"]).select("id", F.col("vector").alias("v"))
    return knowledge.first_similar(e, 0.85).select("id", "other", F.round("similarity", 6).alias("similarity"))


def _edited(spark, d):
    """The live symbols as old ones, but for some new ones, and as new ones, but for removed and changed ones."""
    s = table(spark, d, "symbols").where("removed_at is null").dropDuplicates(["id"]).select("id", "file_id", "name", "kind", "line", "end_line", F.coalesce("snippet", F.lit("")).alias("snippet"), "content_hash", "description")
    old = s.where("line % 5 != 0 and file_id % 7 != 0")
    new = s.where("line % 4 != 0").withColumn("content_hash", F.when(F.col("line") % 3 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))).drop("id")
    return incremental.maintain(old, new, CodeIndex(spark, d).blocks, 1 << 30)


def maintained_symbols(spark, d):
    return _edited(spark, d)["symbols"].select("file_id", "name", "kind", "line", "description", "state")


def maintained_blocks(spark, d):
    """Blocks by the state of their symbols."""
    e = _edited(spark, d)
    state = e["symbols"].select(F.col("id").alias("symbol_id"), "state")
    return e["blocks"].join(state, "symbol_id").groupBy("state").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))


def downstream_queues(spark, d):
    return _edited(spark, d)["queues"].groupBy("queue", "priority").agg(F.count("*").alias("n"))


def file_findings(spark, d):
    ix = CodeIndex(spark, d)
    s = ix.symbols.join(ix.scope, "file_id").select("path", "id", "name", "line")
    one = F.to_json(F.struct(F.when(F.col("line") % 2 == 0, "leak").otherwise("race").alias("rule"), F.concat(F.lit("m"), F.col("line").cast("string")).alias("message"), (F.col("line") % 10 / 10).alias("confidence"), F.when(F.col("line") % 3 == 0, "nobody").otherwise(F.col("name")).alias("symbol")))
    answers = s.groupBy("path").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("answer"))
    return analysis.parse_file_findings(answers, s, rules_table(spark), 0.4)


def vector_roundtrip(spark, d):
    """Vectors packed as 32-bit numbers and unpacked again."""
    pack, unpack = F.pandas_udf(vectors.pack_float32, "binary"), F.pandas_udf(vectors.unpack_float32, "array<float>")
    e = table(spark, d, "block_embeddings").select("vec_id", "vector", pack("vector").alias("packed")).withColumn("back", unpack("packed"))
    return e.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.length("packed")).alias("bytes"), F.bool_and(F.col("back").eqNullSafe(F.col("vector"))).alias("same"))


def chunk_check(spark, d):
    """One row: symbols, and how many of their blocks differ from the lines that they name, are out of order or leave text out."""
    s = CodeIndex(spark, d).symbols.select("id", F.coalesce("snippet", F.lit("")).alias("snippet"), "line", F.lit(None).cast("int").alias("end_line"), F.concat(F.lit("x"), F.coalesce("ext", F.lit(""))).alias("path"))
    b = chunk_symbols(s, 600)
    lines = F.split("snippet", "\n")
    first = F.col("start_line") - F.col("line")
    own = F.array_join(F.slice(lines, first + 1, F.when(F.col("next").isNull(), F.size(lines)).otherwise(F.col("next") - F.col("line")) - first), "\n")
    w = Window.partitionBy("symbol_id").orderBy("block_index")
    j = b.join(s.select(F.col("id").alias("symbol_id"), "snippet", "line"), "symbol_id").withColumn("next", F.lead("start_line").over(w))
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    per = j.groupBy("symbol_id").agg(F.sum((bare(own) != bare("content")).cast("int")).alias("wrong"), F.sum((F.col("next") <= F.col("start_line")).cast("int")).alias("unordered"), (F.sum(F.length(bare("content"))) != F.length(bare(F.first("snippet")))).cast("int").alias("lost"))
    return per.agg(F.count("*").alias("symbols"), F.sum("wrong").alias("wrong"), F.coalesce(F.sum("unordered"), F.lit(0)).alias("unordered"), F.sum("lost").alias("lost"))


def extracted_symbols(spark, d):
    """Symbols of source files that are written out of the symbols' ids, one of six languages each."""
    s = CodeIndex(spark, d).symbols
    text = F.element_at(F.array(*[F.lit(t) for _, t in TEMPLATES]), (F.pmod("id", F.lit(len(TEMPLATES))) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in TEMPLATES]), (F.pmod("id", F.lit(len(TEMPLATES))) + 1).cast("int"))
    files = s.select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("/"), name).alias("path"), F.encode(F.replace(text, F.lit("§"), F.concat(F.lit("T"), F.col("id").cast("string"))), "UTF-8").alias("content"))
    got = extract_symbols(files)
    return got.select("path", "name", "kind", "line", "end_line", "param_count", "nesting_depth", F.array_join("calls", ",").alias("calls"), F.coalesce(F.col("tags")["visibility"], F.lit("")).alias("visibility"), F.coalesce(F.col("tags")["is_static"], F.lit("")).alias("is_static"))


def line_chunks(spark, d):
    """Blocks of symbols whose language isn't known: cut by size alone."""
    s = CodeIndex(spark, d).symbols.where("snippet is not null and line is not null").select("id", "snippet", "line", "end_line")
    return chunk_symbols(s, 600).groupBy("symbol_id").agg(F.count("*").alias("blocks"), F.max(F.struct("block_index", "start_line", "end_line")).alias("l"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "content_hash"))), lambda x: x["content_hash"]), ",")).alias("hashes")).select("symbol_id", "blocks", F.col("l.start_line").alias("last_start"), F.col("l.end_line").alias("last_end"), "hashes")


def pending_limited(spark, d):
    ix = CodeIndex(spark, d)
    return analysis.pending_symbols(ix, findings_table(ix).where("confidence > 0.5"), rules_table(spark).where("analyzer = 'bugs'"), 5, 7).select("id", "name", "path", "line")


def pending_symbols(spark, d):
    ix = CodeIndex(spark, d)
    f = findings_table(ix).where("confidence > 0.5")
    return analysis.pending_symbols(ix, f, rules_table(spark).where("analyzer = 'bugs'"), 5).select("id", "name", "path", "line")


def file_prompts(spark, d):
    ix = CodeIndex(spark, d)
    return analysis.file_prompts(analysis.pending_symbols(ix, findings_table(ix).where("false"), rules_table(spark), 5)).select("path", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n"))


def parse_findings(spark, d):
    ix = CodeIndex(spark, d)
    a = ix.symbols.select("id", F.concat(F.lit("Here: ["), F.to_json(F.struct(F.when(F.col("line") % 2 == 0, "leak").otherwise("unknown").alias("rule"), F.col("name").alias("message"), (F.col("line") % 10 / 10).alias("confidence"))), F.lit("]")).alias("answer"))
    return analysis.parse_findings(a, "id", rules_table(spark), 0.4)


def reset_findings(spark, d):
    ix = CodeIndex(spark, d, directory="/srv/code/quartzline")
    scope = ix.symbols.join(ix.scope, "file_id", "left_semi")
    return analysis.reset_findings(findings_table(ix), rules_table(spark).where("analyzer = 'bugs'"), scope).groupBy("rule_id").agg(F.count("*").alias("n"))


def register_rules(spark, d):
    new = spark.createDataFrame([("style", "size", "error"), ("docs", "missing", "info")], "analyzer string, rule_name string, severity string")
    return analysis.register_rules(rules_table(spark), new).select("analyzer", "rule_name", "severity")


def embedding_text(spark, d):
    return analysis.embedding_text(CodeIndex(spark, d)).select("id", F.md5("text").alias("text_md5"))


def more_scalars(spark, d):
    """Branches of commit decorations and directories of globs, made from the symbols' names."""
    s = CodeIndex(spark, d).symbols
    refs = F.when(F.col("line") % 3 == 0, F.concat(F.lit("HEAD -> "), "name", F.lit(", origin/x"))).when(F.col("line") % 3 == 1, F.concat(F.lit("origin/main, HEAD, "), "kind", F.lit(", z"))).otherwise("HEAD")
    return s.select("id", T.parse_branch(refs).alias("branch"), T.glob_directory(F.concat("kind", F.when(F.col("line") % 2 == 0, "/*.py").otherwise("/a//?b"))).alias("dir"), T.fixed(F.col("line") / 16, 2).alias("shown"))


def scalar_functions(spark, d):
    """The scalar functions on paths, parameters and texts of all symbols."""
    ix = CodeIndex(spark, d)
    return ix.symbols.join(ix.scope, "file_id").select(
        "id", "path", T.dirname("path").alias("dir"), T.basename("path").alias("base"), T.extension("path").alias("ext"),
        T.count_params("params").cast("int").alias("n_params"), T.truncate("name", 12).alias("short"), T.content_hash("snippet").alias("hash"), T.neutral_braces("params").alias("braces"),
        T.format_eta(F.col("line") * 97).alias("eta"), T.format_age(F.col("line") * 977).alias("age"), F.round(T.rrf("line"), 9).alias("rrf"))


QUERIES = {f.__name__: f for f in (
    claim_batch, requeue, recover_orphans, acknowledge, upsert_latest, debounce, sliding_rate, queue_eta, queue_time_left, queue_history, oldest_pending, daemon_status,
    symbol_diff, path_upsert, stale_findings, orphan_files, purge_cascade, purge_folders, purge_reasons, ignored_by_rules, folder_diff, snapshot_changes, direct_files, resolve_references, enclosing_symbol, outermost_callers, missing_embeddings, rescan,
    transcript_turns, transcript_budget, transcript_texts, speaker_runs, turn_windows, window_texts,
    knowledge_surface, knowledge_surfaced, knowledge_stored, knowledge_refine, knowledge_fact_check, knowledge_parse, knowledge_similar, knowledge_deduplicated, knowledge_contradictions, knowledge_embedded,
    extracted_symbols, maintained_symbols, maintained_blocks, downstream_queues, line_chunks, file_findings, vector_roundtrip, chunk_check, pending_limited, pending_symbols, file_prompts, parse_findings, reset_findings, register_rules, embedding_text, embed_blocks, described_blocks, described_symbols, more_scalars, scalar_functions,
)}


_Q = "q AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'processing' ELSE 'pending' END AS status, CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 2 ELSE 1 END AS priority, CAST(event_id % 4 AS INT) AS attempts, ts AS queued_at FROM events)"
_H = "h AS (SELECT event_type AS queue_name, epoch_us(ts) // 86400000000 * 86400 AS timestamp, count(*) AS queue_count FROM events GROUP BY ALL)"
_ETA = "CASE WHEN {x} < 60 THEN {x} || 's' WHEN {x} < 3600 THEN {x} // 60 || 'm' WHEN {x} < 86400 THEN {x} // 3600 || 'h' ELSE {x} // 86400 || 'd' END"
_SAFE = "CASE WHEN json_valid(message) THEN message ELSE '{}' END"
_TURNS = f"""t0 AS (SELECT DISTINCT row_id, session_id, recorded_at, lower(trim(type)) AS role,
  CASE WHEN message IS NULL THEN content WHEN NOT json_valid(message) THEN NULL
       WHEN json_type({_SAFE}, '$.content') = 'VARCHAR' THEN json_extract_string({_SAFE}, '$.content')
       WHEN json_type({_SAFE}, '$.content') = 'ARRAY' THEN array_to_string([json_extract_string(b, '$.text') FOR b IN CAST(json_extract({_SAFE}, '$.content') AS JSON[]) IF json_extract_string(b, '$.type') = 'text'], ' ') END AS text FROM transcript_rows),
turns AS (SELECT session_id, row_id, recorded_at, role, text FROM t0 WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) != '')"""
_VOICE = "role || ': ' || regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
_KEPT = f"kept AS (SELECT *, {_VOICE} AS voice, CAST(sum(length({_VOICE})) OVER (PARTITION BY session_id ORDER BY recorded_at DESC, row_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM turns QUALIFY used <= 1500)"
_FILES = f"calls AS (SELECT session_id, unnest(CAST(json_extract(m, '$.content') AS JSON[])) AS b FROM (SELECT session_id, {_SAFE} AS m FROM transcript_rows WHERE lower(trim(type)) IN ('user', 'assistant')) WHERE json_type(m, '$.content') = 'ARRAY'), files_named AS (SELECT DISTINCT session_id, file FROM (SELECT session_id, unnest([json_extract_string(b, '$.input.' || k) FOR k IN ['file_path', 'path', 'notebook_path', 'filePath']]) AS file FROM calls WHERE json_extract_string(b, '$.type') = 'tool_use') WHERE file != '')"
_WINDOWS = ", m AS (SELECT session_id, max(run) AS runs FROM runs GROUP BY ALL), c AS (SELECT session_id, runs, unnest(range(0, runs, 3)) AS i FROM m), windows AS (SELECT session_id, CAST(i // 3 AS INT) AS chunk, greatest(0, i - CASE WHEN i > 0 THEN 1 ELSE 0 END) AS lo, least(runs, greatest(0, i - 1) + 4) AS hi FROM c)"
_RUNS = f"WITH {_TURNS}, r0 AS (SELECT *, CASE WHEN coalesce(lag(role) OVER w, '') != role THEN 1 ELSE 0 END AS f FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY recorded_at, row_id)), r1 AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY recorded_at, row_id ROWS UNBOUNDED PRECEDING) AS run FROM r0), runs AS (SELECT session_id, CAST(run AS BIGINT) AS run, role, count(*) AS n, string_agg(text, chr(10) ORDER BY recorded_at, row_id) AS text, string_agg(" + _VOICE + f", chr(10) ORDER BY recorded_at, row_id) AS voices FROM r1 GROUP BY ALL)"
_K = "k AS (SELECT doc_id AS id, substr(text, 1, 40) AS concept, CASE WHEN source IS NULL THEN '**' ELSE source || '/*' END AS pattern, text AS body, created_at, CASE WHEN length(text) < 150 THEN 1 END AS suppressed_at FROM documents JOIN (SELECT knowledge_id AS doc_id, min(created_at) AS created_at FROM knowledge_embeddings GROUP BY ALL) USING (doc_id))"
#: Answers about the first similar item of the same model, by id: merge, contradict or nothing.
_SAID = "ke AS (SELECT knowledge_id AS id, arg_min((model, CAST(vector AS DOUBLE[])), ke.id) AS e FROM knowledge_embeddings ke WHERE vector IS NOT NULL AND knowledge_id IN (SELECT id FROM k) GROUP BY ALL), dims AS (SELECT e[1] AS model, mode(len(e[2])) AS n FROM ke GROUP BY 1), kv AS (SELECT id, e[1] AS model, e[2] AS v FROM ke JOIN dims ON e[1] = model AND len(e[2]) = n WHERE list_inner_product(e[2], e[2]) > 0), sim AS (SELECT a.id, min(b.id) AS other FROM kv a JOIN kv b ON a.model = b.model AND a.id != b.id AND list_cosine_similarity(a.v, b.v) >= 0.6 GROUP BY a.id), said AS (SELECT s.id, s.other, length(a.body || ' | ' || b.body) AS n FROM sim s JOIN k a ON a.id = s.id JOIN k b ON b.id = s.other)"
_PEND = "pend AS (SELECT s.id, s.name, h.path, s.line, b.content FROM sym s JOIN (SELECT file_id, min(path) AS path FROM paths GROUP BY file_id) h USING (file_id) JOIN (SELECT symbol_id, arg_min(content, id) AS content FROM blocks WHERE block_index = 0 GROUP BY ALL) b ON b.symbol_id = s.id WHERE s.kind IN ('function', 'method') AND coalesce(end_line, line) - line >= 5)"

_ETEXT = """h AS (SELECT file_id, min(path) AS path FROM paths GROUP BY file_id), e AS (SELECT callee_id AS id, 0 AS side, caller_id AS other FROM refs UNION ALL SELECT caller_id, 1, callee_id FROM refs),
n AS (SELECT e.id, side, other, s.name FROM e JOIN sym s ON s.id = other QUALIFY row_number() OVER (PARTITION BY e.id, side ORDER BY other) <= 10),
l AS (SELECT id, string_agg(name, ', ' ORDER BY other) FILTER (side = 0) AS r, string_agg(name, ', ' ORDER BY other) FILTER (side = 1) AS e FROM n GROUP BY id),
etext AS (SELECT b.id, s.name || CASE WHEN coalesce(params, '') != '' THEN '(' || params || ')' ELSE '' END
  || CASE WHEN coalesce(CASE WHEN block_index = 0 THEN s.description ELSE b.description END, '') != '' THEN ': ' || CASE WHEN block_index = 0 THEN s.description ELSE b.description END ELSE '' END
  || chr(10) || 'in ' || h.path || CASE WHEN l.r != '' THEN chr(10) || 'callers: ' || l.r ELSE '' END || CASE WHEN l.e != '' THEN chr(10) || 'callees: ' || l.e ELSE '' END
  || CASE WHEN b.content != '' AND s.kind IN ('function', 'method') THEN chr(10) || chr(10) || b.content ELSE '' END AS text FROM blocks b JOIN sym s ON s.id = b.symbol_id JOIN h USING (file_id) LEFT JOIN l ON l.id = s.id)"""
_DESC = "said AS (SELECT id, CASE WHEN length(q) % 7 != 0 THEN length(q) || ' characters' END AS said FROM (SELECT b.id, kind || ' ' || s.name || ' in ' || h.path || ': ' || CASE WHEN length(coalesce(content, '')) <= 500 THEN coalesce(content, '') ELSE substr(content, 1, 497) || '...' END AS q FROM blocks b JOIN sym s ON s.id = b.symbol_id JOIN (SELECT file_id, min(path) AS path FROM paths GROUP BY file_id) h USING (file_id) WHERE b.description IS NULL))"

SQL = {
    "claim_batch": f"WITH {_Q} SELECT id, 'processing' AS status, priority FROM (SELECT * FROM q WHERE status = 'pending' ORDER BY priority DESC, queued_at, id LIMIT 100)",
    "requeue": f"WITH {_Q} SELECT id, CASE WHEN status != 'processing' THEN status WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts + CAST(status = 'processing' AS INT) AS attempts, CASE WHEN status = 'processing' THEN 0 ELSE priority END AS priority, epoch_us(CASE WHEN status = 'processing' THEN TIMESTAMP '2026-01-01' ELSE queued_at END) AS us FROM q",
    "recover_orphans": "SELECT 'pending' AS status, count(*) AS n FROM events",
    "acknowledge": f"WITH {_Q} SELECT CASE WHEN priority = 10 THEN 'done' ELSE status END AS status, count(*) AS n FROM q GROUP BY ALL",
    "upsert_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "debounce": "WITH e AS (SELECT user_id AS key, epoch_us(ts) AS us, event_type AS event, epoch_us(ts) // 1000000 AS sec FROM events), s AS (SELECT sec, min(us) AS lo, max(us) AS hi FROM e GROUP BY sec), b AS (SELECT sec, sum(CASE WHEN lo - h > 300000000 OR h IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY sec) AS flush FROM (SELECT *, lag(hi) OVER (ORDER BY sec) AS h FROM s)) SELECT CAST(flush AS BIGINT) AS flush, key, arg_max(event, (us, event)) AS event FROM e JOIN b USING (sec) GROUP BY ALL",
    "sliding_rate": "WITH s AS (SELECT event_type, epoch_us(ts) // 1000000 AS second, count(*) AS c FROM events GROUP BY ALL), w AS (SELECT event_type, second, sum(c) OVER (PARTITION BY event_type ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM s) SELECT event_type, second, CAST(n AS BIGINT) AS n, round(n * 60.0::DOUBLE / 3600, 6) AS rate FROM w",
    # by the last two measurements, else by the rate a minute; nothing for an empty queue
    "queue_eta": f"WITH {_H}, r AS (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY timestamp DESC) AS r FROM h), l AS (SELECT queue_name, max(queue_count) FILTER (r = 1) AS count_now, max(queue_count) FILTER (r = 2) AS b, max(timestamp) FILTER (r = 1) AS t1, max(timestamp) FILTER (r = 2) AS t0 FROM r GROUP BY ALL), p AS (SELECT event_type AS queue_name, count(*) % 7 AS per_minute FROM events GROUP BY ALL), x AS (SELECT queue_name, count_now, CASE WHEN count_now <= 0 THEN NULL WHEN b > count_now THEN greatest(1, CAST(floor(count_now / ((b - count_now) / (t1 - t0)::DOUBLE)) AS BIGINT)) WHEN per_minute > 0 THEN greatest(1, CAST(floor(count_now / (per_minute / 60.0::DOUBLE)) AS BIGINT)) END AS s FROM l JOIN p USING (queue_name)) SELECT queue_name, count_now, {_ETA.format(x='s')} AS eta FROM x",
    "queue_time_left": f"WITH {_H} SELECT queue_name, timestamp, CASE WHEN queue_count % 4 > 0 THEN CAST(floor(queue_count / (queue_count % 4)::DOUBLE * 60) AS BIGINT) END AS seconds FROM h",
    "oldest_pending": f"WITH {_Q.replace('event_id AS id,', 'event_id AS id, user_id AS target_id,')} SELECT id, target_id, priority FROM q WHERE status = 'pending' ORDER BY queued_at, id LIMIT 1",
    "queue_history": f"WITH {_H} SELECT queue_name, timestamp, queue_count FROM h WHERE timestamp >= 1706000000 - 432000",
    "daemon_status": "WITH e AS (SELECT event_type AS kind, event_id AS ts, CASE WHEN value > 10 THEN 'running' ELSE 'idle' END AS state, CASE event_type WHEN 'error' THEN 'failed' END AS error, event_id % 50 AS depth, value FROM events) SELECT kind, CASE WHEN bool_or(state = 'running') THEN 'running' ELSE arg_max(state, ts) END AS state, arg_max(depth, ts) AS queue_depth, arg_max(value, ts) AS rate, max(error) AS last_error, max(ts) AS seen FROM e GROUP BY kind",
    "symbol_diff": "WITH s AS (SELECT DISTINCT id, file_id, name, kind, line, content_hash, removed_at FROM symbols), o AS (SELECT id, file_id, name, kind, content_hash AS was, row_number() OVER (PARTITION BY file_id, name, kind ORDER BY line) AS ordinal FROM s WHERE line > 10), n AS (SELECT file_id, name, kind, CASE WHEN line % 3 = 0 THEN reverse(content_hash) ELSE content_hash END AS now, row_number() OVER (PARTITION BY file_id, name, kind ORDER BY line) AS ordinal FROM s WHERE removed_at IS NULL) SELECT o.id, coalesce(o.file_id, n.file_id) AS file_id, coalesce(o.name, n.name) AS name, coalesce(o.kind, n.kind) AS kind, CAST(coalesce(o.ordinal, n.ordinal) AS INT) AS ordinal, CASE WHEN o.file_id IS NULL THEN 'new' WHEN n.file_id IS NULL THEN 'removed' WHEN was IS NOT DISTINCT FROM now THEN 'unchanged' ELSE 'changed' END AS state FROM n FULL JOIN o ON n.file_id = o.file_id AND n.name = o.name AND n.kind = o.kind AND n.ordinal = o.ordinal",
    "path_upsert": "WITH p AS (SELECT DISTINCT * FROM file_paths), o AS (SELECT path, arg_max((file_id, mtime), (seen_at, file_id)) AS r FROM p WHERE seen_at < TIMESTAMP '2025-10-01' GROUP BY path), n AS (SELECT path, arg_max((file_id, mtime), (seen_at, file_id)) AS r FROM p WHERE seen_at >= TIMESTAMP '2025-10-01' GROUP BY path) SELECT n.path, n.r[1] AS file_id, n.r[2] AS mtime, CASE WHEN o.path IS NULL THEN 'added' WHEN o.r[1] != n.r[1] THEN 'changed' WHEN o.r[2] IS NOT DISTINCT FROM n.r[2] THEN 'skipped' ELSE 'touched' END AS state FROM n LEFT JOIN o USING (path)",
    "stale_findings": f"{VIEWS}, {_F} SELECT CASE WHEN s.file_id IN (SELECT file_id FROM files WHERE removed_at IS NOT NULL) THEN true ELSE stale END AS stale, count(*) AS n FROM f JOIN sym s ON s.id = symbol_id GROUP BY 1",
    "orphan_files": f"{VIEWS} SELECT file_id, hash FROM live_files WHERE file_id NOT IN (SELECT file_id FROM paths WHERE file_id IS NOT NULL AND NOT {UNDER('/srv/code/quartzline')})",
    "purge_cascade": f"{VIEWS}, p AS (SELECT * FROM paths WHERE path NOT IN (SELECT path FROM paths WHERE path ILIKE '%/old/%')), fl AS (SELECT * FROM live_files WHERE file_id IN (SELECT file_id FROM p)), s AS (SELECT * FROM sym WHERE file_id IN (SELECT file_id FROM fl)) SELECT 'file_paths' AS table, count(*) AS n FROM p UNION ALL SELECT 'files', count(*) FROM fl UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'code_blocks', count(*) FROM blocks WHERE symbol_id IN (SELECT id FROM s) UNION ALL SELECT 'symbol_refs', count(*) FROM refs WHERE caller_id IN (SELECT id FROM s) AND callee_id IN (SELECT id FROM s) UNION ALL SELECT 'external_refs', count(*) FROM ext WHERE caller_id IN (SELECT id FROM s)",
    "purge_folders": "SELECT DISTINCT path FROM file_paths WHERE starts_with(replace(path, '\\', '/') || '/', '/srv/code/quartzline/') OR starts_with(replace(path, '\\', '/') || '/', 'K:/code/millstone/')",
    "resolve_references": f"{VIEWS}, fn AS (SELECT * FROM sym WHERE kind IN ('function', 'method')) SELECT * FROM (SELECT DISTINCT e.caller_id, e.callee_name, coalesce((SELECT min(id) FROM fn WHERE fn.name = e.callee_name AND fn.file_id = c.file_id), (SELECT min(id) FROM fn WHERE fn.name = e.callee_name)) AS callee_id FROM ext e JOIN sym c ON c.id = e.caller_id) WHERE callee_id IS NOT NULL AND callee_id != caller_id",
    "enclosing_symbol": f"{NESTED} SELECT a.id, b.id AS outer_id, b.name AS outer_name FROM sym a JOIN sym b ON a.file_id = b.file_id AND b.line <= a.line AND b.end_line >= a.line AND b.id != a.id WHERE a.kind IN ('function', 'method', 'field', 'variable') AND b.kind IN ('class', 'struct', 'interface', 'function', 'method') QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.line DESC, b.id) = 1",
    "missing_embeddings": f"{VIEWS} SELECT DISTINCT content_hash FROM blocks WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM block_embeddings WHERE model = 'codevec-s' AND vector IS NOT NULL AND content_hash IS NOT NULL)",
    "rescan": f"{VIEWS} SELECT DISTINCT file_id, 10 AS priority FROM paths WHERE {UNDER('/srv/code/quartzline')} AND lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1)) IN ('.py', '.go')",
    "transcript_turns": f"WITH {_TURNS} SELECT session_id, row_id, role, text FROM turns",
    "transcript_budget": f"WITH {_TURNS}, {_KEPT} SELECT session_id, row_id, used FROM kept",
    "transcript_texts": f"WITH {_TURNS}, {_KEPT}, b AS (SELECT session_id, string_agg(voice, chr(10) ORDER BY recorded_at, row_id) AS t FROM kept GROUP BY ALL), {_FILES}, g AS (SELECT session_id, string_agg(file, chr(10) ORDER BY file) AS l FROM files_named GROUP BY ALL) SELECT session_id, md5(CASE WHEN l IS NOT NULL THEN 'Files referenced in this session:' || chr(10) || l || chr(10) || chr(10) ELSE '' END || coalesce(t, '')) AS text_md5 FROM (SELECT DISTINCT session_id FROM turns) LEFT JOIN b USING (session_id) LEFT JOIN g USING (session_id)",
    "speaker_runs": _RUNS + " SELECT session_id, run, role, n, md5(text) AS text_md5 FROM runs",
    # the windows step by size - overlap = 3; from the second on they begin overlap = 1 runs earlier, and each holds at most size = 4
    "turn_windows": _RUNS + _WINDOWS + " SELECT session_id, chunk, CAST(lo + 1 AS INT) AS first_run, hi - lo AS n_runs FROM windows",
    "window_texts": _RUNS + _WINDOWS + " SELECT session_id, chunk, md5(regexp_replace(string_agg(voices, chr(10) ORDER BY run), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS text_md5 FROM windows JOIN runs USING (session_id) WHERE run > lo AND run <= hi GROUP BY session_id, chunk",
    "knowledge_surface": f"WITH {_K} SELECT id, concept, CASE WHEN (1767225600 - created_at) // 86400 < 1 THEN 'today' ELSE (1767225600 - created_at) // 86400 || 'd old' END AS age FROM k WHERE suppressed_at IS NULL AND (pattern = '**' OR EXISTS (SELECT 1 FROM file_paths p WHERE regexp_matches(replace(p.path, '\\', '/'), '^(?:.*/)?' || replace(pattern, '*', '.*') || '$')))",
    "knowledge_refine": f"WITH {_K}, x AS (SELECT *, length('Is it about one task only? ' || body) % 3 = 0 AS once, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS neat FROM k) SELECT id, md5(neat) AS body_md5, CASE WHEN neat != body THEN 'update' ELSE '' END AS done FROM x WHERE NOT coalesce(once, false)",
    "knowledge_fact_check": f"WITH {_K}, x AS (SELECT *, CASE WHEN id % 3 != 0 THEN length('Claim: ' || body || chr(10) || '1: ' || CASE WHEN source_dir = '' THEN '.' ELSE source_dir END) END AS n FROM (SELECT *, regexp_replace(regexp_replace(pattern, '[*].*$', ''), '/+$', '') AS source_dir FROM k)) SELECT id, CAST(CASE WHEN n % 2 = 1 THEN 7 ELSE suppressed_at END AS BIGINT) AS suppressed_at, CAST(CASE WHEN n IS NOT NULL THEN 7 END AS BIGINT) AS fact_checked_at FROM x",
    "knowledge_stored": "SELECT * FROM (VALUES ('a', 'x/*', 'first'), ('b', '**', 'second')) t(concept, pattern, body)",
    "knowledge_surfaced": f"WITH {_K}, shown AS (SELECT id FROM k WHERE suppressed_at IS NULL AND (pattern = '**' OR EXISTS (SELECT 1 FROM file_paths p WHERE {UNDER('/srv/code/ironbark')} AND regexp_matches(replace(p.path, '\\', '/'), '^(?:.*/)?' || replace(pattern, '*', '.*') || '$')))) SELECT id, CAST(CASE WHEN id IN (FROM shown) THEN 3 ELSE 2 END AS BIGINT) AS surfaced_count FROM k",
    "knowledge_deduplicated": f"WITH {_K}, {_SAID}, gone AS (SELECT id FROM said WHERE id % 3 = 0), m AS (SELECT other AS id, arg_min((pattern, n), s.id) AS m FROM said s JOIN (SELECT id, pattern FROM k) USING (id) WHERE id % 3 = 0 AND other NOT IN (FROM gone) GROUP BY other), c AS (SELECT CASE WHEN a.created_at < b.created_at THEN s.id ELSE other END AS id FROM said s JOIN k a ON a.id = s.id JOIN k b ON b.id = other WHERE s.id % 3 = 1 AND other NOT IN (FROM gone)) SELECT k.id, concept, CASE WHEN m IS NULL OR k.pattern != '**' THEN k.pattern ELSE m[1] END AS pattern, md5(coalesce(m[2]::VARCHAR, body)) AS body_md5, CAST(CASE WHEN k.id IN (FROM c) THEN 9 ELSE suppressed_at END AS BIGINT) AS suppressed_at FROM k LEFT JOIN m USING (id) WHERE k.id NOT IN (FROM gone)",
    "knowledge_contradictions": f"WITH {_K}, {_SAID} SELECT id AS id_a, other AS id_b FROM said WHERE id % 3 = 1 AND other NOT IN (SELECT id FROM said WHERE id % 3 = 0)",
    "knowledge_embedded": f"WITH {_K}, q AS (SELECT *, id % 3 AS attempts FROM k), e AS (SELECT id, length(body) % 5 != 0 AS fine, length(body) AS n, length(body) - length(replace(body, ' ', '')) AS b, attempts FROM q WHERE id % 2 = 0 AND body IS NOT NULL) SELECT 'vector' AS part, id, n || ',' || b AS value FROM e WHERE fine UNION ALL SELECT 'dedup', id, '' FROM e WHERE fine UNION ALL SELECT 'queue', id, CASE WHEN attempts + 1 >= 3 THEN 'failed ' ELSE 'pending ' END || (attempts + 1) FROM e WHERE NOT fine UNION ALL SELECT 'queue', id, 'done ' || attempts FROM q WHERE id % 2 = 1",
    "knowledge_parse": f"WITH {_K} SELECT id, trim(substr(concept, 1, 10)) AS concept, CASE WHEN suppressed_at IS NULL THEN pattern ELSE '**' END AS pattern, 'b' AS body FROM k WHERE trim(substr(concept, 1, 10)) != ''",
    "knowledge_similar": "WITH v AS (SELECT DISTINCT id, CAST(vector AS DOUBLE[]) AS v FROM knowledge_embeddings WHERE vector IS NOT NULL AND list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) > 0), p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id != b.id AND len(a.v) = len(b.v)) SELECT id, other, round(s, 6) AS similarity FROM p WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY other) = 1",
    "pending_symbols": f"{VIEWS}, {_F}, {_PEND} SELECT id, name, path, line FROM pend WHERE id NOT IN (SELECT symbol_id FROM f WHERE confidence > 0.5 AND rule_id IN (2, 3))",
    "file_prompts": f"{VIEWS}, {_PEND}, g AS (SELECT path, string_agg('## ' || name || chr(10) || CASE WHEN length(content) <= 600 THEN content ELSE substr(content, 1, 597) || '...' END, chr(10) || chr(10) ORDER BY line, id) AS p FROM pend WHERE content IS NOT NULL GROUP BY path), c AS (SELECT path, CASE WHEN length(p) <= 12000 THEN p ELSE substr(p, 1, 11997) || '...' END AS p FROM g) SELECT path, md5(p) AS prompt_md5, CAST(length(p) AS INT) AS n FROM c",
    "parse_findings": f"{VIEWS} SELECT id, CAST(2 AS BIGINT) AS rule_id, name AS message, line % 10 / 10.0::DOUBLE AS confidence FROM sym WHERE line % 2 = 0 AND line % 10 / 10.0::DOUBLE >= 0.4",
    "reset_findings": f"{VIEWS}, {_F} SELECT CAST(rule_id AS BIGINT) AS rule_id, count(*) AS n FROM f WHERE NOT (rule_id IN (2, 3) AND symbol_id IN (SELECT id FROM sym JOIN paths USING (file_id) WHERE path ILIKE '%/srv/code/quartzline/%')) GROUP BY ALL",
    "register_rules": "SELECT * FROM (VALUES ('style', 'naming', 'info'), ('style', 'size', 'error'), ('bugs', 'leak', 'error'), ('bugs', 'race', 'error'), ('docs', 'missing', 'info')) t(analyzer, rule_name, severity)",
    # name(params): description, place, callers, callees, code of functions; a later block has its own description
    "embedding_text": f"{VIEWS}, {_ETEXT} SELECT id, md5(text) AS text_md5 FROM etext",
    "embed_blocks": f"{VIEWS}, {_ETEXT}, t AS (SELECT content_hash, arg_min(text, etext.id) AS text FROM etext JOIN blocks USING (id) WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM block_embeddings WHERE model = 'codevec-xs' AND vector IS NOT NULL AND content_hash IS NOT NULL) GROUP BY ALL) SELECT content_hash, CASE WHEN length(text) % 5 != 0 THEN length(text) || ',' || (length(text) - length(replace(text, ' ', ''))) ELSE '' END AS value, CASE WHEN length(text) % 5 = 0 THEN 'no' END AS error FROM t",
    "described_blocks": f"{VIEWS}, {_DESC} SELECT b.id, coalesce(b.description, said) AS description FROM blocks b LEFT JOIN said USING (id)",
    "described_symbols": f"{VIEWS}, {_DESC} SELECT s.id, coalesce((SELECT arg_min(said, b.id) FROM blocks b JOIN said USING (id) WHERE b.symbol_id = s.id AND block_index = 0 AND said IS NOT NULL), s.description) AS description FROM sym s",
    "more_scalars": f"{VIEWS} SELECT id, CASE line % 3 WHEN 0 THEN name WHEN 1 THEN kind ELSE '' END AS branch, CASE WHEN line % 2 = 0 THEN kind ELSE kind || '/a' END AS dir, printf('%.2f', line / 16.0::DOUBLE) AS shown FROM sym",
    "outermost_callers": f"{NESTED}, calls AS (SELECT DISTINCT file_id, line, name AS callee FROM sym WHERE kind IN ('field', 'variable', 'function')) SELECT c.file_id, c.line, c.callee, arg_min(f.id, (f.line, coalesce(f.end_line, f.line), f.name)) AS caller_id FROM calls c JOIN sym f ON f.file_id = c.file_id AND c.line BETWEEN f.line AND coalesce(f.end_line, f.line) WHERE f.kind IN ('class', 'struct', 'interface') GROUP BY ALL",
    "purge_reasons": "WITH p AS (SELECT DISTINCT path, replace(path, '\\', '/') AS q FROM file_paths), x AS (SELECT path, CASE WHEN starts_with(q || '/', '/srv/code/quartzline/') THEN 'explicit' WHEN path LIKE '%.ts%' THEN 'missing' WHEN starts_with(q || '/', '/srv/code/hazelnut/') THEN 'worktree' WHEN regexp_matches(q, '^/srv/code/(.*/)?tests/.+') OR (starts_with(q, '/srv/code/jaybird/') AND lower(q) LIKE '%.go') OR regexp_matches(q, '(?i)^/srv/(.*/)?mock_[^/]*$') THEN 'ignored' END AS reason FROM p) SELECT * FROM x WHERE reason IS NOT NULL",
    "ignored_by_rules": "WITH p AS (SELECT DISTINCT path, lower(replace(path, '\\', '/')) AS q FROM file_paths), b AS (SELECT *, regexp_extract(q, '([^/]*)$', 1) AS base FROM p) SELECT path FROM b WHERE (starts_with(replace(path, '\\', '/'), '/srv/code/') AND (q LIKE '%.md' OR regexp_matches(q, '^/srv/code/(.*/)?vendor/.+') OR starts_with(base, 'gavi') OR regexp_matches(base, '_vipo[^/]*$') OR regexp_matches(q, '^/srv/code/src/[^/]*/valve[^/]*$') OR base = 'makefile')) OR (starts_with(replace(path, '\\', '/'), '/srv/code/ironbark/') AND regexp_matches(q, '^/srv/code/ironbark/(.*/)?src/.+'))",
    "folder_diff": "WITH p AS (SELECT file_id, CASE WHEN contains(replace(path, '\\', '/'), '/') THEN regexp_replace(replace(path, '\\', '/'), '/[^/]*$', '') ELSE '' END AS dir FROM file_paths), o AS (SELECT DISTINCT dir FROM p WHERE file_id % 2 = 0), n AS (SELECT DISTINCT dir FROM p WHERE file_id % 3 = 0) SELECT dir, 'added' AS change FROM n WHERE dir NOT IN (FROM o) UNION ALL SELECT dir, 'removed' FROM o WHERE dir NOT IN (FROM n)",
    "snapshot_changes": f"{VIEWS}, p AS (SELECT path, min(hash) AS hash FROM paths JOIN live_files USING (file_id) GROUP BY path), x AS (SELECT path, CASE WHEN hash >= 'c' THEN 'create' WHEN hash <= '4' THEN 'remove' WHEN length(path) % 4 = 0 AND reverse(hash) != hash THEN 'modify' END AS event FROM p) SELECT * FROM x WHERE event IS NOT NULL",
    "direct_files": "WITH p AS (SELECT DISTINCT path, file_id, CASE WHEN contains(replace(path, '\\', '/'), '/') THEN regexp_replace(replace(path, '\\', '/'), '/[^/]*$', '') ELSE '' END AS dir FROM file_paths) SELECT DISTINCT path FROM p WHERE dir IN (SELECT dir FROM p WHERE file_id % 5 = 0)",
    "scalar_functions": f"{VIEWS}, s AS (SELECT *, replace(path, '\\', '/') AS p FROM sym JOIN paths USING (file_id)) SELECT id, path, CASE WHEN p LIKE '%/%' THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(p, '([^/]*)$', 1) AS base, lower(regexp_extract(p, '[^./](\\.[^./]*)$', 1)) AS ext, CASE WHEN coalesce(trim(params), '') = '' THEN 0 ELSE CAST(1 + length(regexp_replace(regexp_replace(regexp_replace(params, '\\([^()\\[\\]{{}}<>]*\\)|\\[[^()\\[\\]{{}}<>]*\\]|<[^()\\[\\]{{}}<>]*>', '', 'g'), '\\([^()\\[\\]{{}}<>]*\\)|\\[[^()\\[\\]{{}}<>]*\\]|<[^()\\[\\]{{}}<>]*>', '', 'g'), '[^,]', '', 'g')) AS INT) END AS n_params, CASE WHEN length(name) <= 12 THEN name ELSE substr(name, 1, 9) || '...' END AS short, substr(sha256(snippet), 1, 16) AS hash, translate(params, '{{}}', '()') AS braces, {_ETA.format(x='(line * 97)')} AS eta, CASE WHEN line * 977 < 86400 THEN 'today' ELSE line * 977 // 86400 || 'd old' END AS age, round(1.0::DOUBLE / (61 + line), 9) AS rrf FROM s",
}

_EDIT = "WITH s AS (SELECT DISTINCT id, file_id, name, kind, line, end_line, snippet, content_hash, description FROM symbols WHERE removed_at IS NULL), o AS (SELECT *, row_number() OVER (PARTITION BY file_id, name, kind ORDER BY line) AS ordinal FROM s WHERE line % 5 != 0 AND file_id % 7 != 0), n AS (SELECT *, CASE WHEN line % 3 = 0 THEN reverse(content_hash) ELSE content_hash END AS now, row_number() OVER (PARTITION BY file_id, name, kind ORDER BY line) AS ordinal FROM s WHERE line % 4 != 0), x AS (SELECT o.id AS kept_id, n.file_id, n.name, n.kind, n.line, n.snippet, o.description AS old_description, CASE WHEN o.id IS NULL THEN 'new' WHEN o.content_hash IS NOT DISTINCT FROM n.now THEN 'unchanged' ELSE 'changed' END AS state FROM n LEFT JOIN o USING (file_id, name, kind, ordinal))"
_TOUCHED = "t AS (SELECT *, CASE WHEN file_id IN (SELECT file_id FROM o) THEN 2 ELSE 1 END AS priority FROM x WHERE state != 'unchanged')"
SQL |= {
    "maintained_symbols": _EDIT + " SELECT file_id, name, kind, line, CASE WHEN state = 'unchanged' THEN old_description END AS description, state FROM x",
    "maintained_blocks": _EDIT + " SELECT state, count(*) AS blocks, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT state, b.content FROM x JOIN (SELECT DISTINCT id, symbol_id, content FROM code_blocks) b ON b.symbol_id = kept_id WHERE state = 'unchanged' UNION ALL SELECT state, coalesce(snippet, '') FROM x WHERE state != 'unchanged') GROUP BY state",
    "downstream_queues": _EDIT + f", {_TOUCHED} SELECT queue, priority, count(*) AS n FROM (SELECT unnest(['describe', 'embed']) AS queue, priority FROM t UNION ALL SELECT 'fingerprint', priority FROM t WHERE kind IN ('function', 'method')) GROUP BY ALL",
    "file_findings": f"{VIEWS}, s AS (SELECT path, id, name, line FROM sym JOIN paths USING (file_id)), m AS (SELECT path, name, max(id) AS symbol_id FROM s GROUP BY ALL), f AS (SELECT symbol_id, CASE WHEN line % 2 = 0 THEN 2 ELSE 3 END AS rule_id, 'm' || line AS message, line % 10 / 10.0::DOUBLE AS confidence FROM s JOIN m USING (path, name) WHERE line % 3 != 0 AND line % 10 / 10.0::DOUBLE >= 0.4) SELECT symbol_id, CAST(rule_id AS BIGINT) AS rule_id, arg_max(message, (confidence, message)) AS message, max(confidence) AS confidence FROM f GROUP BY ALL",
    "vector_roundtrip": "SELECT vec_id, count(*) AS n, CAST(sum(len(vector) * 4) AS BIGINT) AS bytes, true AS same FROM block_embeddings GROUP BY vec_id",
    "chunk_check": f"{VIEWS} SELECT count(*) AS symbols, 0::BIGINT AS wrong, 0::BIGINT AS unordered, 0::BIGINT AS lost FROM sym",
    "pending_limited": SQL["pending_symbols"] + " ORDER BY path, line, id LIMIT 7",
}

#: What is in the templates: file, name, kind, first and last line, parameters, depth, callees, visibility, static.
_EXTRACTED = """
  (0, 'package.json', '§', 'package', 1, 1, 0, 0, '', '', ''), (1, 'ci.yml', '§', 'job', 1, 1, 0, 0, '', '', ''), (1, 'ci.yml', 'second', 'config-key', 1, 1, 0, 0, '', '', ''),
  (2, 'a.go', 'pk.§', 'type', 3, 5, 0, 0, '', 'public', ''), (2, 'a.go', 'pk.§.Run', 'method', 8, 13, 2, 0, 'pk.Free,pk.§.stop', 'public', ''), (2, 'a.go', 'pk.§.stop', 'method', 15, 17, 1, 0, '', 'private', ''), (2, 'a.go', 'pk.Free', 'function', 19, 19, 1, 0, '', 'public', ''),
  (3, 'a.cs', 'N.M.§', 'class', 3, 14, 0, 1, '', 'public', ''), (3, 'a.cs', 'N.M.§.Add', 'method', 5, 8, 2, 2, 'N.M.§.Sum', 'private', 'true'), (3, 'a.cs', 'N.M.§.Sum', 'method', 10, 13, 1, 2, 'Take', 'public', ''),
  (4, 'a.py', 'a.§', 'class', 1, 9, 0, 0, '', 'public', ''), (4, 'a.py', 'a.§.X', 'variable', 2, 2, 0, 1, '', 'public', ''), (4, 'a.py', 'a.§.make', 'method', 5, 6, 2, 1, 'a.free', 'public', ''), (4, 'a.py', 'a.§._run', 'method', 8, 9, 1, 1, 'a.§.make', 'private', ''), (4, 'a.py', 'a.free', 'function', 12, 13, 1, 0, '', 'public', ''),
  (5, 'a.ts', '§', 'class', 1, 7, 0, 0, '', '', ''), (5, 'a.ts', '§.go', 'method', 2, 4, 2, 1, '§.stop', '', ''), (5, 'a.ts', '§.stop', 'method', 5, 6, 0, 1, '', '', ''), (5, 'a.ts', 'f', 'function', 8, 10, 1, 0, '', '', '')"""
SQL["extracted_symbols"] = f"{VIEWS}, t(k, file, name, kind, line, end_line, param_count, nesting_depth, calls, visibility, is_static) AS (VALUES {_EXTRACTED}) SELECT 'd' || id || '/' || file AS path, replace(t.name, '§', 'T' || id) AS name, t.kind, t.line, t.end_line, t.param_count, t.nesting_depth, replace(calls, '§', 'T' || id) AS calls, visibility, is_static FROM sym JOIN t ON t.k = id % 6"

# a block ends with the line that brings it to 600 characters, but not with its first
SQL["line_chunks"] = f"""{VIEWS.replace('WITH sym AS', 'WITH RECURSIVE sym AS', 1)}, t AS (SELECT id, snippet, line, coalesce(end_line, line) AS end_line, string_split(snippet, chr(10)) AS l FROM sym WHERE snippet IS NOT NULL AND line IS NOT NULL),
walk AS (SELECT id, 1 AS i, 1 AS first, len(l[1]) + 1 AS size FROM t WHERE length(snippet) > 600
  UNION ALL SELECT w.id, w.i + 1, CASE WHEN w.size >= 600 AND w.i > w.first THEN w.i + 1 ELSE w.first END, CASE WHEN w.size >= 600 AND w.i > w.first THEN 0 ELSE w.size END + len(t.l[w.i + 1]) + 1 FROM walk w JOIN t USING (id) WHERE w.i < len(t.l)),
parts AS (SELECT id, first, max(i) AS last FROM walk GROUP BY ALL),
b AS (SELECT p.id, first, last, array_to_string(t.l[first:last], chr(10)) AS content, last = len(t.l) AS closes FROM parts p JOIN t USING (id)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM b WHERE regexp_matches(content, '[^\\s]')),
g AS (SELECT t.id, coalesce(k, 0) AS k, CASE WHEN coalesce(n, 1) < 2 THEN line ELSE line + first - 1 END AS s, CASE WHEN coalesce(n, 1) < 2 OR closes THEN end_line ELSE line + last - 1 END AS e, CASE WHEN coalesce(n, 1) < 2 THEN snippet ELSE content END AS c FROM t LEFT JOIN f USING (id))
SELECT id AS symbol_id, count(*) AS blocks, arg_max(s, k) AS last_start, arg_max(e, k) AS last_end, md5(string_agg(substr(sha256(c), 1, 16), ',' ORDER BY k)) AS hashes FROM g GROUP BY id"""
