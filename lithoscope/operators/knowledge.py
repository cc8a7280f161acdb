"""Transcripts to text, knowledge items and their surfacing, deduplication and refinement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lithoscope.functions.text import first_json, format_age, glob_directory, glob_regex, slashes, strip

#: Inputs of a tool call that name a file.
FILE_KEYS = ("file_path", "path", "notebook_path", "filePath")
TOOL_BLOCKS = "array<struct<type string, input map<string, string>>>"
TEXT_BLOCKS = "array<struct<type string, text string>>"
KNOWLEDGE = "array<struct<concept string, pattern string, body string, importance int>>"


def message_text(message: Column, content: Column) -> Column:
    """The text of a transcript row: a string, or the text blocks joined by blanks; null where the JSON is broken."""
    body = F.variant_get(F.try_parse_json(message), "$.content", "variant")
    kind = F.schema_of_variant(body)
    blocks = F.from_json(F.to_json(body), TEXT_BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " ")
    return F.when(message.isNull(), content).when(kind == "STRING", F.try_variant_get(body, "$", "string")).when(kind.startswith("ARRAY"), joined)


def transcript_turns(rows: DataFrame) -> DataFrame:
    """`session_id, row_id, recorded_at, role, text` of user and assistant rows with text."""
    role = F.lower(F.trim("type"))
    t = rows.select("session_id", "row_id", "recorded_at", role.alias("role"), message_text(F.col("message"), F.col("content")).alias("text"))
    return t.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def file_references(rows: DataFrame) -> DataFrame:
    """`session_id, file`: the files that tool calls in the messages name, distinct."""
    body = F.variant_get(F.try_parse_json("message"), "$.content", "variant")
    calls = F.filter(F.from_json(F.to_json(F.when(F.schema_of_variant(body).startswith("ARRAY"), body)), TOOL_BLOCKS), lambda b: b["type"] == "tool_use")
    named = F.flatten(F.transform(calls, lambda b: F.array(*[b["input"][k] for k in FILE_KEYS])))
    turn = F.lower(F.trim("type")).isin("user", "assistant")
    return rows.where(turn).select("session_id", F.explode(named).alias("file")).where("file is not null and file != ''").distinct()


def voice() -> Column:
    """A turn as a line of a transcript."""
    return F.concat("role", F.lit(": "), strip("text"))


def within_budget(turns: DataFrame, max_chars: int) -> DataFrame:
    """The newest turns of each session whose lines (`role: text`) together fit, up to the first that doesn't."""
    w = Window.partitionBy("session_id").orderBy(F.desc("recorded_at"), F.desc("row_id")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(F.length(voice())).over(w)).where(F.col("used") <= max_chars)


def transcript_text(turns: DataFrame, max_chars: int, files: DataFrame | None = None) -> DataFrame:
    """`session_id, text`: the lines of the newest turns within the budget, in order.

    files(session_id, file) are listed in front, each once.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("recorded_at", "row_id", voice().alias("line")))), lambda x: x["line"])
    out = within_budget(turns, max_chars).groupBy("session_id").agg(F.array_join(lines, "\n").alias("text"))
    if files is None:
        return out
    head = files.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("file")), "\n").alias("listed"))
    both = F.concat(F.lit("Files referenced in this session:\n"), "listed", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return turns.select("session_id").distinct().join(out, "session_id", "left").join(head, "session_id", "left").select("session_id", F.coalesce(F.when(F.col("listed").isNotNull(), both), "text", F.lit("")).alias("text"))


def speaker_runs(turns: DataFrame) -> DataFrame:
    """`session_id, run, role, n, text, voices`: consecutive turns of one speaker as one; `voices`: as lines with the role."""
    w = Window.partitionBy("session_id").orderBy("recorded_at", "row_id")
    t = turns.withColumn("first", (F.coalesce(F.lag("role").over(w), F.lit("")) != F.col("role")).cast("int")).withColumn("run", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("session_id", "run", "role").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("recorded_at", "row_id", "text", voice().alias("line")))).alias("l"))
    return g.select("session_id", "run", "role", "n", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("voices"))


def turn_windows(runs: DataFrame, size: int = 20, overlap: int = 4) -> DataFrame:
    """`session_id, chunk, first_run, n_runs`: windows of at most `size` runs.

    They step by `size - overlap`; all but the first begin `overlap` runs before their step.
    """
    step = max(1, size - overlap)
    n = runs.groupBy("session_id").agg(F.max("run").alias("runs"))
    c = n.select("session_id", "runs", F.explode(F.sequence(F.lit(0), F.floor((F.col("runs") - 1) / step).cast("int"))).alias("chunk"))
    start = F.greatest(F.lit(0), F.col("chunk") * step - F.when(F.col("chunk") > 0, overlap).otherwise(0))
    return c.select("session_id", "chunk", (start + 1).alias("first_run"), F.least(F.col("runs"), start + size).alias("last_run")).select("session_id", "chunk", "first_run", (F.col("last_run") - F.col("first_run") + 1).alias("n_runs"))


def window_texts(runs: DataFrame, size: int = 20, overlap: int = 4) -> DataFrame:
    """`session_id, chunk, text`: the lines of each window's runs."""
    w = turn_windows(runs, size, overlap)
    w = w.select("session_id", "chunk", F.explode(F.sequence("first_run", F.col("first_run") + F.col("n_runs").cast("int") - 1)).alias("run"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("run", "voices"))), lambda x: x["voices"])
    return w.join(runs.select("session_id", F.col("run").cast("int").alias("run"), "voices"), ["session_id", "run"]).groupBy("session_id", "chunk").agg(strip(F.array_join(joined, "\n")).alias("text"))


def parse_knowledge(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """`key, concept, pattern, body` of a model's answers; items need concept and body, the pattern defaults to `**`."""
    items = F.explode(F.from_json(first_json(answer), KNOWLEDGE))
    x = answers.select(key, items.alias("k")).select(key, F.trim("k.concept").alias("concept"), F.coalesce(F.nullif(F.trim("k.pattern"), F.lit("")), F.lit("**")).alias("pattern"), F.trim("k.body").alias("body"))
    return x.where("concept != '' and body != ''")


def surface(knowledge: DataFrame, paths: DataFrame, seen: DataFrame | None, now: Column) -> DataFrame:
    """`id, concept, body, age` of items whose glob meets a path from some slash on, not suppressed, each once per session.

    Wide globs need no comparison; the others are bounded by their literal last part
    or first directory before the pattern itself is tried.
    """
    k = knowledge.where("suppressed_at is null")
    if seen is not None:
        k = k.join(seen.select("id").distinct(), "id", "left_anti")
    wide = F.col("pattern").isin("*", "**", "**/*")
    any_path = paths.limit(1)
    broad = k.where(wide).join(any_path.select(F.lit(True).alias("_p")), F.lit(True), "left_semi")
    narrow = k.where(~wide).withColumn("rx", glob_regex("pattern", True))
    # a literal part of the glob must be one of the path's parts: an equi-join
    literal = F.element_at(F.concat(F.filter(F.split(slashes("pattern"), "/"), lambda x: (x != "") & ~x.rlike(r"[*?\[]")), F.array(F.lit("\0"))), 1)
    parts = paths.select(slashes("path").alias("p"), F.explode(F.array_distinct(F.concat(F.split(slashes("path"), "/"), F.array(F.lit("\0"))))).alias("part"))
    hit = narrow.withColumn("part", literal).join(parts, "part").where(F.expr("p rlike rx")).select(*knowledge.columns).distinct()
    return broad.unionByName(hit).orderBy("created_at", "id").select("id", "concept", "body", format_age(now - F.col("created_at")).alias("age"))


def store(knowledge: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Knowledge with new(concept, pattern, body[, source]) added, under ids after the largest one; source `explicit` unless given."""
    last = knowledge.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    source = F.coalesce("source", F.lit("explicit")) if "source" in new.columns else F.lit("explicit")
    made = {"created_at": now, "surfaced_count": F.lit(0), "source": source}
    rows = new.withColumn("n", F.row_number().over(Window.orderBy("concept", "body")))  # items typed in by hand
    rows = rows.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("id"), "concept", "pattern", "body", *[v.alias(k) for k, v in made.items() if k in knowledge.columns])
    return knowledge.unionByName(rows, allowMissingColumns=True)


def count_surfaced(knowledge: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Knowledge with `surfaced_count` one higher for each time that an item was surfaced(id)."""
    n = surfaced.groupBy("id").agg(F.count("*").alias("_n"))
    return knowledge.join(n, "id", "left").withColumn("surfaced_count", (F.coalesce("surfaced_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint")).select(*knowledge.columns)


class Session:
    """What one session has been shown: items come up once until a reset."""

    def __init__(self):
        self.seen: DataFrame | None = None

    def hints(self, knowledge: DataFrame, paths: DataFrame, now: Column) -> DataFrame:
        from lithoscope.session import materialise

        got = materialise(surface(knowledge, paths, self.seen, now), "hints")
        self.seen = got.select("id") if self.seen is None else self.seen.unionByName(got.select("id"))
        return got

    def reset(self) -> None:
        self.seen = None


def first_similar(items: DataFrame, least: float = 0.85, block: int = 512) -> DataFrame:
    """`id, other, similarity`: of each item(id, v) the other of smallest id that is at least so similar.

    With a column `model`, only items of one model are compared.
    """
    from lithoscope.operators.clones import semantic_pairs

    p = semantic_pairs(items, 1 - least + 1e-12, k=1, block=block, by_id=True)
    return p.select(F.col("a").alias("id"), F.col("b").alias("other"), (1 - F.col("distance")).alias("similarity"))


VERDICT = "struct<action string, concept string, pattern string, body string>"


def classify_prompts(similar: DataFrame, knowledge: DataFrame, template: str) -> DataFrame:
    """`id, other, prompt`: a question about each similar pair; the template names {body_a} (new) and {body_b} (old)."""
    a = knowledge.select("id", F.col("body").alias("a"))
    b = knowledge.select(F.col("id").alias("other"), F.col("body").alias("b"))
    text = F.replace(F.replace(F.lit(template), F.lit("{body_a}"), F.col("a")), F.lit("{body_b}"), F.col("b"))
    return similar.select("id", "other").join(a, "id").join(b, "other").select("id", "other", text.alias("prompt"))


def deduplicate(knowledge: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Knowledge after answers(id, other, answer) about similar pairs, and the contradictions (id_a, id_b) found.

    `merge`: the old item takes concept, pattern and body of the answer (its own where
    the answer has none; a pattern of its own rather than `**`) and gains importance, the
    new one goes. `contradict`: the older of the two, the old item in a tie, is suppressed.
    Anything else changes nothing. An item merged away takes no part in other pairs.
    """
    v = answers.select("id", "other", F.from_json(first_json("answer", "object"), VERDICT).alias("v")).select("id", "other", "v.*")
    gone = v.where("action = 'merge'").select("id").distinct()
    new = knowledge.select("id", F.col("pattern").alias("new_pattern"))
    merge = v.where("action = 'merge'").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").join(new, "id")
    merge = merge.groupBy(F.col("other").alias("id")).agg(F.min_by(F.struct("concept", F.col("pattern").alias("said"), "new_pattern", "body"), "id").alias("m"), F.count("*").alias("gained"))
    live = v.where("action = 'contradict'").join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti")
    times = knowledge.select("id", F.coalesce("created_at", F.lit(0)).alias("t"))
    against = live.join(times.withColumnRenamed("t", "t_new"), "id").join(times.select(F.col("id").alias("other"), F.col("t").alias("t_old")), "other")
    older = against.select(F.when(F.col("t_new") < F.col("t_old"), F.col("id")).otherwise(F.col("other")).alias("id")).distinct().withColumn("_older", F.lit(True))
    k = knowledge.join(gone, "id", "left_anti").join(merge, "id", "left").join(older, "id", "left")
    own = F.when(F.col("pattern") != "**", F.col("pattern")).otherwise(F.col("m.new_pattern"))
    merged = F.col("m").isNotNull()
    change = {
        "concept": F.coalesce("m.concept", "concept"), "pattern": F.when(merged, F.coalesce("m.said", own)).otherwise(F.col("pattern")), "body": F.coalesce("m.body", "body"),
        "importance": F.coalesce("importance", F.lit(0)) + F.coalesce("gained", F.lit(0)) if "importance" in knowledge.columns else None,
        "suppressed_at": F.when(F.col("_older"), now).otherwise(F.col("suppressed_at")) if "suppressed_at" in knowledge.columns else None,
    }
    out = k.select(*[change[c].alias(c) if change.get(c) is not None else F.col(c) for c in knowledge.columns])
    return out, live.select(F.col("id").alias("id_a"), F.col("other").alias("id_b")).distinct()


def embed_pending(queue: DataFrame, knowledge: DataFrame, model: Callable[[str], list[float]], max_attempts: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run over queue(id, target_id, status, priority, attempts, queued_at) of items to embed, oldest first.

    Gives the vectors (knowledge_id, vector), the rows to compare next (knowledge_id)
    and the queue that is left: done and unknown items leave it, failures are put back.
    """
    from lithoscope.operators.analysis import embed_texts
    from lithoscope.operators.queues import requeue
    from lithoscope.session import materialise

    asked = queue.where("status = 'pending'").select(F.col("target_id").alias("knowledge_id")).distinct()
    got = materialise(embed_texts(asked.join(knowledge.select(F.col("id").alias("knowledge_id"), "body"), "knowledge_id"), "knowledge_id", "body", model), "knowledge-vectors")
    done = got.where("vector is not null").select("knowledge_id", "vector")
    failed = queue.where("status = 'pending'").join(got.where("vector is null").select(F.col("knowledge_id").alias("target_id")), "target_id", "left_semi").withColumn("status", F.lit("processing"))
    left = queue.where("status != 'pending'").unionByName(requeue(failed, max_attempts, now))
    return done, done.select("knowledge_id"), left


def fact_check(items: DataFrame, snippets: DataFrame, model: Callable[[str], str], template: str, now: Column) -> DataFrame:
    """Items with `fact_checked_at`, and suppressed where the model refutes them by snippets(id, text).

    The template names {body} and {snippets}. Items without snippets, or without an
    answer in the known form, stay as they are.
    """
    from lithoscope.operators.analysis import ask
    from lithoscope.session import materialise

    have = items.select("id", "body").join(snippets.where("text != ''").groupBy("id").agg(F.min("text").alias("text")), "id")
    prompts = have.select("id", F.replace(F.replace(F.lit(template), F.lit("{body}"), F.col("body")), F.lit("{snippets}"), F.col("text")).alias("prompt"))
    verdict = F.get_json_object(first_json("answer", "object"), "$.verdict")
    told = materialise(ask(prompts, "id", model), "verdicts").select("id", verdict.alias("verdict")).where("verdict is not null")
    keep = [c for c in items.columns if c not in ("suppressed_at", "fact_checked_at")]
    old = lambda c, t: F.col(c) if c in items.columns else F.lit(None).cast(t)
    return items.join(told, "id", "left").select(*keep, F.when(F.col("verdict") == "refuted", now).otherwise(old("suppressed_at", "bigint")).alias("suppressed_at"), F.when(F.col("verdict").isNotNull(), now).otherwise(old("fact_checked_at", "bigint")).alias("fact_checked_at"))


def search_directory(pattern: str | Column) -> Column:
    """Where to look for snippets about an item: the directory in front of its pattern's first wildcard."""
    return glob_directory(pattern)


REFINERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def refiner(f):
    """Register a refiner: it adds `outcome` (keep, update or delete) and `new_body` to items."""
    REFINERS[f.__name__] = f
    return f


def model_filter(model: Callable[[str], str], template: str):
    """A refiner by which a model deletes items: its answer holds {"action": "delete"}; the template names {body}."""
    from lithoscope.operators.analysis import ask

    def check(items: DataFrame) -> DataFrame:
        prompts = items.select("id", F.replace(F.lit(template), F.lit("{body}"), F.col("body")).alias("prompt"))
        action = F.get_json_object(first_json("answer", "object"), "$.action")
        told = ask(prompts, "id", model).select("id", action.alias("_action"))
        return items.join(told, "id", "left").withColumn("outcome", F.when(F.col("_action") == "delete", "delete").otherwise("keep")).withColumn("new_body", F.lit(None).cast("string")).drop("_action")

    return check


@refiner
def tidy(items: DataFrame) -> DataFrame:
    """Runs of white space become one blank."""
    neat = F.trim(F.regexp_replace("body", r"\s+", " "))
    return items.withColumn("outcome", F.when(neat != F.col("body"), "update").otherwise("keep")).withColumn("new_body", F.when(neat != F.col("body"), neat))


def refine(items: DataFrame, refiners: list, now: Column) -> DataFrame:
    """Items after a chain of refiners: the first that deletes or updates an item ends its chain; the others are marked as refined."""
    cols = items.columns
    open_ = items.withColumn("done", F.lit("")).withColumn("kept", F.col("body"))
    for r in refiners:  # registered names or refiners themselves
        got = (REFINERS[r] if isinstance(r, str) else r)(open_)
        first = (F.col("done") == "") & (F.col("outcome") != "keep")
        open_ = got.withColumn("kept", F.when(first & (F.col("outcome") == "update"), F.col("new_body")).otherwise(F.col("kept"))).withColumn("done", F.when(first, F.col("outcome")).otherwise(F.col("done"))).drop("outcome", "new_body")
    return open_.where("done != 'delete'").withColumn("body", F.col("kept")).withColumn("refined_at", F.when(F.col("done") == "", now).otherwise(F.col("refined_at") if "refined_at" in cols else F.lit(None))).select(*cols, *([] if "refined_at" in cols else ["refined_at"]), "done")
