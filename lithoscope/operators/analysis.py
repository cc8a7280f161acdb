"""Model-based analyzers: which symbols to ask about, prompts, answers and findings. The model is a plug-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lithoscope.functions.text import first_json, neutral_braces, truncate
from lithoscope.plans.index import CodeIndex

FINDINGS = "array<struct<rule string, message string, confidence double, symbol string>>"


def pending_symbols(ix: CodeIndex, findings: DataFrame, rule_ids: DataFrame, min_lines: int = 0, limit: int = 0) -> DataFrame:
    """`id, name, path, line, content`: functions with blocks and no finding of any active rule yet; 0: no limit."""
    s = ix.symbols.where(F.col("kind").isin("function", "method") & ((F.coalesce("end_line", "line") - F.col("line")) >= min_lines))
    known = findings.join(rule_ids.select("rule_id").distinct(), "rule_id", "left_semi").select(F.col("symbol_id").alias("id")).distinct()
    first = ix.blocks.where("block_index = 0").groupBy(F.col("symbol_id").alias("id")).agg(F.min_by("content", "id").alias("content"))
    out = s.join(known, "id", "left_anti").join(first, "id").join(ix.scope.groupBy("file_id").agg(F.min("path").alias("path")), "file_id").select("id", "name", "path", "line", "content").orderBy("path", "line", "id")
    return out.limit(limit) if limit else out


def symbol_prompt(rules: list[tuple[str, str]]) -> Column:
    """The question about one symbol (name, path, content)."""
    listed = "\n".join(f"- {n}: {d}" for n, d in rules)
    head = f"Check the code against these rules and answer with a JSON list of objects with rule, message and confidence.\nRules:\n{listed}\n\n"
    return F.concat(F.lit(head), F.lit("Symbol: "), "name", F.lit("\nFile: "), "path", F.lit("\n\n"), neutral_braces("content"))


def file_prompts(pending: DataFrame, max_snippet: int = 600, max_chars: int = 12_000) -> DataFrame:
    """`path, prompt`: one question per file with all of its pending symbols, each cut, together below a bound."""
    part = F.concat(F.lit("## "), "name", F.lit("\n"), truncate("content", max_snippet))
    g = pending.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "id", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("all"))
    return g.select("path", truncate("all", max_chars).alias("prompt"))


def ask(prompts: DataFrame, key: str, model: Callable[[str], str]) -> DataFrame:
    """`key, answer`: a model's answers, asked in batches; a failure gives an empty answer."""

    def one(p):
        try:
            return model(p)
        except Exception:  # noqa: BLE001 - one bad answer must not end the job
            return ""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": [one(p) for p in pdf["prompt"]]})

    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, answer string")


def parse_findings(answers: DataFrame, key: str, rules: DataFrame, min_confidence: float) -> DataFrame:
    """`key, rule_id, message, confidence`: known rules with enough confidence; broken answers give none."""
    x = answers.select(key, F.explode(F.from_json(first_json("answer"), FINDINGS)).alias("f")).select(key, "f.rule", "f.message", "f.confidence")
    return x.join(rules.select(F.col("rule_name").alias("rule"), "rule_id"), "rule").where(F.col("confidence") >= min_confidence).select(key, "rule_id", "message", "confidence")


def parse_file_findings(answers: DataFrame, symbols: DataFrame, rules: DataFrame, min_confidence: float) -> DataFrame:
    """`symbol_id, rule_id, message, confidence` of answers(path, answer) about whole files.

    The answer names symbols(path, id, name); unknown symbols and rules are left out, and
    of several symbols of a name in a file the last id counts.
    """
    x = answers.select("path", F.explode(F.from_json(first_json("answer"), FINDINGS)).alias("f")).select("path", "f.rule", "f.message", "f.confidence", F.col("f.symbol").alias("name"))
    by_name = symbols.groupBy("path", "name").agg(F.max("id").alias("symbol_id"))
    found = x.join(rules.select(F.col("rule_name").alias("rule"), "rule_id"), "rule").where(F.col("confidence") >= min_confidence).join(by_name, ["path", "name"])
    return found.groupBy("symbol_id", "rule_id").agg(F.max_by(F.struct("message", "confidence"), F.struct("confidence", "message")).alias("r")).select("symbol_id", "rule_id", "r.message", "r.confidence")


def merge_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """One finding per symbol and rule, the new one where there are two."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("symbol_id", "rule_id", "_n")]
    return both.groupBy("symbol_id", "rule_id").agg(F.max_by(F.struct(*rest), "_n").alias("r")).select("symbol_id", "rule_id", "r.*")


def reset_findings(findings: DataFrame, rule_ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Without the findings of the given rules on the given symbols(id)."""
    gone = findings.join(rule_ids.select("rule_id").distinct(), "rule_id", "left_semi").join(symbols.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi").select("symbol_id", "rule_id").distinct()
    return findings.join(gone, ["symbol_id", "rule_id"], "left_anti")


def register_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rule registry with new(analyzer, rule_name, severity) merged in by analyzer and name; rules no longer named stay."""
    o = old.select("analyzer", "rule_name", "rule_id", F.col("severity").alias("old_severity"))
    return o.join(new, ["analyzer", "rule_name"], "full_outer").select(F.coalesce("rule_id", F.xxhash64("analyzer", "rule_name")).alias("rule_id"), "analyzer", "rule_name", F.coalesce("severity", "old_severity").alias("severity"))


def embedding_text(ix: CodeIndex) -> DataFrame:
    """`id, text`: what is embedded for a block.

    The qualified name with its parameters and description (of the block itself, from
    the second one on), the place, up to ten callers and callees by id, and the content
    of functions and methods. Nothing is cut: the embedder halves what is too long.
    """
    from lithoscope.operators.browse import neighbours

    n = neighbours(ix, 10).groupBy(F.col("id").alias("symbol_id")).pivot("side", ["caller", "callee"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "name"))), lambda x: x["name"]), ", "))
    s = ix.symbols.join(ix.scope.groupBy("file_id").agg(F.min("path").alias("path")), "file_id").select(F.col("id").alias("symbol_id"), "kind", "name", "params", "path", F.col("description").alias("symbol_description"))
    shown = lambda before, c, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    about = F.when(F.col("block_index") == 0, F.col("symbol_description")).otherwise(F.col("description"))
    code = F.when(F.col("kind").isin("function", "method"), F.col("content"))
    text = F.concat("name", shown("(", F.col("params"), ")"), shown(": ", about), F.lit("\nin "), "path", shown("\ncallers: ", F.col("caller")), shown("\ncallees: ", F.col("callee")), shown("\n\n", code))
    return ix.blocks.join(s, "symbol_id").join(n, "symbol_id", "left").select("id", text.alias("text"))


def hash_vector(size: int = 8) -> Callable[[str], list[float]]:
    """A deterministic embedder for tests: `size` numbers in [-1, 1) from a text's SHA-256."""
    import hashlib

    return lambda text: [b / 128 - 1 for b in hashlib.sha256(text.encode("utf-8", "replace")).digest()[:size]]


def embed_texts(texts: DataFrame, key: str, text: str, model: Callable[[str], list[float]]) -> DataFrame:
    """`key, vector, error`: a model's vectors of texts, in batches; a text that is too long is halved, a failure is told."""
    from lithoscope.sources.chunk import embed_halving

    def one(t):
        try:
            return list(map(float, embed_halving(model, t or ""))), None
        except Exception as e:  # noqa: BLE001 - one text must not end the job
            return None, str(e)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, *one(t)) for k, t in zip(pdf[key], pdf[text])], columns=[key, "vector", "error"])

    return texts.select(key, text).mapInPandas(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, vector array<float>, error string")


def embed_blocks(ix: CodeIndex, embeddings: DataFrame, name: str, model: Callable[[str], list[float]]) -> DataFrame:
    """`content_hash, model, vector, error`: vectors of the contents that have none of the model `name` yet.

    A content that several blocks hold is embedded once, with the text of its smallest block.
    """
    known = embeddings.where((F.col("model") == name) & F.col("vector").isNotNull()).select("content_hash")
    missing = ix.blocks.where("content_hash is not null").join(known, "content_hash", "left_anti").select("id", "content_hash")
    texts = embedding_text(ix).join(missing, "id").groupBy("content_hash").agg(F.min_by("text", "id").alias("text"))
    return embed_texts(texts, "content_hash", "text", model).select("content_hash", F.lit(name).alias("model"), "vector", "error")


def description_prompts(ix: CodeIndex, template: str, max_chars: int = 6000) -> DataFrame:
    """`id, prompt`: questions about the blocks without a description; braces of the values are made harmless.

    The template names {kind}, {name}, {path} and {context}; the context is the block,
    cut to `max_chars`.
    """
    s = ix.symbols.join(ix.scope.groupBy("file_id").agg(F.min("path").alias("path")), "file_id").select(F.col("id").alias("symbol_id"), "kind", "name", "path")
    rows = ix.blocks.where("description is null").join(s, "symbol_id")
    prompt = F.lit(template)
    for c, value in (("kind", F.col("kind")), ("name", F.col("name")), ("path", F.col("path")), ("context", truncate(F.coalesce("content", F.lit("")), max_chars))):
        prompt = F.replace(prompt, F.lit("{" + c + "}"), neutral_braces(value))
    return rows.select("id", prompt.alias("prompt"))


def apply_descriptions(blocks: DataFrame, symbols: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and symbols with answers(id, answer) in place of missing descriptions; a first block's is its symbol's too."""
    a = answers.where("answer is not null and answer != ''").groupBy("id").agg(F.min("answer").alias("answer"))
    new = blocks.join(a, "id", "left").withColumn("_new", F.when(F.col("description").isNull(), F.col("answer")))
    first = new.where("block_index = 0 and _new is not null").groupBy("symbol_id").agg(F.min_by("_new", "id").alias("said"))
    s = symbols.join(first.withColumnRenamed("symbol_id", "id"), "id", "left").withColumn("description", F.coalesce("said", "description"))
    return new.withColumn("description", F.coalesce("description", "_new")).select(*blocks.columns), s.select(*symbols.columns)
