"""Hybrid search: a vector leg and two full-text legs, fused by reciprocal rank."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lithoscope.functions.text import fixed, like, rrf
from lithoscope.functions.vectors import cosine
from lithoscope.plans.index import CodeIndex

#: BM25 parameters; the least inverse document frequency of a term that is in most documents.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Latin letters with marks, and what they fold to.
MARKED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōřśšťùúûüūůýÿźżž"
FOLDED = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz"


def query_terms(text: str, strict: bool = False) -> list[str]:
    """Distinct terms of a query. `strict`: none where the query has characters outside of words."""
    if strict and re.search(r"[^\w\s]", text):
        return []
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return sorted(set(re.findall(r"[^\W_]+", plain)))


def terms(text: Column) -> Column:
    """Longest runs of letters and digits, lower-cased and without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, FOLDED), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(docs: DataFrame, key: str, *columns: str, only: list[str] | None = None) -> DataFrame:
    """`term, doc, tf, len`: the inverted index of docs' columns taken together; `only`: of these terms."""
    words = F.concat(*[F.coalesce(terms(F.col(c)), F.array().cast("array<string>")) for c in columns])
    d = docs.select(F.col(key).alias("doc"), words.alias("w")).withColumn("len", F.size("w"))
    if only is not None:
        d = d.withColumn("w", F.filter("w", lambda x: x.isin(only) if only else F.lit(False)))
    return d.select("doc", "len", F.explode("w").alias("term")).groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, *columns: str) -> DataFrame:
    """`n, avg_len` of all documents, empty ones too."""
    size = reduce(lambda a, b: a + b, [F.size(F.coalesce(terms(F.col(c)), F.array().cast("array<string>"))) for c in columns])
    return docs.agg(F.count("*").alias("n"), F.avg(size).alias("avg_len"))


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, strict: bool = False) -> DataFrame:
    """`doc, score` of the documents that hold all terms of the query, higher is better.

    Terms that don't occur in the query are dropped before the words become rows, so
    the index is never built or moved whole.
    """
    q = query_terms(query, strict)
    return score_postings(postings(docs, key, *columns, only=q), doc_stats(docs, *columns), len(q))


def score_postings(p: DataFrame, stats: DataFrame, n_terms: int) -> DataFrame:
    """`doc, score` from the postings (term, doc, tf, len) of a query's terms and stats(n, avg_len)."""
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    x = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row per term, one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return x.groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("k")).where(F.col("k") == n_terms).drop("k")


def vector_scores(ix: CodeIndex, embeddings: DataFrame, query: list[float], model: str | None) -> DataFrame:
    """`doc, score`: best cosine similarity of each symbol's blocks with the query vector."""
    return vector_rows(ix, embeddings, query, model).groupBy("doc").agg(F.max("score").alias("score"))


def vector_rows(ix: CodeIndex, embeddings: DataFrame, query: list[float], model: str | None) -> DataFrame:
    """`doc, score`, one row for each block: the cosine similarity of its vector with the query vector."""
    e = embeddings.where("vector is not null")
    e = e.where(F.col("model") == model) if model else e
    e = e.where(F.size("vector") == len(query)).select("content_hash", "vector").withColumn("q", F.array(*[F.lit(float(x)) for x in query]))
    e = e.select("content_hash", cosine("vector", "q").alias("s")).groupBy("content_hash").agg(F.max("s").alias("score"))
    return ix.blocks.select(F.col("symbol_id").alias("doc"), "content_hash").join(e, "content_hash").select("doc", "score")


def top(scores: DataFrame, k: int, best_first: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """`doc, score, rank` of the k best: a limit per partition first, then a rank over k rows. `more`: further columns of the order."""
    order = [F.desc("score") if best_first else F.asc("score"), F.asc("doc"), *map(F.asc, more)]
    few = scores.where("score is not null").orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def allowed(ix: CodeIndex, exts: tuple[str, ...] = (), directory: str = "", tags: dict[str, str] | None = None) -> DataFrame:
    """`doc, kind, path, described` of the symbols that the filters leave; headings only where `.md` is asked for."""
    s = ix.symbols
    if ".md" not in exts:
        s = s.where("kind != 'heading'")
    p = ix.scope
    if exts:
        p = p.where(reduce(lambda a, b: a | b, [like("path", f"%{e}") for e in exts]))
    if directory:
        p = p.where(like("path", f"%{directory}%"))
    for k, v in (tags or {}).items():
        s = s.join(ix.tags.where((F.col("key") == k) & (F.col("value") == v)).select(F.col("symbol_id").alias("id")), "id", "left_semi")
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    return s.join(p.groupBy("file_id").agg(F.min("path").alias("path")), "file_id").select(F.col("id").alias("doc"), "kind", "name", "line", "params", F.coalesce("end_line", "line").alias("end_line"), "path", described.alias("described"))


#: What tells the path of a test.
TEST_MARKS = ("/tests/", "/editmode/", "/playmode/", "/test/", "tests.cs", "test.cs")


def multiplier() -> Column:
    """Fields and variables, and tests, count half; what has a description two and a half times."""
    test = reduce(lambda a, b: a | b, [F.lower("path").contains(m) for m in TEST_MARKS])
    return F.when(F.col("kind").isin("field", "variable"), 0.5).otherwise(1.0) * F.when(test, 0.5).otherwise(1.0) * F.when(F.col("described"), 2.5).otherwise(1.0)


def hybrid_search(ix: CodeIndex, embeddings: DataFrame, text: str, vector: list[float] | None, n: int = 20, model: str | None = None, exts: tuple[str, ...] = (), directory: str = "", tags: dict[str, str] | None = None, min_score: float = 0.0, strict: bool = False, rerank: Callable[[pd.DataFrame], list[int]] | None = None, indexes: tuple | None = None, compat: bool = False) -> DataFrame:
    """`doc, kind, name, path, line, end_line, score` of the n best symbols.

    Each leg ranks the 20 n best; a symbol's score is the sum of its legs' reciprocal
    ranks; the n best are then weighted by kind, place and description. `rerank`
    gets the n rows and returns their positions in a new order; positions that it
    leaves out follow, and an error keeps the order. `indexes`: the full-text indexes
    (`TextIndex`) of symbols and of blocks, in place of the texts. `compat`: legs rank
    rows, one for each block and path, within the 20 n; a symbol's rank is its worst, and
    its weight is applied once for each of its paths.
    """
    ok = allowed(ix, exts, directory, tags)
    keep = lambda df: df.join(ok.select("doc"), "doc", "left_semi")
    blocks = ix.blocks.where("content is not null")
    found = bm25(blocks, "id", ["content"], text, strict) if indexes is None else indexes[1].bm25(text, strict)
    by_block = found.join(blocks.select(F.col("id").alias("doc"), "symbol_id"), "doc").select(F.col("symbol_id").alias("doc"), "score")
    by_symbol = bm25(ix.symbols, "id", ["name", "description"], text, strict) if indexes is None else indexes[0].bm25(text, strict)
    if compat:
        per_path = ix.symbols.select(F.col("id").alias("doc"), "file_id").join(ok.select("doc"), "doc", "left_semi").join(ix.scope, "file_id").select("doc", "path")
        legs = [by_symbol.join(per_path, "doc"), by_block.join(per_path, "doc")]
        if vector is not None:
            legs.append(vector_rows(ix, embeddings, vector, model).join(per_path, "doc"))
        legs = [top(leg, 20 * n, more=("path",)).groupBy("doc").agg(F.max("rank").alias("rank")) for leg in legs]
    else:
        legs = [top(keep(by_symbol), 20 * n), top(keep(by_block.groupBy("doc").agg(F.max("score").alias("score"))), 20 * n)]
        if vector is not None:
            legs.append(top(keep(vector_scores(ix, embeddings, vector, model)), 20 * n))
    fused = reduce(DataFrame.unionByName, legs).groupBy("doc").agg(F.sum(rrf("rank")).alias("score")).where(F.col("score") >= min_score)
    best = fused.orderBy(F.desc("score"), "doc").limit(n)
    out = best.join(ok, "doc")
    weight = multiplier()
    if compat:
        all_paths = per_path.join(best.select("doc"), "doc", "left_semi").withColumnRenamed("path", "at").join(ok.select("doc", "kind", "described"), "doc")
        every = all_paths.withColumnRenamed("at", "path").groupBy("doc").agg(F.product(multiplier()).alias("weight"))
        out, weight = out.join(every, "doc"), F.col("weight")
    out = out.withColumn("score", F.col("score") * weight).drop("weight").orderBy(F.desc("score"), "doc")
    return out if rerank is None else reranked(out, rerank)


def reranked(hits: DataFrame, rerank: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """At most n rows, in the order that a model gives."""
    rows = hits.toPandas()
    try:
        first = [i for i in dict.fromkeys(rerank(rows)) if 0 <= i < len(rows)]
    except Exception:  # noqa: BLE001 - any failure of the model keeps the order
        first = []
    order = first + [i for i in range(len(rows)) if i not in set(first)]
    return hits.sparkSession.createDataFrame(rows.iloc[order].assign(position=range(len(rows))), StructType([*hits.schema.fields, StructField("position", IntegerType())])) if len(rows) else hits.withColumn("position", F.lit(0))


def compact_hit() -> Column:
    """`kind name(params)  path:line-end`."""
    return F.concat("kind", F.lit(" "), "name", F.when(F.coalesce("params", F.lit("")) != "", F.concat(F.lit("("), "params", F.lit(")"))).otherwise(""), F.lit("  "), "path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))


def signature() -> Column:
    return F.when(F.coalesce("params", F.lit("")) != "", F.concat(F.lit("("), "params", F.lit(")"))).otherwise("")


def verbose_hits(ix: CodeIndex, hits: DataFrame, refs: bool = False, most_lines: int = 1 << 30) -> DataFrame:
    """`doc, place, text`: the hits in order, each with score, description and its first block, indented.

    `refs` adds its callers and callees (up to ten of each, by id).
    """
    order = Window.orderBy(F.desc("score"), "doc")  # as many rows as were asked for
    placed = hits.withColumn("place", F.row_number().over(order))
    asked = hits.select("doc").distinct()
    first = ix.blocks.where("block_index = 0").join(asked.withColumnRenamed("doc", "symbol_id"), "symbol_id", "left_semi").groupBy(F.col("symbol_id").alias("doc")).agg(F.min_by("content", "id").alias("content"))
    about = ix.symbols.join(asked.withColumnRenamed("doc", "id"), "id", "left_semi").select(F.col("id").alias("doc"), F.col("description").alias("about"))
    head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "kind", F.lit(" "), "name", signature(), F.lit("  "), "path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  score:"), fixed("score", 3), F.when(F.coalesce("about", F.lit("")) != "", F.concat(F.lit("  "), "about")).otherwise(""))
    lines = F.slice(F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n"), 1, most_lines)
    body = F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("\n  "), F.array_join(lines, "\n  "))).otherwise("")
    out = placed.join(first, "doc", "left").join(about, "doc", "left")
    text = F.concat(head, body)
    if refs:
        from lithoscope.operators.browse import neighbours

        near = neighbours(ix, 10).join(asked.withColumnRenamed("doc", "id"), "id", "left_semi")
        home = ix.symbols.select(F.col("id").alias("other"), "file_id").join(ix.paths.groupBy("file_id").agg(F.min("path").alias("at")), "file_id")
        line = F.concat(F.when(F.col("side") == "callee", "calls: ").otherwise("calledby: "), "name", F.lit(" ("), "at", F.lit(")"))
        listed = F.array_sort(F.collect_list(F.struct((F.col("side") == "caller").alias("after"), "other", line.alias("line"))))
        near = near.join(home, "other").groupBy(F.col("id").alias("doc")).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("near"))
        out = out.join(near, "doc", "left")
        text = F.concat(text, F.when(F.col("near").isNotNull(), F.concat(F.lit("\n"), "near")).otherwise(""))
    return out.select("doc", "place", text.alias("text"))


def snippet_search(ix: CodeIndex, embeddings: DataFrame, text: str, vector: list[float] | None, directory: str = "", n: int = 10, model: str | None = None) -> DataFrame:
    """`text`, one row: the n best hits in their verbose form; empty where there is none."""
    hits = verbose_hits(ix, hybrid_search(ix, embeddings, text, vector, n, model, directory=directory))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return hits.agg(F.array_join(lines, "\n").alias("text"))


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, the same ones for the same seed: those of the smallest hashes of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def evaluation(samples: DataFrame) -> DataFrame:
    """`json`, one row: the figures of samples(symbol_id, rank_b, rank_c), ranks from 1 and null for not found."""
    part = lambda c: F.struct(F.round(F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0)), 4).alias("p_at_1"), F.round(F.avg(F.coalesce(1 / F.col(c), F.lit(0.0))), 4).alias("mrr"))
    got = samples.agg(F.count("*").alias("n_samples"), F.sort_array(F.collect_list("symbol_id")).alias("symbol_ids"), part("rank_b").alias("method_B"), part("rank_c").alias("method_C"))
    return got.select(F.to_json(F.struct("*")).alias("json"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """`p_at_1, mrr` of ranks(rank from 1, null: not found)."""
    return ranks.agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("p_at_1"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))
