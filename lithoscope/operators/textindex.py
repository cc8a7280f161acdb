"""A full-text index that is kept on storage: postings by term, document lengths, counts.

Layout below the index's folder: `postings/gen=G/bucket=B` (term, doc, tf, len), sorted
by term, with B from a hash of the term; `docs/gen=G` (doc, len); `dead/gen=G` (doc,
of), the documents that generation G replaced or removed, and the generation they were
of; `counts/gen=G` (docs, words), what G changed. A query reads the buckets of its terms
only, and in these the row groups that can hold them. An update writes one generation
more; `compact` makes one of all.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lithoscope.operators.search import query_terms, score_postings, terms


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _path(self, part: str) -> str:
        return os.path.join(self.folder, part)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", gen int").parquet(self._path(part))

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", "term string, doc bigint, tf bigint, len int, bucket int")

    @property
    def docs(self) -> DataFrame:
        return self._read("docs", "doc bigint, len int")

    @property
    def dead(self) -> DataFrame:
        return self._read("dead", "doc bigint, of int")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.dead.select("doc", F.col("of").alias("gen")), ["doc", "gen"], "left_anti")

    def _write(self, gen: int, docs: DataFrame, key: str, columns: list[str], dead: DataFrame) -> None:
        none = F.array().cast("array<string>")
        words = F.concat(*[F.coalesce(terms(F.col(f"`{c}`")), none) for c in columns])
        d = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), words.alias("w")).withColumn("len", F.size("w"))
        d.select("doc", "len").write.mode("overwrite").parquet(self._path(f"docs/gen={gen}"))
        p = d.select("doc", "len", F.explode("w").alias("term")).groupBy("term", "doc", "len").agg(F.count("*").alias("tf")).withColumn("bucket", self._bucket(F.col("term")))
        # a bucket's common terms are spread over several files, so that no task holds all of it
        p.repartition(self.buckets * 4, "bucket", F.pmod(F.xxhash64("doc"), F.lit(4))).sortWithinPartitions("bucket", "term", "doc").select("term", "doc", "tf", "len", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(f"postings/gen={gen}"))
        dead.select("doc", "of").write.mode("overwrite").parquet(self._path(f"dead/gen={gen}"))
        new = self.spark.read.parquet(self._path(f"docs/gen={gen}")).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("w"))
        gone = dead.agg(F.count("*").alias("gn"), F.coalesce(F.sum("len"), F.lit(0)).alias("gw"))
        new.crossJoin(gone).select((F.col("n") - F.col("gn")).alias("docs"), (F.col("w") - F.col("gw")).alias("words")).write.mode("overwrite").parquet(self._path(f"counts/gen={gen}"))  # one row each

    def build(self, docs: DataFrame, key: str, columns: list[str]) -> TextIndex:
        """Index docs (one row per key, null keys left out) as generation 0."""
        none = self.spark.createDataFrame([], "doc bigint, of int, len int")
        self._write(0, docs.where(F.col(f"`{key}`").isNotNull()), key, columns, none)
        return self

    def update(self, docs: DataFrame, key: str, columns: list[str], removed: DataFrame | None = None) -> TextIndex:
        """New and changed documents, and the keys of removed(doc)."""
        last = self._read("counts", "docs bigint").agg(F.max("gen")).first()[0]  # every generation has a row there
        docs = docs.where(F.col(f"`{key}`").isNotNull())
        changed = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"))
        changed = changed if removed is None else changed.unionByName(removed.select(F.col("doc").cast("bigint").alias("doc")))
        dead = self._live(self.docs).join(changed.distinct(), "doc", "left_semi").select("doc", F.col("gen").alias("of"), "len")
        self._write(last + 1, docs, key, columns, dead)
        return self

    def stats(self) -> DataFrame:
        """`n, avg_len` of the live documents, empty ones too."""
        return self._read("counts", "docs bigint, words bigint").agg(F.sum("docs").alias("n"), (F.sum("words") / F.nullif(F.sum("docs"), F.lit(0))).alias("avg_len"))

    def postings_of(self, words: list[str]) -> DataFrame:
        """The live postings of some terms, from their buckets only."""
        rows = self.spark.range(1).select(*[self._bucket(F.lit(w)).alias(str(i)) for i, w in enumerate(words)]).first() if words else ()
        p = self.postings.where(F.col("bucket").isin(*sorted(set(rows))) & F.col("term").isin(*words)) if words else self.postings.where("false")
        return self._live(p).select("term", "doc", "tf", "len")

    def bm25(self, query: str, strict: bool = False) -> DataFrame:
        """`doc, score` of the documents that hold all terms of the query: the scores of `search.bm25` on the live documents."""
        q = query_terms(query, strict)
        return score_postings(self.postings_of(q), self.stats(), len(q))

    def compact(self, folder: str) -> TextIndex:
        """All generations as one, in a new folder."""
        out = TextIndex(self.spark, folder, self.buckets)
        self._live(self.docs).select("doc", "len").write.parquet(out._path("docs/gen=0"))
        p = self._live(self.postings).select("term", "doc", "tf", "len", "bucket")
        p.repartition(self.buckets * 4, "bucket", F.pmod(F.xxhash64("doc"), F.lit(4))).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(out._path("postings/gen=0"))
        self.spark.createDataFrame([], "doc bigint, of int").write.parquet(out._path("dead/gen=0"))
        self._read("counts", "docs bigint, words bigint").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).write.parquet(out._path("counts/gen=0"))
        return out
