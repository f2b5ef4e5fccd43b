"""The driver's tables in the shapes of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevspark.functions import text as T
from relevspark.operators import judgements as J
from relevspark.operators import lexical as L
from relevspark.runtime import read_table


class Tables:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def doc_tokens(self, tokenizer=T.tokenize_ascii) -> DataFrame:
        return L.tokens(self("documents"), "doc_id", "text", "did", tokenizer)

    def query_tokens(self, tokenizer=T.tokenize_ascii) -> DataFrame:
        return L.tokens(self("queries"), "qid", "query_text", "qid", tokenizer)

    def qrels(self) -> DataFrame:
        """The latest judgement of each pair; null grades are no judgement."""
        q = J.dedup(self("qrels"), ["qid", "did"], [F.col("judged_at").desc(), F.col("grade").desc_nulls_last()])
        return q.where("grade is not null").select("qid", "did", "grade")

    def vectors(self) -> DataFrame:
        return self("embeddings").select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec"), "label")

    def vector_queries(self) -> DataFrame:
        """The stated set of queries: every row whose id is divisible by 100."""
        return self("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), "label")
