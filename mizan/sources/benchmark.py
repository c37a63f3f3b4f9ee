"""Benchmark questions and stored runs from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions.text import canonical_article_ref

QUESTION = "id string, split string, language string, query_type string, difficulty string, category string, question string, answerable boolean, temporal_note struct<amendment_law:string,amendment_date:string>, expected_documents array<string>, expected_articles array<struct<document_id:string,article_ref:string>>, ground_truth_answer string, reasoning_chain array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of files that hold {"questions": [...]}."""
    raw = spark.read.schema(f"questions array<struct<{', '.join(x.replace(' ', ':', 1) for x in QUESTION.split(', '))}>>").json(path, multiLine=True)
    return raw.select(F.explode("questions").alias("q")).select("q.*")


def to_records(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Runner records: documents resolved through aliases, references canonical, gold article ids distinct
    in order, gold_abstain where the question is not answerable."""
    e = questions.select("id", F.posexplode_outer("expected_articles").alias("pos", "a"))
    named = e.join(aliases, F.lower(F.trim(F.col("a.document_id"))) == F.col("alias"), "left")
    doc = F.coalesce(F.col("doc_id"), F.col("a.document_id"))
    ref = canonical_article_ref(F.col("a.article_ref"))
    gold = named.filter("a is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(doc, F.lit("#art_"), ref).alias("x")))).alias("g"))
    out = questions.join(gold, "id", "left").withColumn("gold_article_ids", F.coalesce(F.array_distinct(F.transform("g", lambda s: s["x"])), F.array().cast("array<string>"))).drop("g")
    return out.withColumn("gold_abstain", ~F.coalesce("answerable", F.lit(True))).withColumn("has_temporal_note", F.col("temporal_note").isNotNull())


def read_jsonl(spark: SparkSession, path: str, schema: str, query_types: list[str] | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Line-wise JSON: filter first, then the first `limit` rows by `order`."""
    df = spark.read.schema(schema).json(path)
    df = df.filter(F.col("query_type").isin(query_types)) if query_types else df
    return df.orderBy(order).limit(limit) if limit is not None else df
