"""Fusion of ranked lists and what follows it. Hits: query_id, list_no, rank, doc_id, article_ref, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCORE_DIGITS = 9


def _fused(hits: DataFrame, part: Column, k: int | None, carry: list[str]) -> DataFrame:
    seen = F.struct("list_no", "rank")
    first = [F.min_by(c, seen).alias(c) for c in carry]
    g = hits.withColumn("_s", part).groupBy("query_id", "doc_id", "article_ref").agg(F.round(F.sum("_s"), SCORE_DIGITS).alias("score"), F.min(seen).alias("_seen"), *first)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("_seen"), "doc_id", "article_ref")
    out = g.withColumn("rank", F.row_number().over(w)).drop("_seen")
    return out if k is None else out.filter(F.col("rank") <= k)


def rrf_fuse(hits: DataFrame, k: int | None = None, constant: int = 60, weights: dict[int, float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion by (doc_id, article_ref): the sum of weight / (constant + rank). A key twice
    in one list counts twice; carried columns come from the first-seen hit; ties keep first-seen order."""
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("list_no")), F.lit(1.0))
    return _fused(hits, w / (constant + F.col("rank")), k, carry or [])


def weighted_fuse(hits: DataFrame, weights: dict[int, float], k: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Sum of weight * score by (doc_id, article_ref); lists without a weight count nothing."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("list_no")), F.lit(0.0))
    return _fused(hits, w * F.col("score"), k, carry or [])


def dedup_hits(hits: DataFrame) -> DataFrame:
    """First hit of every (doc_id, article_ref) of a query, ranked anew."""
    first = hits.withColumn("_i", F.row_number().over(W.partitionBy("query_id", "doc_id", "article_ref").orderBy("rank"))).filter("_i = 1").drop("_i")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def best_confidence(hits: DataFrame, k: int) -> DataFrame:
    """Largest confidence per key, first seen on ties, then the k best."""
    best = hits.groupBy("query_id", "doc_id", "article_ref").agg(F.max("confidence").alias("confidence"), F.min("rank").alias("first_rank"))
    w = W.partitionBy("query_id").orderBy(F.desc("confidence"), "first_rank", "doc_id", "article_ref")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def boost(hits: DataFrame, keys: DataFrame, amount: float) -> DataFrame:
    """Adds `amount` to hits whose (query_id, doc_id, article_ref) is among `keys`, and ranks anew."""
    flag = keys.select("query_id", "doc_id", "article_ref").distinct().withColumn("_in", F.lit(True))
    s = hits.join(flag, ["query_id", "doc_id", "article_ref"], "left").withColumn("score", F.col("score") + F.when(F.col("_in"), amount).otherwise(0.0)).drop("_in")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def keep_routed(hits: DataFrame, routes: DataFrame) -> DataFrame:
    """Hits in the routed documents of their query; all of them where none is. Ranks are kept: the filter
    stands above the ranking on purpose."""
    r = routes.select("query_id", "doc_id").distinct().withColumn("_routed", F.lit(True))
    f = hits.join(r, ["query_id", "doc_id"], "left").withColumn("_routed", F.coalesce("_routed", F.lit(False)))
    any_ = F.max("_routed").over(W.partitionBy("query_id"))
    return f.withColumn("_any", any_).filter("_routed or not _any").drop("_routed", "_any")


def document_scores(hits: DataFrame, per_doc: int = 5) -> DataFrame:
    """Per query and document the sum of its best scores, as a share of the query's largest; queries whose
    largest is not positive give nothing."""
    top = hits.withColumn("_i", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "rank"))).filter(F.col("_i") <= per_doc)
    s = top.groupBy("query_id", "doc_id").agg(F.sum("score").alias("s"))
    m = F.max("s").over(W.partitionBy("query_id"))
    return s.withColumn("m", m).filter("m > 0").select("query_id", "doc_id", F.round(F.col("s") / F.col("m"), SCORE_DIGITS).alias("score"))


def fuse_channels(channels: DataFrame, n: int = 3) -> DataFrame:
    """Routing: channels(query_id, doc_id, channel, score) -> the n best documents of a query, with the
    channels that named them. Confidence is 1.0 where an alias did, else 0.6."""
    g = channels.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), SCORE_DIGITS).alias("score"), F.array_sort(F.collect_set("channel")).alias("sources"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    alias = F.max(F.array_contains("sources", "alias")).over(W.partitionBy("query_id"))
    return top.withColumn("confidence", F.when(alias, 1.0).otherwise(0.6))


def expansion_terms(spans: DataFrame, query_tokens: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent new words of matched spans(query_id, tokens), each span counting a word once."""
    words = spans.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    new = words.join(query_tokens.select("query_id", "token").distinct(), ["query_id", "token"], "left_anti")
    n = new.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("query_id").orderBy(F.desc("n"), "token")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
