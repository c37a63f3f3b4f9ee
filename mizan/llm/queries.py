"""Queries p1, p2, p4 to p8 over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm import defects, garble, leaks, lookalike, mix, pieces, tokens
from mizan.session import table

ARTICLE_KEY, ARTICLE_FIELDS = ("doc_id", "eid"), ("article_ref", "text_ar", "text_normalized")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = mix.sample(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "mix_target"))
    return mix.unmet(report)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.sample(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "mix_target"))[1]


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.sample(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "mix_target"))[0]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.split_oversized(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "size_limit"), keep_small=False)
    return pieces.oversized_ids(cut)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each chunk once: of repeated deliveries, which carry the same text, one is cut."""
    once = table(spark, sf_dir, "chunk").dropDuplicates(["chunk_id"])
    return pieces.split_oversized(once, table(spark, sf_dir, "size_limit"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.find_defects(table(spark, sf_dir, "predictions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = lookalike.classes(table(spark, sf_dir, "article"), ARTICLE_KEY, "ordinal", ARTICLE_FIELDS)
    return lookalike.pairs(members, ARTICLE_KEY, "ordinal")


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical(table(spark, sf_dir, "article"), ARTICLE_KEY, "ordinal", ARTICLE_FIELDS).select("ordinal", *ARTICLE_KEY, *ARTICLE_FIELDS)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_chars of the decoded text, and whether it equals the stored one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("stored"))
    enc = tokens.encode(docs, text="stored")
    back = tokens.decode(enc)
    n = enc.select("doc_id", F.size("ids").alias("n_tokens"))
    whole = back.join(docs, "doc_id").join(n, "doc_id")
    return whole.select("doc_id", "n_tokens", F.length("text").alias("n_decoded"), (F.col("text") == F.coalesce("stored", F.lit(""))).alias("same"))


def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, and characters that lie inside some token."""
    enc = tokens.encode(table(spark, sf_dir, "documents"), with_offsets=True)
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("covered_to"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items: number of documents and longest passage."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.find_garbled(table(spark, sf_dir, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents as far as they can be restored."""
    return garble.find_garbled(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_sample, p2_found, p2_pieces, p4_found, p5_found, p5_canonical, p6_ids, p6_roundtrip, p6_offsets, p7_found, p7_items, p8_found, p8_restored)
}

_PEOPLE = "(select prediction_id, " + ", ".join(
    f"min(case when coalesce(lower(trim({f})), '') = '' then 'unknown' else lower(trim({f})) end) as {f}" for f in mix.FIELDS
) + " from predictions where prediction_id is not null group by 1)"

_CELLS = f"""with people as {_PEOPLE}, sized as (
  select t.*, (select count(*) from people) * t.sample_bp // 10000 as s from mix_target t),
cells as (
  select t.request_id, t.query_type, t.difficulty, t.language, t.s as sample_size,
    greatest(t.min_rows, (t.s * t.share_bp + 9999) // 10000) as needed,
    (select count(*) from people p where (t.query_type = '*' or lower(trim(t.query_type)) = p.query_type)
      and (t.difficulty = '*' or lower(trim(t.difficulty)) = p.difficulty) and (t.language = '*' or lower(trim(t.language)) = p.language)) as available
  from sized t)"""

ORACLES = {
    "p1_found": _CELLS + " select request_id, query_type, difficulty, language from cells where available < needed",
    "p1_report": _CELLS
    + " select request_id, query_type, difficulty, language, sample_size, needed, available, least(needed, available) as drawn from cells",
    "p2_found": """with leveled as (
      select chunk_id, text, case when coalesce(trim(granularity), '') <> '' then lower(trim(granularity)) when para_idx = -1 then 'article' else 'paragraph' end as level from chunk)
      select distinct chunk_id from leveled c join size_limit l on c.level = lower(trim(l.granularity)) where length(c.text) > l.max_chars""",
    "p6_roundtrip": "",
}
del ORACLES["p6_roundtrip"]
