"""The registry of documents and their article keys, and lookups against it.

docs(canonical_id, doc_title, doc_date, doc_type, filename_stem); article_keys(canonical_id, key, eid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.functions.text import canonical_article_ref, normalize_arabic


def build_registry(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first article of a document gives its metadata; of two articles with one key the last wins.

    Keys of an article: its canonical token, the normal form of the written reference, and its digits.
    """
    meta = F.struct("doc_title", "doc_date", "doc_type", "filename_stem")
    docs = articles.filter("doc_id is not null").groupBy(F.col("doc_id").alias("canonical_id")).agg(F.min_by(meta, "ordinal").alias("m")).select("canonical_id", "m.*")
    token, norm = canonical_article_ref(F.col("article_ref")), normalize_arabic(F.col("article_ref"))
    keys = F.array_distinct(F.filter(F.array(token, norm, F.regexp_extract(norm, r"(\d+)", 1)), lambda x: x != ""))
    rows = articles.filter("doc_id is not null").select(F.col("doc_id").alias("canonical_id"), F.explode(keys).alias("key"), "eid", "ordinal")
    return docs, rows.groupBy("canonical_id", "key").agg(F.max_by("eid", "ordinal").alias("eid"))


def list_documents(articles: DataFrame) -> DataFrame:
    return articles.groupBy("doc_id").agg(F.countDistinct("eid").alias("n_articles"))


def resolve_aliases(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """doc_id of each name: by its lower-case form, else by its normal form, else itself if it is a doc_id.

    aliases(alias, doc_id) has one row per alias; an alias without a document resolves to null.
    """
    low, norm = F.lower(F.trim(F.col(name))), normalize_arabic(F.lower(F.col(name)))
    known = aliases.select("doc_id").filter("doc_id is not null").distinct().withColumnRenamed("doc_id", "_own")
    a = aliases.select(F.col("alias").alias("_a1"), F.col("doc_id").alias("_d1"), F.lit(True).alias("_h1"))
    b = aliases.select(F.col("alias").alias("_a2"), F.col("doc_id").alias("_d2"))
    j = names.join(a, low == F.col("_a1"), "left").join(b, norm == F.col("_a2"), "left").join(known, F.trim(F.col(name)) == F.col("_own"), "left")
    return j.select(*names.columns, F.when(F.col("_h1"), F.col("_d1")).otherwise(F.coalesce("_d2", "_own")).alias("doc_id"))


def lookup_keys(ref: Column) -> Column:
    """Keys under which a written reference may be registered, best first."""
    return F.array_distinct(F.filter(F.array(canonical_article_ref(ref), normalize_arabic(ref)), lambda x: x != ""))


def has_article(refs: DataFrame, article_keys: DataFrame, doc: str = "doc_id", ref: str = "article_ref") -> DataFrame:
    """`refs` with found: whether the registry has the reference. One left join on distinct references."""
    asked = refs.select(doc, ref).distinct()
    hit = asked.select(doc, ref, F.explode(lookup_keys(F.col(ref))).alias("key")).join(article_keys.withColumnRenamed("canonical_id", doc), [doc, "key"], "left_semi").select(doc, ref).distinct().withColumn("found", F.lit(True))
    return refs.join(hit, [doc, ref], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def audit_ids(used: DataFrame, docs: DataFrame, collisions: list[str] | None = None, missing: list[str] | None = None) -> DataFrame:
    """Document ids that questions name: status and number of questions. used(question_id, doc_id). An id that is
    not registered is a `collision` or `missing` where it is known as such (without regard to case), else
    `unknown`; `audit_questions` names the questions."""
    known = docs.select(F.col("canonical_id").alias("doc_id")).distinct().withColumn("_k", F.lit(True))
    n = used.filter("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("question_id").alias("n_questions"))
    name, listed = F.lower(F.trim("doc_id")), lambda ids: [x.lower().strip() for x in ids or []]
    status = F.when(F.col("_k"), "resolved").when(name.isin(listed(collisions)), "collision").when(name.isin(listed(missing)), "missing").otherwise("unknown")
    return n.join(known, "doc_id", "left").select("doc_id", "n_questions", status.alias("status"))


def audit_questions(used: DataFrame, audit: DataFrame, status: str = "unknown") -> DataFrame:
    """(doc_id, question_id), each once, of the ids with a status; rows, as a list may be long."""
    return used.select("doc_id", "question_id").distinct().join(audit.filter(F.col("status") == status).select("doc_id"), "doc_id", "left_semi")


def verify_corpus(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Per registered document: articles listed and loaded, listed ones not loaded, share loaded, and whether the
    two differ. entries(canonical_id, article_eids); repeated entries and deliveries count once."""
    listed = entries.filter("canonical_id is not null").select(F.col("canonical_id").alias("doc_id"), F.explode_outer("article_eids").alias("eid")).distinct()
    loaded = articles.select("doc_id", "eid").filter("doc_id is not null and eid is not null").distinct().withColumn("_in", F.lit(1))
    n = listed.join(loaded, ["doc_id", "eid"], "left").groupBy("doc_id").agg(F.count("eid").alias("n_listed"), F.count("_in").alias("n_matched"))
    n = n.join(loaded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_loaded")), "doc_id", "left").withColumn("n_loaded", F.coalesce("n_loaded", F.lit(0)))
    share = F.when(F.col("n_listed") > 0, F.col("n_matched") / F.col("n_listed")).otherwise(0.0)
    return n.select("doc_id", "n_listed", "n_loaded", (F.col("n_listed") - F.col("n_matched")).alias("n_absent"), F.round(share, 6).alias("coverage"), ((F.col("n_listed") != F.col("n_matched")) | (F.col("n_loaded") != F.col("n_matched"))).alias("mismatch"))


def get_articles(refs: DataFrame, article_keys: DataFrame, texts: DataFrame) -> DataFrame:
    """refs(doc_id, article_ref) with eid (null: not registered) and text (empty: not indexed). Of several keys
    the first that is registered counts. texts(doc_id, eid, text)."""
    asked = refs.select("doc_id", "article_ref").distinct()
    keys = asked.select("*", F.posexplode(lookup_keys(F.col("article_ref"))).alias("_p", "key")).join(article_keys.withColumnRenamed("canonical_id", "doc_id"), ["doc_id", "key"])
    best = keys.groupBy("doc_id", "article_ref").agg(F.min_by("eid", "_p").alias("eid"))
    found = asked.join(best, ["doc_id", "article_ref"], "left").join(texts.select("doc_id", "eid", "text"), ["doc_id", "eid"], "left")
    return found.withColumn("text", F.coalesce("text", F.lit("")))
