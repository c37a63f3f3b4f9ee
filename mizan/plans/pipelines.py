"""End-to-end pipelines: questions(query_id, query) -> answers.

An answer row is query_id, abstention, abstention_reason, citations (rank, doc_id, article_ref, span,
score), answer_text. Every question of the batch gets one row. Steps that a model would take (verifying,
re-ranking, answering) are columns that a caller may replace through `Hooks`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mizan.functions import dates as D
from mizan.functions import text as T
from mizan.operators import asof, fusion, gates, graph, registry, retrieval
from mizan.session import materialise

# --- fixed values: sizes of lists and thresholds --------------------------------------------------
TOP, LIST, POOL, ROUTED, CANDIDATES, LONG = 5, 20, 50, 3, 8, 6
VERIFIED, WEAK_EVIDENCE = 0.5, 0.030
GRAPH_BOOST, CONCEPT_BOOST, DIRECT_TOP, SUB_QUESTIONS, VERSIONS = 0.01, 0.05, 3, 5, 2
ROUTE_DEPTH = 100
# --------------------------------------------------------------------------------------------------


@dataclass
class Hooks:
    """Columns over (query, text): relevance of a candidate; null stands for the share of query words."""

    verify: Column | None = None
    foreign_signals: list[tuple[str, str]] | None = None


@dataclass
class Corpus:
    """chunks(chunk_id, doc_id, article_ref, text); docs and article_keys of the registry; versions(doc_id,
    article_ref, since, ordinal, text) of the articles; vectors(chunk_id, vec), made when first used.

    lists and routes, where set, hold what was found for a batch of questions (`searched`)."""

    chunks: DataFrame
    index: retrieval.TextIndex
    docs: DataFrame
    article_keys: DataFrame
    versions: DataFrame | None = None
    lists: DataFrame | None = None
    routes: DataFrame | None = None

    @staticmethod
    def of(chunks: DataFrame, articles: DataFrame) -> Corpus:
        """From chunk and article tables; a chunk delivered again counts once."""
        key = [F.substring_index("chunk_id", "#", 1).alias("doc_id"), F.split_part("chunk_id", F.lit("#"), F.lit(2)).alias("article_ref")]
        once = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.min("text").alias("text")).select("chunk_id", *key, "text")
        docs, keys = registry.build_registry(articles)
        # tables that do not say when an article arrived have no versions
        versions = None if "loaded_at" not in articles.columns else articles.filter("doc_id is not null and eid is not null").select("doc_id", F.col("eid").alias("article_ref"), F.date_format("loaded_at", "yyyy-MM-dd").alias("since"), "ordinal", F.col("text_ar").alias("text"))
        return Corpus(once, retrieval.build_index(once), docs, keys, versions)


def _with_keys(c: Corpus, hits: DataFrame) -> DataFrame:
    return hits.join(c.chunks.select("chunk_id", "doc_id", "article_ref", "text"), "chunk_id")


def _listed(c: Corpus, q: DataFrame, list_no: int, k: int) -> DataFrame:
    """The first k of a list that was found before."""
    own = c.lists.filter((F.col("list_no") == list_no) & (F.col("rank") <= k)).drop("list_no")
    return own.join(q.select("query_id").distinct(), "query_id", "left_semi")


def lexical(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return _listed(c, q, 0, k) if c.lists is not None else _with_keys(c, retrieval.bm25_search(c.index, q, k))


def sparse(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    if c.lists is not None:
        return _listed(c, q, 1, k)
    docs, words = c.index.postings.withColumnRenamed("tf", "weight"), retrieval.query_terms(q, "query_id", "query").withColumnRenamed("qtf", "weight")
    return _with_keys(c, retrieval.sparse_search(docs, words, k))


def dense(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    """By vectors of the stand-in encoder."""
    vectors = retrieval.hashed_vectors(c.chunks, "chunk_id", "text", "chunk_id")
    return _with_keys(c, retrieval.dense_search(vectors, retrieval.hashed_vectors(q, "query_id", "query", "query_id"), k, "chunk_id", "vec", query_id="query_id"))


def hybrid(c: Corpus, q: DataFrame, k: int | None, per_list: int = LIST, second=sparse) -> DataFrame:
    """The lexical list and a second one, fused; hits with text and score."""
    lists = lexical(c, q, per_list).withColumn("list_no", F.lit(0)).unionByName(second(c, q, per_list).withColumn("list_no", F.lit(1)))
    return fusion.rrf_fuse(lists, k, carry=["text", "chunk_id"])


def searched(c: Corpus, q: DataFrame) -> Corpus:
    """The corpus with the lists and routes of a batch of questions, each found once: a bounded number of rows
    per question, with their texts. A shorter list is the head of a longer one."""
    lists = lexical(c, q, ROUTE_DEPTH).withColumn("list_no", F.lit(0)).unionByName(sparse(c, q, POOL).withColumn("list_no", F.lit(1)))
    found = replace(c, lists=materialise(lists))
    return replace(found, routes=materialise(route(found, q)))


def route(c: Corpus, q: DataFrame, n: int = ROUTED) -> DataFrame:
    """Documents of a question: by title, by law number, by their best lexical hits."""
    if c.routes is not None and n == ROUTED:
        return c.routes.join(q.select("query_id").distinct(), "query_id", "left_semi")
    titles = c.docs.filter("doc_title <> ''").select(T.normalize_arabic(F.lower("doc_title")).alias("token"), F.col("canonical_id").alias("doc_id"))
    asked = q.select("query_id", F.lower("query").alias("text"))
    alias = graph.token_hits(asked, titles, key="query_id").join(titles, "token").select("query_id", "doc_id").distinct()
    law = q.select("query_id", F.explode(T.law_ids(F.col("query"))).alias("law")).join(c.docs.select(F.substring_index("canonical_id", "_", 1).alias("law"), F.col("canonical_id").alias("doc_id")), "law").select("query_id", "doc_id").distinct()
    law = law.join(alias, ["query_id", "doc_id"], "left_anti")
    best = fusion.document_scores(lexical(c, q, ROUTE_DEPTH))
    channel = lambda d, name: d.select("query_id", "doc_id", F.lit(name).alias("channel"), (F.col("score") if "score" in d.columns else F.lit(1.0)).alias("score"))
    return fusion.fuse_channels(channel(alias, "alias").unionByName(channel(law, "number")).unionByName(channel(best, "lexical")), n)


def answers(q: DataFrame, hits: DataFrame, reason: str = "no_hits") -> DataFrame:
    """One row per question; without hits it abstains for the reason given."""
    cite = F.struct("rank", "doc_id", "article_ref", T.support_span(F.col("text")).alias("span"), F.col("score").cast("double").alias("score"))
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(cite)).alias("citations"))
    out = q.select("query_id", "query").join(got, "query_id", "left")
    none = F.col("citations").isNull()
    why = F.when(T.strip_ws(F.coalesce("query", F.lit(""))) == "", "empty_query").when(none, reason)
    said = F.array_join(F.transform("citations", lambda x: F.concat(x["doc_id"], F.lit(" — "), x["article_ref"], F.lit(": "), x["span"])), "\n\n")
    return out.select("query_id", none.alias("abstention"), why.alias("abstention_reason"), F.coalesce("citations", F.array().cast(got.schema["citations"].dataType)).alias("citations"), F.coalesce(said, F.lit("")).alias("answer_text"))


def bm25_pipeline(c: Corpus, q: DataFrame) -> DataFrame:
    return answers(q, fusion.dedup_hits(lexical(c, q, TOP)))


def dense_pipeline(c: Corpus, q: DataFrame) -> DataFrame:
    return answers(q, fusion.dedup_hits(dense(c, q, TOP)))


def dense_hybrid_pipeline(c: Corpus, q: DataFrame) -> DataFrame:
    return answers(q, hybrid(c, q, TOP, second=dense))


def hybrid_pipeline(c: Corpus, q: DataFrame) -> DataFrame:
    return answers(q, hybrid(c, q, TOP))


def hybrid_rerank_pipeline(c: Corpus, q: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    pool = hybrid(c, q, POOL, POOL).join(q, "query_id")
    return answers(q, retrieval.rerank(pool, TOP, (hooks or Hooks()).verify))


def graph_hits(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    """Chunks that hold most topic words of a question."""
    words = q.select("query_id", F.explode(T.graph_query_tokens(F.col("query"))).alias("token"))
    covered = graph.token_coverage(words, graph.token_hits(c.chunks, words, key="chunk_id"), k, key="chunk_id")
    return _with_keys(c, covered)


def graph_pipeline(c: Corpus, q: DataFrame, fallback: bool = True) -> DataFrame:
    """Graph search; questions without a hit go to the lexical pipeline, as a second plan."""
    found = materialise(fusion.dedup_hits(graph_hits(c, q, TOP)))
    if not fallback:
        return answers(q, found, "no_kg_hits")
    rest = q.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return answers(q.join(found.select("query_id").distinct(), "query_id", "left_semi"), found).unionByName(bm25_pipeline(c, rest))


def graph_hybrid_pipeline(c: Corpus, q: DataFrame) -> DataFrame:
    """Graph matches lend the question new words and lift the articles that they name."""
    found = materialise(graph_hits(c, q, TOP))
    own = q.select("query_id", F.explode(T.graph_query_tokens(F.col("query"), None)).alias("token"))
    new = fusion.expansion_terms(found.select("query_id", T.graph_query_tokens(F.col("text"), None).alias("tokens")), own)
    words = new.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), " ").alias("more"))
    asked = q.join(words, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "more").alias("query"))
    lifted = fusion.boost(hybrid(c, asked, POOL), found, GRAPH_BOOST)
    return answers(q, lifted.filter(F.col("rank") <= TOP))


def _candidates(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    """Hybrid hits within the routed documents; the filter follows the ranking."""
    kept = fusion.keep_routed(hybrid(c, q, 30, 30), route(c, q))
    w = W.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _verified(hits: DataFrame, q: DataFrame, hooks: Hooks, threshold: float = VERIFIED) -> DataFrame:
    scored = retrieval.rerank(hits.join(q, "query_id"), CANDIDATES, hooks.verify)
    return scored.filter(F.col("score") >= threshold)


def rule_application(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    return answers(q, _verified(_candidates(c, q, CANDIDATES), q, hooks), "no_verified_articles")


def article_numbers(c: Column) -> Column:
    """Canonical tokens of the articles that a question names."""
    return F.array_distinct(F.transform(T.cited_articles(c), T.canonical_article_ref))


def exact_article(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    """Articles that a question names within its routed documents, looked up; else the best lexical hits."""
    named = q.select("query_id", F.explode(article_numbers(F.col("query"))).alias("key")).join(route(c, q).select("query_id", F.col("doc_id").alias("canonical_id"), F.col("rank").alias("place")), "query_id")
    keys = named.join(c.article_keys, ["canonical_id", "key"]).select("query_id", F.col("canonical_id").alias("doc_id"), F.col("eid").alias("article_ref"), "place")
    texts = c.chunks.groupBy("doc_id", "article_ref").agg(F.min_by("text", "chunk_id").alias("text"))
    direct = keys.join(texts, ["doc_id", "article_ref"]).withColumn("score", F.lit(1.0))
    w = W.partitionBy("query_id").orderBy("place", "doc_id", "article_ref")
    direct = materialise(direct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= DIRECT_TOP).drop("place"))
    hit = direct.select("query_id").distinct()
    rest = q.join(hit, "query_id", "left_anti")
    return answers(q.join(hit, "query_id", "left_semi"), direct).unionByName(answers(rest, _verified(fusion.dedup_hits(lexical(c, rest, 30)), rest, hooks).filter(F.col("rank") <= DIRECT_TOP), "no_verified_articles"))


def multi_hop(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    """Clauses serve as sub-questions; evidence of all of them is pooled by its best confidence."""
    parts = q.select("query_id", F.posexplode(F.slice(T.claims(F.col("query")), 1, SUB_QUESTIONS)).alias("pos", "part"))
    parts = parts.select(F.concat_ws("/", F.col("query_id").cast("string"), "pos").alias("sub"), "query_id", "part")
    subs = parts.select(F.col("sub").alias("query_id"), F.col("part").alias("query"))
    found = _verified(hybrid(replace(c, lists=None, routes=None), subs, CANDIDATES), subs, hooks).withColumnsRenamed({"query_id": "sub", "query": "asked"}).join(parts.select("sub", "query_id"), "sub")
    pooled = fusion.best_confidence(found.withColumn("confidence", F.col("score")), 10)
    texts = found.groupBy("query_id", "doc_id", "article_ref").agg(F.min("text").alias("text"))
    return answers(q, pooled.join(texts, ["query_id", "doc_id", "article_ref"]).withColumn("score", F.col("confidence")), "no_verified_articles")


def long_context(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    return answers(q, fusion.dedup_hits(_candidates(c, q, LIST)).filter(F.col("rank") <= LONG))


def unanswerable(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    """Abstains on foreign signals or weak evidence, else cites."""
    hits = hybrid(c, q, TOP)
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    foreign = F.size(gates.signals(F.col("query"), hooks.foreign_signals)) > 0 if hooks.foreign_signals else F.lit(False)
    judged = q.join(top, "query_id", "left").withColumn("why", F.when(foreign, "infected_jurisdiction").when(F.coalesce("top", F.lit(0.0)) < WEAK_EVIDENCE, "weak_evidence"))
    kept = hits.join(judged.filter("why is null").select("query_id"), "query_id", "left_semi")
    out = answers(q, kept, "weak_evidence").join(judged.select("query_id", "why"), "query_id")
    return out.withColumn("abstention_reason", F.coalesce("why", "abstention_reason")).drop("why")


def temporal(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    """The candidates in the version that was in force at the latest date the question names; those of which
    every version is later go, those without versions keep the text that was found."""
    asked = q.select("query_id", D.target_date(D.dates_in(F.col("query"))).alias("at"))
    hits = _candidates(c, q, TOP).join(asked, "query_id").withColumnRenamed("text", "found")
    keys = ["doc_id", "article_ref"]
    if c.versions is None:
        return answers(q, hits.withColumnRenamed("found", "text").filter(F.col("rank") <= VERSIONS))
    dated = asof.with_fallback(asof.as_of(hits, c.versions, keys, "at", "since", "ordinal"), c.versions, keys, "found")
    w = W.partitionBy("query_id").orderBy("rank")
    kept = dated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= VERSIONS)
    return answers(q, kept.select("query_id", "rank", "doc_id", "article_ref", "text", "score"), "no_version_in_force")


def phrase_hits(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    """Chunks that hold most concept phrases of a question."""
    phrases = q.select("query_id", F.explode(T.concept_phrases(F.col("query"))).alias("token"))
    return _with_keys(c, graph.token_coverage(phrases, graph.token_hits(c.chunks, phrases, key="chunk_id"), k, key="chunk_id"))


def conceptual(c: Corpus, q: DataFrame, hooks: Hooks) -> DataFrame:
    """Lists of the question and of its phrases alone, fused; articles that hold the phrases are lifted."""
    other = q.select("query_id", F.array_join(T.concept_phrases(F.col("query")), " ").alias("query"))
    again = sparse(replace(c, lists=None), other, LIST).withColumn("list_no", F.lit(2))
    lists = lexical(c, q, LIST).withColumn("list_no", F.lit(0)).unionByName(sparse(c, q, LIST).withColumn("list_no", F.lit(1))).unionByName(again)
    lifted = fusion.boost(fusion.rrf_fuse(lists, LIST, carry=["text", "chunk_id"]), phrase_hits(c, q, POOL), CONCEPT_BOOST)
    return answers(q, lifted.filter(F.col("rank") <= TOP))


HANDLERS = {"rule_application": rule_application, "exact_article": exact_article, "multi_hop": multi_hop, "long_context": long_context, "unanswerable": unanswerable, "layman": rule_application, "temporal_factual": temporal, "conceptual_definitional": conceptual}


def dispatch(c: Corpus, questions: DataFrame, hooks: Hooks | None = None, default: str = "rule_application") -> DataFrame:
    """Splits questions(query_id, query, query_type) by handler and unites what they answer. Lists and routes
    are found once for all questions; kinds that share a handler share its plan."""
    hooks, kind = hooks or Hooks(), F.lower(F.trim("query_type"))
    known = F.when(kind.isin(list(HANDLERS)), kind).otherwise(default)
    named = materialise(questions.select("query_id", "query", known.alias("handler")))
    c = searched(c, named.select("query_id", "query"))
    out = None
    for handler in dict.fromkeys(HANDLERS.values()):
        own = named.filter(F.col("handler").isin([n for n, h in HANDLERS.items() if h is handler]))
        part = handler(c, own.select("query_id", "query"), hooks)
        out = part if out is None else out.unionByName(part)
    return out.join(named.select("query_id", "handler"), "query_id")
