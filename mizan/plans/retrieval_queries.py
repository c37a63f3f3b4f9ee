"""RET, AGG, KG, JN, GAT: retrieval, fusion, graph, as-of and gate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators import asof, fusion, gates, graph, registry, retrieval
from mizan.plans import pipelines
from mizan.plans.common_sql import CHUNKS, PREDICTIONS, answered, bm25_cte, coverage_cte, norm_ar, sparse_cte, tokens
from mizan.plans.metric_queries import results
from mizan.plans.orphan_queries import canonical_sql
from mizan.session import table

#: Own sample rules: text families that documents may carry. (pattern, id)
RULES = [("(?i)article", "fr:article"), ("المادة", "ar:article"), ("(?i)section", "en:section"), ("(?i)assur", "fr:insurance"), ("التأمين", "ar:insurance"), ("<[a-z]+>", "markup:tag")]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk").groupBy("chunk_id").agg(F.min("text").alias("text"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bench_item").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


def ret1_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = retrieval.build_index(_chunks(spark, sf_dir))
    return retrieval.idf_table(ix).join(ix.terms, "term").select("term", "df", F.round("idf", 6).alias("idf"))


def ret2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_search(retrieval.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 10)


def ret4_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.dense_search(e, e.filter("vec_id % 20 = 0"), 10).select("query_id", "rank", F.col("chunk_id").alias("vec_id"), "score")


def _sparse(ix: retrieval.TextIndex, q: DataFrame, k: int) -> DataFrame:
    docs = ix.postings.withColumnRenamed("tf", "weight")
    return retrieval.sparse_search(docs, retrieval.query_terms(q, "query_id", "query").withColumnRenamed("qtf", "weight"), k)


def ret5_sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(retrieval.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 10)


def ret6_maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four consecutive vectors form one multi-vector document; every twentieth document is a query."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = e.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return retrieval.maxsim_search(e, q, 10)


def _hits(bm: DataFrame, sp: DataFrame) -> DataFrame:
    both = bm.withColumn("list_no", F.lit(0)).unionByName(sp.withColumn("list_no", F.lit(1)))
    return both.select("query_id", "list_no", "rank", F.substring_index("chunk_id", "#", 1).alias("doc_id"), F.substring_index(F.col("chunk_id"), "#", 2).alias("article_ref"), F.col("score").cast("double").alias("score"))


def agg1_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and sparse lists of 20, fused by reciprocal rank (the hybrid pipeline)."""
    ix, q = retrieval.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir)
    fused = fusion.rrf_fuse(_hits(retrieval.bm25_search(ix, q, 20), _sparse(ix, q, 20)), 10)
    return fused.select("query_id", "rank", "article_ref", F.round("score", 6).alias("score"))


def agg4_document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a question by their five best chunks among a hundred."""
    hits = retrieval.bm25_search(retrieval.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 100)
    return fusion.document_scores(hits.withColumn("doc_id", F.substring_index("chunk_id", "#", 1))).withColumn("score", F.round("score", 5))


def agg8_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25_search(retrieval.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 10)
    h = hits.select("query_id", "rank", F.substring_index("chunk_id", "#", 1).alias("doc_id"), F.substring_index(F.col("chunk_id"), "#", 2).alias("article_ref"), "score")
    return fusion.dedup_hits(h).select("query_id", "rank", "article_ref")


def pipe_b1_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical pipeline: five chunks per question, their text, and an answer made of their heads."""
    c = _chunks(spark, sf_dir)
    hits = retrieval.bm25_search(retrieval.build_index(c), _questions(spark, sf_dir), 5).join(c, "chunk_id")
    cites = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda x: F.struct(F.lit(None).cast("string").alias("doc_title"), F.substring_index(x["chunk_id"], "#", 1).alias("doc_id"), F.split_part(x["chunk_id"], F.lit("#"), F.lit(2)).alias("article_ref"), x["text"].alias("text")))
    return hits.groupBy("query_id").agg(cites.alias("citations")).select("query_id", F.size("citations").alias("n_citations"), F.md5(T.template_answer(F.col("citations"))).alias("answer_md5"))


def pipe_b4_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool of 50 re-ranked by the stand-in scorer, first five."""
    c, q = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    pool = retrieval.bm25_search(retrieval.build_index(c), q, 50).join(c, "chunk_id").join(q, "query_id")
    return retrieval.rerank(pool, 5).select("query_id", "rank", "chunk_id", "score")


def _corpus(spark: SparkSession, sf_dir: str) -> pipelines.Corpus:
    return pipelines.Corpus.of(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "article"))


def _brief(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", "abstention", "abstention_reason", F.size("citations").alias("n_citations"), F.md5("answer_text").alias("answer_md5"))


def pipe_b3_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(pipelines.hybrid_pipeline(_corpus(spark, sf_dir), _questions(spark, sf_dir)))


def pipe_b2_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector pipeline over the stand-in encoder."""
    return _brief(pipelines.dense_pipeline(_corpus(spark, sf_dir), _questions(spark, sf_dir)))


def pipe_b3_dense_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector lists of 20, fused, first five."""
    return _brief(pipelines.dense_hybrid_pipeline(_corpus(spark, sf_dir), _questions(spark, sf_dir)))


def pipe_tf_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(pipelines.temporal(_corpus(spark, sf_dir), _questions(spark, sf_dir), pipelines.Hooks()))


def pipe_cd_conceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(pipelines.conceptual(_corpus(spark, sf_dir), _questions(spark, sf_dir), pipelines.Hooks()))


def kg11_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that hold most concept phrases of a question."""
    q = _questions(spark, sf_dir).select("query_id", F.explode(T.concept_phrases(F.col("query"))).alias("token"))
    return graph.token_coverage(q, graph.token_hits(_latest(spark, sf_dir), q), 5).select("query_id", "rank", "article", "score")


def jn7_version_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each cited article in force when the result was made; the citation's own text where the article
    has no delivery at all."""
    r = results(spark, sf_dir).select("prediction_id", "run_at", "predicted_citations")
    c = gates.cited(r).join(r.select("prediction_id", "run_at"), "prediction_id")
    t = c.select("prediction_id", "pos", "run_at", "doc_id", T.ref_to_eid(F.col("article_ref")).alias("eid"), F.col("text").alias("quoted"))
    v = table(spark, sf_dir, "article").select("doc_id", "eid", "loaded_at", "ordinal", F.coalesce("text_ar", F.lit("")).alias("text"))
    out = asof.with_fallback(asof.as_of(t, v, ["doc_id", "eid"], "run_at", "loaded_at", "ordinal"), v, ["doc_id", "eid"], "quoted")
    return out.select("prediction_id", "pos", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def pipe_b5_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(pipelines.graph_pipeline(_corpus(spark, sf_dir), _questions(spark, sf_dir)))


def pipe_b6_graph_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(pipelines.graph_hybrid_pipeline(_corpus(spark, sf_dir), _questions(spark, sf_dir)))


def pipe_d_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out questions, sent to handlers in turn."""
    kinds = F.array(*[F.lit(k) for k in pipelines.HANDLERS])
    q = _questions(spark, sf_dir).withColumn("query_type", F.get(kinds, (F.col("query_id") % len(pipelines.HANDLERS)).cast("int")))
    out = pipelines.dispatch(_corpus(spark, sf_dir), q, pipelines.Hooks(foreign_signals=[("(?i)code civil français", "fr:code")]))
    return out.select("query_id", "handler", "abstention", "abstention_reason", F.size("citations").alias("n_citations"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "article")
    return a.groupBy("doc_id", "eid").agg(F.max_by("text_ar", "ordinal").alias("text")).select(F.concat_ws("#", "doc_id", "eid").alias("article"), "text")


def kg5_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that hold most topic words of a question."""
    q = _questions(spark, sf_dir).select("query_id", F.explode(T.graph_query_tokens(F.col("query"))).alias("token"))
    return graph.token_coverage(q, graph.token_hits(_latest(spark, sf_dir), q), 5).select("query_id", "rank", "article", "score")


def kg1_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of laws, with the law's title, as a graph pattern of three."""
    t = graph.article_triples(table(spark, sf_dir, "article"))
    return graph.bgp(t, [("?doc", "type", "law"), ("?doc", "title", "?title"), ("?doc", "hasArticle", "?article")])


def jn6_version_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery of each cited article that was in force when the result was made."""
    c = gates.cited(results(spark, sf_dir).select("prediction_id", "run_at", "gold_citations"), "gold_citations")
    t = c.join(results(spark, sf_dir).select("prediction_id", "run_at"), "prediction_id").select("prediction_id", "pos", "run_at", "doc_id", T.ref_to_eid(F.col("article_ref")).alias("eid"))
    v = table(spark, sf_dir, "article").select("doc_id", "eid", "loaded_at", "ordinal")
    return asof.as_of(t, v, ["doc_id", "eid"], "run_at", "loaded_at", "ordinal").select("prediction_id", "pos", F.col("version.ordinal").alias("ordinal"))


def jn3_existence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, keys = registry.build_registry(table(spark, sf_dir, "article"))
    return gates.existence_gate(results(spark, sf_dir).select("prediction_id", "predicted_citations"), keys)


def jn5_span_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the quoted span of a citation stands in the latest text of its article."""
    c = gates.cited(results(spark, sf_dir).select("prediction_id", "predicted_citations"))
    c = c.withColumn("article", F.concat_ws("#", "doc_id", T.ref_to_eid(F.col("article_ref"))))
    j = c.join(_latest(spark, sf_dir).withColumnRenamed("text", "article_text"), "article", "left")
    g = gates.span_supported(F.col("article_text"), F.col("supporting_span"))
    return j.select("prediction_id", "pos", g["passed"].alias("passed"), g["reason"].alias("reason"))


def jn10_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = results(spark, sf_dir).select("question_id", F.explode("gold_doc_ids").alias("doc_id"))
    return registry.audit_ids(used, table(spark, sf_dir, "doc_entry"))


def agg17_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.list_documents(table(spark, sf_dir, "article"))


def agg18_registry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.build_registry(table(spark, sf_dir, "article"))[1]


def agg18_registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.build_registry(table(spark, sf_dir, "article"))[0]


def flt8_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(gates.signals(F.col("text"), RULES), ",").alias("signals"))


def agg21_signal_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.signal_counts(table(spark, sf_dir, "documents"), "text", RULES)


QUERIES = {
    f.__name__: f
    for f in (ret1_index_terms, ret2_bm25_topk, ret4_dense_topk, ret5_sparse_topk, ret6_maxsim_topk, agg1_rrf, agg4_document_scores, agg8_first_hits, pipe_b1_answers, pipe_b2_dense, pipe_b3_hybrid, pipe_b3_dense_hybrid, pipe_tf_temporal, pipe_cd_conceptual, kg11_phrase_search, jn7_version_text, pipe_b4_reranked, pipe_b5_graph, pipe_b6_graph_hybrid, pipe_d_dispatch, kg1_pattern, kg5_token_search, jn3_existence_gate, jn5_span_gate, jn6_version_in_force, jn10_audit, agg17_documents, agg18_registry_docs, agg18_registry_keys, flt8_signals, agg21_signal_families)
}

_B10, _B20 = bm25_cte(10), bm25_cte(20)
_KEYS_SQL = f"""rk as (select doc_id, eid, ordinal, {canonical_sql('article_ref')} as token, {norm_ar('article_ref')} as norm from article where doc_id is not null),
  ke as (select doc_id as canonical_id, unnest(list_distinct(list_filter([token, norm, regexp_extract(norm, '(\\d+)', 1)], lambda x: x <> ''))) as key, eid, ordinal from rk),
  keys as (select canonical_id, key, arg_max(eid, ordinal) as eid from ke group by all)"""
_SIG = "list_filter([" + ", ".join("case when regexp_matches(coalesce(text, ''), '{}') then '{}' end".format(*r) for r in RULES) + "], lambda x: x is not null)"

_KEYED = "split_part(chunk_id, '#', 1) as doc_id, split_part(chunk_id, '#', 2) as article_ref"
_FIRST = "qualify row_number() over (partition by query_id, doc_id, article_ref order by rank) = 1"
_LATEST = "select concat_ws('#', doc_id, eid) as key, arg_max_null(text_ar, ordinal) as text from article group by doc_id, eid"


def fused_cte(lists: str, k: int) -> str:
    """CTE fu(query_id, rank, doc_id, article_ref, text): lists(query_id, l, rank, chunk_id) by reciprocal rank."""
    return f"""kx as (select query_id, l, rank, {_KEYED}, text from ({lists}) h join {CHUNKS} c using (chunk_id)),
      fx as (select query_id, doc_id, article_ref, round(sum(1.0::double / (60 + rank)), 9) as s, min(l * 1000 + rank) as seen, arg_min(text, l * 1000 + rank) as text from kx group by 1, 2, 3),
      fu as (select *, row_number() over (partition by query_id order by s desc, seen, doc_id, article_ref) as rank from fx qualify row_number() over (partition by query_id order by s desc, seen, doc_id, article_ref) <= {k})"""


def _dense_cte(k: int) -> str:
    """CTE dn(query_id, rank, chunk_id, score): cosine of hashed token counts."""
    parts = "(('0x' || substr(h, 1, 2))::int) as i, sum(case when substr(h, 3, 1) < '8' then 1.0::double else -1.0 end) as w"
    return f"""dc as (select chunk_id, {parts} from (select chunk_id, md5(unnest({tokens('text')})) as h from {CHUNKS} c) group by chunk_id, i),
      dq as (select query_id, {parts} from (select item_id as query_id, md5(unnest({tokens('question')})) as h from bench_item) group by query_id, i),
      ds as (select query_id, chunk_id, round(coalesce(dot, 0) / greatest(ln * qn, 1e-30), 6) as score from (select * from (select chunk_id, sqrt(sum(w * w)) as ln from dc group by 1) a, (select query_id, sqrt(sum(w * w)) as qn from dq group by 1) b) n
        left join (select query_id, chunk_id, sum(dq.w * dc.w) as dot from dq join dc using (i) group by all) using (query_id, chunk_id)),
      dn as (select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from ds qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {k})"""


ORACLES = {
    "pipe_b1_answers": f"""with {bm25_cte(5)}, h as (select query_id, rank, {_KEYED}, text from bm join {CHUNKS} c using (chunk_id))
      select query_id, count(*) as n_citations, md5(string_agg(doc_id || ' — ' || article_ref || ': ' || substr(coalesce(text, ''), 1, 280), chr(10) || chr(10) order by rank)) as answer_md5 from h group by 1""",
    "pipe_b3_hybrid": f"with {_B20}, {sparse_cte(20)}, {fused_cte('select query_id, 0 as l, rank, chunk_id from bm union all select query_id, 1, rank, chunk_id from sp', 5)}, {answered('fu')}",
    "pipe_b2_dense": f"with {_dense_cte(5)}, top5 as (select query_id, rank, {_KEYED}, text from dn join {CHUNKS} c using (chunk_id) {_FIRST}), {answered('top5')}",
    "pipe_b3_dense_hybrid": f"with {_B20}, {_dense_cte(20)}, {fused_cte('select query_id, 0 as l, rank, chunk_id from bm union all select query_id, 1, rank, chunk_id from dn', 5)}, {answered('fu')}",
    "kg11_phrase_search": f"with {coverage_cte(_LATEST, 5, phrases=True)} select query_id, rank, key as article, score from cov",
    "jn7_version_text": f"""with c as (select prediction_id, run_at, unnest(predicted_citations) as c, generate_subscripts(predicted_citations, 1) - 1 as pos from {PREDICTIONS} p0),
      t as (select prediction_id, pos, run_at, c.doc_id as doc_id, case when {canonical_sql('c.article_ref')} = '' then '' else 'art_' || {canonical_sql('c.article_ref')} end as eid, c.text as quoted from c),
      j as (select t.prediction_id, t.pos, any_value(t.quoted) as quoted, count(a.ordinal) as n, count(*) filter (a.loaded_at <= t.run_at) as fit,
        arg_max(coalesce(a.text_ar, ''), {{'l': a.loaded_at, 'o': a.ordinal}}) filter (a.loaded_at <= t.run_at) as text from t left join article a on a.doc_id = t.doc_id and a.eid = t.eid group by 1, 2)
      select prediction_id, cast(pos as int) as pos, case when fit > 0 then 'version' else 'fallback' end as source, md5(coalesce(case when fit > 0 then text else quoted end, '')) as text_md5 from j where fit > 0 or n = 0""",
    "pipe_b4_reranked": f"""with {bm25_cte(50)}, h as (select bm.query_id, bm.rank, chunk_id, list_distinct({tokens('q0.query')}) as q, list_distinct({tokens('c.text')}) as t from bm join {CHUNKS} c using (chunk_id) join q0 on q0.query_id = bm.query_id),
      s as (select query_id, chunk_id, rank as old, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) as score from h)
      select query_id, cast(row_number() over (partition by query_id order by score desc, old) as int) as rank, chunk_id, score from s qualify row_number() over (partition by query_id order by score desc, old) <= 5""",
    "pipe_b5_graph": f"""with {bm25_cte(5)}, {coverage_cte(f'select chunk_id as key, text from {CHUNKS} c', 5)}, h as (select query_id, rank, key as chunk_id from cov union all select query_id, rank, chunk_id from bm where query_id not in (select query_id from cov)),
      top5 as (select query_id, rank, {_KEYED}, text from h join {CHUNKS} c using (chunk_id) {_FIRST}), {answered('top5')}""",
    "kg5_token_search": f"with {coverage_cte(_LATEST, 5)} select query_id, rank, key as article, score from cov",
    "jn5_span_gate": f"""with c as (select prediction_id, unnest(predicted_citations) as c, generate_subscripts(predicted_citations, 1) - 1 as pos from {PREDICTIONS} p0),
      k as (select prediction_id, pos, concat_ws('#', c.doc_id, case when {canonical_sql('c.article_ref')} = '' then '' else 'art_' || {canonical_sql('c.article_ref')} end) as key, lower({norm_ar('c.supporting_span')}) as s from c),
      t as (select prediction_id, pos, s, l.text is null as gone, lower({norm_ar('l.text')}) as t,
        list_filter(list_transform(regexp_split_to_array(s, '[،؛؟.,;:!?\\n]+'), lambda y: trim(y)), lambda y: length(y) >= 12) as p from k left join ({_LATEST}) l using (key)),
      r as (select *, case when length(s) = 0 then 'no_span' when gone then 'no_article' when length(s) < 12 then 'too_short' when contains(t, s) then 'exact'
        when len(p) > 0 and len(list_filter(p, lambda y: contains(t, y))) / len(p) >= 0.5 then 'clauses' else 'absent' end as reason from t)
      select prediction_id, cast(pos as int) as pos, reason in ('no_span', 'exact', 'clauses') as passed, reason from r""",
    "ret1_index_terms": f"with {_B10}, dfs as (select term, count(*) as df from post group by 1) select term, df, round(idf, 6) as idf from dfs join idf using (term)",
    "ret2_bm25_topk": f"with {_B10} select * from bm",
    "ret4_dense_topk": """with s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as s6 from embeddings q, embeddings v where q.vec_id % 20 = 0)
      select query_id, cast(row_number() over (partition by query_id order by s6 desc, vec_id) as int) as rank, vec_id, s6 as score from s qualify row_number() over (partition by query_id order by s6 desc, vec_id) <= 10""",
    "ret5_sparse_topk": f"with {_B10}, {sparse_cte(10)} select * from sp",
    "ret6_maxsim_topk": """with e as (select vec_id // 4 as c, vec_id as p, embedding::double[] as v from embeddings), m as (select q.c as query_id, q.p, d.c as chunk_id, max(list_cosine_similarity(q.v, d.v)) as best from e q, e d where q.c % 20 = 0 group by all),
      s as (select query_id, chunk_id, round(sum(best), 6) as s6 from m group by all)
      select query_id, cast(row_number() over (partition by query_id order by s6 desc, chunk_id) as int) as rank, chunk_id, s6 as score from s qualify row_number() over (partition by query_id order by s6 desc, chunk_id) <= 10""",
    "agg1_rrf": f"""with {_B20}, {sparse_cte(20)}, hits as (select query_id, 0 as l, rank, chunk_id from bm union all select query_id, 1, rank, chunk_id from sp),
      k as (select query_id, l, rank, split_part(chunk_id, '#', 1) as doc_id, split_part(chunk_id, '#', 1) || '#' || split_part(chunk_id, '#', 2) as article_ref from hits),
      f as (select query_id, doc_id, article_ref, round(sum(1.0::double / (60 + rank)), 9) as s, min(l * 1000 + rank) as seen from k group by all)
      select query_id, cast(row_number() over (partition by query_id order by s desc, seen, doc_id, article_ref) as int) as rank, article_ref, round(s, 6) as score from f qualify row_number() over (partition by query_id order by s desc, seen, doc_id, article_ref) <= 10""",
    "agg4_document_scores": f"""with {bm25_cte(100)}, h as (select query_id, split_part(chunk_id, '#', 1) as doc_id, rank, score from bm), t as (select * from h qualify row_number() over (partition by query_id, doc_id order by score desc, rank) <= 5),
      s as (select query_id, doc_id, sum(score) as s from t group by all) select query_id, doc_id, round(s / max(s) over (partition by query_id), 5) as score from s qualify max(s) over (partition by query_id) > 0""",
    "agg8_first_hits": f"""with {_B10}, h as (select query_id, rank, split_part(chunk_id, '#', 1) || '#' || split_part(chunk_id, '#', 2) as article_ref from bm), f as (select query_id, article_ref, min(rank) as r from h group by all)
      select query_id, cast(row_number() over (partition by query_id order by r) as int) as rank, article_ref from f""",
    "kg1_pattern": """select distinct d.doc_id as doc, t.doc_title as title, a.doc_id || '#' || a.eid as article from (select distinct doc_id from article where doc_type = 'law' and eid is not null) d
      join (select distinct doc_id, doc_title from article where doc_title is not null and eid is not null) t using (doc_id) join (select distinct doc_id, eid from article where eid is not null) a using (doc_id)""",
    "jn3_existence_gate": f"""with {_KEYS_SQL}, c as (select prediction_id, unnest(predicted_citations) as c from {PREDICTIONS} p0),
      r as (select distinct c.doc_id as d, c.article_ref as ref from c), f as (select d, ref, exists (select 1 from keys where canonical_id = d and key in ({canonical_sql('ref')}, {norm_ar('ref')})) as found from r),
      n as (select prediction_id, count(*) filter (coalesce(found, false)) as valid, count(*) filter (not coalesce(found, false)) as rejected from c left join f on c.c.doc_id is not distinct from d and c.c.article_ref is not distinct from ref group by 1)
      select p.prediction_id, coalesce(valid, 0) as valid, coalesce(rejected, 0) as rejected, round(case when valid + rejected > 0 then rejected / (valid + rejected) else 0 end, 6) as rejected_share from {PREDICTIONS} p left join n using (prediction_id)""",
    "jn6_version_in_force": f"""with c as (select prediction_id, run_at, unnest(gold_citations) as c, generate_subscripts(gold_citations, 1) - 1 as pos from {PREDICTIONS} p0),
      t as (select prediction_id, pos, run_at, c.doc_id as doc_id, case when {canonical_sql('c.article_ref')} = '' then '' else 'art_' || {canonical_sql('c.article_ref')} end as eid from c)
      select t.prediction_id, cast(t.pos as int) as pos, arg_max(a.ordinal, {{'l': a.loaded_at, 'o': a.ordinal}}) as ordinal from t left join article a on a.doc_id = t.doc_id and a.eid = t.eid and a.loaded_at <= t.run_at group by t.prediction_id, t.pos""",
    "jn10_audit": f"""with u as (select question_id, unnest(gold_doc_ids) as doc_id from {PREDICTIONS} p0) select doc_id, count(distinct question_id) as n_questions, case when exists (select 1 from doc_entry e where e.canonical_id = u.doc_id) then 'resolved' else 'unknown' end as status
      from u where doc_id is not null group by doc_id""",
    "agg17_documents": "select doc_id, count(distinct eid) as n_articles from article group by 1",
    "agg18_registry_docs": "select doc_id as canonical_id, doc_title, doc_date, doc_type, filename_stem from article where doc_id is not null qualify row_number() over (partition by doc_id order by ordinal) = 1",
    "agg18_registry_keys": f"with {_KEYS_SQL} select * from keys",
    "flt8_signals": f"select doc_id, array_to_string({_SIG}, ',') as signals from documents",
    "agg21_signal_families": f"with s as (select doc_id, unnest(list_distinct(list_transform({_SIG}, lambda x: split_part(x, ':', 1)))) as family from documents) select family, count(*) as n from s group by 1",
}

