"""KG, JN, AGG, FLT, RET: lookups, versions, audits and roll-ups over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import metrics as M
from mizan.functions import text as T
from mizan.operators import asof, batch, gates, graph, registry, strata
from mizan.plans import metric_queries as MQ
from mizan.plans.common_sql import PREDICTIONS, bm25_cte, coverage_cte, norm_ar
from mizan.plans.metric_queries import results
from mizan.plans.orphan_queries import canonical_sql
from mizan.plans.retrieval_queries import _KEYS_SQL, _LATEST, _chunks, _questions
from mizan.session import materialise, table

#: Metric columns of the macro roll-up that stored results carry.
STORED = ["hcr", "jir", "latency_s", "tokens_used", "retry_count", "sub_call_count"]


def kg2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title holds a topic word of some question, ten per word."""
    words = _questions(spark, sf_dir).select(F.explode(T.graph_query_tokens(F.col("query"))).alias("token"))
    docs = table(spark, sf_dir, "doc_entry").filter("doc_title is not null").groupBy(F.col("canonical_id").alias("entity")).agg(F.min("doc_title").alias("label"))
    return graph.entity_lookup(docs, words)


def kg4_articles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.articles_of(table(spark, sf_dir, "article"))


def kg7_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by the URI of their document, with a part below the article."""
    a = table(spark, sf_dir, "article").filter("frbr_uri is not null and eid is not null")
    return graph.resolve_uri(a.select("ordinal", F.concat("frbr_uri", F.lit("#"), "eid", F.lit("/para_1")).alias("uri")), table(spark, sf_dir, "doc_entry")).select("ordinal", "doc_id", "article_ref")


def kg13_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of each article as a chain of versions."""
    return asof.version_chain(table(spark, sf_dir, "article").select("doc_id", "eid", "ordinal", "loaded_at"), ["doc_id", "eid"], "loaded_at", "ordinal")


def jn8_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations without a text take the latest text of their article."""
    c = gates.cited(results(spark, sf_dir).select("prediction_id", "predicted_citations")).withColumn("eid", T.ref_to_eid(F.col("article_ref")))
    latest = table(spark, sf_dir, "article").groupBy("doc_id", "eid").agg(F.max_by("text_ar", "ordinal").alias("whole"))
    filled = F.coalesce(F.nullif("text", F.lit("")), "whole", F.lit(""))
    return c.join(latest, ["doc_id", "eid"], "left").select("prediction_id", "pos", F.md5(filled).alias("text_md5"))


def jn9_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the first run, replaced by those of the last where it answered the question again."""
    r = results(spark, sf_dir).select("question_id", "prediction_id", "run_id")
    ends = r.agg(F.min("run_id").alias("a"), F.max("run_id").alias("b"))
    named = r.join(F.broadcast(ends), F.lit(True))
    return asof.upsert(named.filter("run_id = a").drop("a", "b"), named.filter("run_id = b").drop("a", "b"), ["question_id"])


def agg19_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.verify_corpus(table(spark, sf_dir, "doc_entry"), table(spark, sf_dir, "article"))


def flt12_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("predicted_citations")
    return results(spark, sf_dir).select("prediction_id", gates.should_supervise(c).alias("many"), gates.should_supervise(c, 2, 0.3, 0.8).alias("in_band"))


def ret11_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited articles by their written reference, with their latest text."""
    a = table(spark, sf_dir, "article")
    refs = gates.cited(results(spark, sf_dir).select("prediction_id", "gold_citations"), "gold_citations").filter("doc_id is not null and article_ref is not null")
    texts = a.groupBy("doc_id", "eid").agg(F.max_by("text_ar", "ordinal").alias("text"))
    return registry.get_articles(refs, registry.build_registry(a)[1], texts).select("doc_id", "article_ref", "eid", F.md5("text").alias("text_md5"))


def ret13_shared_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hit of every stored result's query; equal queries are searched once."""
    r = results(spark, sf_dir).select("prediction_id", "query").filter("query is not null")
    once = materialise(r.select("query").distinct().select(F.md5("query").alias("query_id"), "query"))
    top = batch.bm25_batch(_chunks(spark, sf_dir), once, 1)
    return r.select("prediction_id", F.md5("query").alias("query_id")).join(top, "query_id").select("prediction_id", "chunk_id", "score")


def met17_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign signals in answers to answerable questions; faithfulness, 1 for abstentions and 0 where missing."""
    foreign = F.size(gates.signals(F.col("answer_text"), FOREIGN)) > 0
    jir = F.when(~F.coalesce("gold_abstain", F.lit(False)) & foreign, 1.0).otherwise(0.0)
    faith = F.when(F.coalesce("predicted_abstain", F.lit(False)), 1.0).otherwise(F.coalesce("answer_faithfulness", F.lit(0.0)))
    return results(spark, sf_dir).select("prediction_id", jir.alias("jir"), F.round(faith, 6).alias("faithfulness"))


def agg11_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics of every run, with abstention and telemetry; one aggregation over single-pass rows."""
    p, g = M.citation_keys(F.col("predicted_citations")), M.citation_keys(F.col("gold_citations"))
    pa, ga, pd, gd = (F.col(c) for c in ("pred_article_ids", "gold_article_ids", "pred_doc_ids", "gold_doc_ids"))
    a, ga_ = F.col("answer_text"), F.col("gold_answer_text")
    cols = {
        "mrr": M.mrr_at_k(pa, ga, MQ.K), "recall": M.recall_at_k(pa, ga, MQ.K), "precision_k": M.precision_at_k(pa, ga, MQ.K), "ndcg": M.ndcg_at_k(pa, ga, MQ.K), "map": M.map_at_k(pa, ga, MQ.K), "mrr_doc": M.mrr_at_k(pd, gd, MQ.K),
        "precision": M.set_precision(p, g), "recall_cited": M.set_recall(p, g), "f1": M.set_f1(p, g), "doc_f1": M.set_f1(pd, gd), "exact": M.exact_match(a, ga_), "token_f1": M.token_f1(a, ga_), "tau": M.kendall_tau(pa, ga),
        "rouge_l": M.rouge_l(a, ga_), "chain_score": M.reasoning_chain_score(F.col("reasoning_chain"), F.col("gold_reasoning_chain")), "grounded": M.groundedness(F.col("predicted_citations"), a),
    }
    rows = results(spark, sf_dir).select("run_id", *STORED, "predicted_abstain", "gold_abstain", *[F.round(c, 6).alias(n) for n, c in cols.items()])
    means = [F.round(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), 5).alias(m) for m in [*cols, *STORED]]
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *means, *strata.abstention(F.col("predicted_abstain"), F.col("gold_abstain")))


def agg14_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response metrics by kind, category and difficulty; foreign signals count over unanswerable questions only."""
    p, g = F.col("pred_article_ids"), F.col("gold_article_ids")
    rows = results(spark, sf_dir).select(*[F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown")).alias(c) for c in ("query_type", "legal_category", "difficulty")], M.response_f1(p, g)["f1"].alias("f1"), M.response_first(p, g)["p1"].alias("p1"), M.response_hallucinates(p, g).cast("int").alias("hallucinates"), F.coalesce("gold_abstain", F.lit(False)).alias("open"), F.coalesce("jir", F.lit(0.0)).alias("jir"))
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("value")) for d, v in (("overall", F.lit("all")), *((c, F.col(c)) for c in ("query_type", "legal_category", "difficulty")))])).alias("d")
    mean = lambda c: F.round(F.avg(c), 4)
    return rows.select(dims, "f1", "p1", "hallucinates", "open", "jir").groupBy("d.dim", "d.value").agg(F.count(F.lit(1)).alias("n"), mean("f1").alias("f1"), mean("p1").alias("p1"), mean("hallucinates").alias("hallucinates"), mean(F.when(F.col("open"), F.col("jir"))).alias("jir"))


#: Own sample rules of foreign signals: (pattern, id).
FOREIGN = [("(?i)code civil", "fr:code"), ("(?i)common law", "en:law"), ("القانون الفرنسي", "ar:french")]

QUERIES = {
    f.__name__: f
    for f in (kg2_entities, kg4_articles_of, kg7_uris, kg13_versions, jn8_enriched, jn9_retried, agg19_verification, flt12_supervised, ret11_articles, ret13_shared_queries, met17_pass_through, agg11_macro, agg14_responses)
}

_EID = f"case when {canonical_sql('c.article_ref')} = '' then '' else 'art_' || {canonical_sql('c.article_ref')} end"
_CITED = f"select prediction_id, unnest({{0}}) as c, generate_subscripts({{0}}, 1) - 1 as pos from {PREDICTIONS} p0"
_KIND = "coalesce(nullif(lower(trim({0})), ''), 'unknown')"
_PARTS = {"met1_ranking": ["mrr", "recall", "precision_k", "ndcg", "map", "mrr_doc"], "met6_citations": ["precision", "recall as recall_cited", "f1", "doc_f1"], "met10_text": ["exact", "token_f1"], "met9_kendall_tau": ["tau"], "met12_rouge": ["rouge_l"], "met15_reasoning": ["chain_score"], "met19_groundedness": ["grounded"]}
_MACRO = f"{PREDICTIONS} p" + "".join(f" join (select prediction_id, {', '.join(c)} from ({MQ.ORACLES[n]}) x) {n} using (prediction_id)" for n, c in _PARTS.items())
_NAMES = [c.split(" as ")[-1] for cs in _PARTS.values() for c in cs]

ORACLES = {
    "kg2_entities": f"""with {coverage_cte(_LATEST, 1)}, d as (select canonical_id as entity, min(doc_title) as label from doc_entry where doc_title is not null group by 1), n as (select *, {norm_ar('lower(label)')} as norm from d)
      select token as surface, entity, label from (select distinct lower(token) as token from tw where token <> '') t join n on contains(n.norm, t.token) qualify row_number() over (partition by token order by entity) <= 10""",
    "kg4_articles_of": """with o as (select doc_id, eid, min(ordinal) as ordinal from article where doc_id is not null and eid is not null group by all)
      select *, cast(row_number() over (partition by doc_id order by ordinal) as int) as place from o qualify row_number() over (partition by doc_id order by ordinal) <= 50""",
    "kg7_uris": r"""with a as (select ordinal, eid, regexp_extract(frbr_uri, '/\d{4}-\d{2}-\d{2}/([^/#]+)', 1) as n, regexp_extract(frbr_uri, '/(\d{4}-\d{2}-\d{2})/', 1) as d from article where frbr_uri is not null and eid is not null)
      select ordinal, case when n || '_' || d in (select canonical_id from doc_entry) then n || '_' || d else n end as doc_id, eid as article_ref from a""",
    "kg13_versions": """select doc_id, eid, ordinal, loaded_at, cast(row_number() over w as int) as version_no, lead(loaded_at) over w as until from article where doc_id is not null and eid is not null and loaded_at is not null
      window w as (partition by doc_id, eid order by loaded_at, ordinal)""",
    "jn8_enriched": f"""with c as ({_CITED.format('predicted_citations')}), l as (select doc_id, eid, arg_max_null(text_ar, ordinal) as t from article group by all)
      select prediction_id, cast(pos as int) as pos, md5(coalesce(nullif(c.text, ''), l.t, '')) as text_md5 from c left join l on l.doc_id = c.doc_id and l.eid = {_EID}""",
    "jn9_retried": f"""with r as (select question_id, prediction_id, run_id from {PREDICTIONS} p0), b as (select * from r where run_id = (select max(run_id) from r))
      select * from b union all select * from r where run_id = (select min(run_id) from r) and question_id not in (select question_id from b where question_id is not null)""",
    "agg19_verification": """with l as (select distinct canonical_id as doc_id, unnest(case when len(article_eids) > 0 then article_eids else [null] end) as eid from doc_entry where canonical_id is not null),
      a as (select distinct doc_id, eid from article where doc_id is not null and eid is not null), n as (select l.doc_id, count(l.eid) as n_listed, count(a.eid) as m from l left join a using (doc_id, eid) group by 1),
      k as (select doc_id, count(*) as n_loaded from a group by 1)
      select doc_id, n_listed, coalesce(n_loaded, 0) as n_loaded, n_listed - m as n_absent, round(case when n_listed > 0 then m / n_listed else 0 end, 6) as coverage, n_listed <> m or coalesce(n_loaded, 0) <> m as mismatch from n left join k using (doc_id)""",
    "flt12_supervised": f"""select prediction_id, coalesce(len(predicted_citations), 0) >= 3 as many, coalesce(len(predicted_citations), 0) >= 2 and coalesce(predicted_citations[1].confidence, 0) between 0.3 and 0.8 as in_band from {PREDICTIONS} p0""",
    "ret11_articles": f"""with {_KEYS_SQL}, c as (select distinct c.doc_id as d, c.article_ref as r from ({_CITED.format('gold_citations')}) where c.doc_id is not null and c.article_ref is not null), l as (select doc_id, eid, arg_max_null(text_ar, ordinal) as t from article group by all),
      e as (select d, r, coalesce((select eid from keys where canonical_id = d and key = {canonical_sql('r')} and key <> ''), (select eid from keys where canonical_id = d and key = {norm_ar('r')} and key <> '')) as eid from c)
      select d as doc_id, r as article_ref, e.eid, md5(coalesce(t, '')) as text_md5 from e left join l on l.doc_id = d and l.eid = e.eid""",
    "ret13_shared_queries": f"with {bm25_cte(1, f'select distinct md5(query) as query_id, query from {PREDICTIONS} p0 where query is not null')} select prediction_id, chunk_id, score from {PREDICTIONS} p join bm on bm.query_id = md5(p.query)",
    "met17_pass_through": f"""select prediction_id, case when not coalesce(gold_abstain, false) and ({' or '.join(f"regexp_matches(coalesce(answer_text, ''), '{r}')" for r, _ in FOREIGN)}) then 1.0 else 0.0 end as jir,
      round(case when coalesce(predicted_abstain, false) then 1.0 else coalesce(answer_faithfulness, 0) end, 6) as faithfulness from {PREDICTIONS} p0""",
    "agg11_macro": f"""select * from (select run_id, count(*) as n, {', '.join(f'round(avg(coalesce({c}, 0)), 5) as {c}' for c in [*_NAMES, *STORED])} from {_MACRO} group by 1) m join ({MQ.ORACLES['met20_abstention']}) a using (run_id)""",
    "agg14_responses": f"""with m as (select {', '.join(_KIND.format(c) + ' as ' + c for c in ('query_type', 'legal_category', 'difficulty'))}, f1, p1, hallucinates, coalesce(gold_abstain, false) as open, coalesce(jir, 0) as jir from {PREDICTIONS} p join ({MQ.ORACLES['met22_responses']}) x using (prediction_id)),
      u as (select 'overall' as dim, 'all' as value, * from m union all select 'query_type', query_type, * from m union all select 'legal_category', legal_category, * from m union all select 'difficulty', difficulty, * from m)
      select dim, value, count(*) as n, round(avg(f1), 4) as f1, round(avg(p1), 4) as p1, round(avg(hallucinates), 4) as hallucinates, round(avg(jir) filter (open), 4) as jir from u group by 1, 2""",
}
