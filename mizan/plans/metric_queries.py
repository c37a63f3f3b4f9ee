"""MET and AGG: metrics of the stored results, each result once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import metrics as M
from mizan.operators import strata
from mizan.plans.common_sql import PREDICTIONS, rouge, words
from mizan.session import table

K = 10


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results, once per prediction_id."""
    return table(spark, sf_dir, "predictions").dropDuplicates(["prediction_id"])


def met1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("pred_article_ids"), F.col("gold_article_ids")
    cols = {"mrr": M.mrr_at_k(p, g, K), "recall": M.recall_at_k(p, g, K), "precision_k": M.precision_at_k(p, g, K), "ndcg": M.ndcg_at_k(p, g, K), "map": M.map_at_k(p, g, K), "mrr_doc": M.mrr_at_k(F.col("pred_doc_ids"), F.col("gold_doc_ids"), K)}
    return results(spark, sf_dir).select("prediction_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


def met6_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = M.citation_keys(F.col("predicted_citations")), M.citation_keys(F.col("gold_citations"))
    pd_, gd = F.col("pred_doc_ids"), F.col("gold_doc_ids")
    cols = {"precision": M.set_precision(p, g), "recall": M.set_recall(p, g), "f1": M.set_f1(p, g), "doc_f1": M.set_f1(pd_, gd)}
    return results(spark, sf_dir).select("prediction_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


def met9_kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("prediction_id", F.round(M.kendall_tau(F.col("pred_article_ids"), F.col("gold_article_ids")), 6).alias("tau"))


def met10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, g = F.col("answer_text"), F.col("gold_answer_text")
    return results(spark, sf_dir).select("prediction_id", M.exact_match(a, g).alias("exact"), F.round(M.token_f1(a, g), 6).alias("token_f1"))


def met12_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("prediction_id", F.round(M.rouge_l(F.col("answer_text"), F.col("gold_answer_text")), 6).alias("rouge_l"))


def met15_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("prediction_id", F.round(M.reasoning_chain_score(F.col("reasoning_chain"), F.col("gold_reasoning_chain")), 6).alias("chain_score"))


def met19_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("prediction_id", F.round(M.groundedness(F.col("predicted_citations"), F.col("answer_text")), 6).alias("grounded"))


def met20_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("run_id").agg(*strata.abstention(F.col("predicted_abstain"), F.col("gold_abstain")))


def met21_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.aggregate(results(spark, sf_dir), ["latency_s", "tokens_used", "retry_count", "sub_call_count"], ["run_id"])


def met22_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("pred_article_ids"), F.col("gold_article_ids")
    f, first = M.response_f1(p, g), M.response_first(p, g)
    return results(spark, sf_dir).select("prediction_id", f["precision"].alias("precision"), f["recall"].alias("recall"), f["f1"].alias("f1"), first["p1"].alias("p1"), F.round(first["mrr"], 6).alias("mrr"), M.response_hallucinates(p, g).cast("int").alias("hallucinates"))


def agg12_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = M.citation_keys(F.col("predicted_citations")), M.citation_keys(F.col("gold_citations"))
    rows = results(spark, sf_dir).withColumn("citation_f1", M.set_f1(p, g))
    rows = rows.withColumns({c: F.lower(F.trim(c)) for c in strata.DIMENSIONS})
    return strata.stratify(rows, ["citation_f1", "hcr", "jir", "latency_s"])


def agg13_first_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).select("prediction_id", F.coalesce(F.nullif(F.lower(F.trim("query_type")), F.lit("")), F.lit("unknown")).alias("kind"))
    return strata.first_per_stratum(rows, "kind", ["prediction_id"], 5)


def agg15_route_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata.route_recall(results(spark, sf_dir), "pred_doc_ids", "gold_doc_ids", 3)


def agg16_freshest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest result of every question."""
    return strata.freshest(results(spark, sf_dir).select("question_id", "run_id", "run_at", "prediction_id"), "question_id", "run_at", ["prediction_id"]).select("question_id", "prediction_id")


def agg20_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = results(spark, sf_dir).select("run_id", F.explode("calls_by_model").alias("model", "n"))
    return c.groupBy("run_id", "model").agg(F.sum("n").alias("calls"))


def snk5_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean citation F1 by kind of question, one column per run."""
    p, g = M.citation_keys(F.col("predicted_citations")), M.citation_keys(F.col("gold_citations"))
    rows = results(spark, sf_dir).select(F.coalesce(F.nullif(F.lower(F.trim("query_type")), F.lit("")), F.lit("unknown")).alias("kind"), "run_id", M.set_f1(p, g).alias("f1"))
    return rows.groupBy("kind", "run_id").agg(F.round(F.avg("f1"), 6).alias("citation_f1"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (met1_ranking, met6_citations, met9_kendall_tau, met10_text, met12_rouge, met15_reasoning, met19_groundedness, met20_abstention, met21_telemetry, met22_responses, agg12_strata, agg13_first_per_type, agg15_route_recall, agg16_freshest_runs, agg20_model_calls, snk5_comparison)
}

_HITS = "list_transform(list_slice(coalesce({p}, []), 1, {k}), lambda x: case when list_contains(coalesce({g}, []), x) then 1 else 0 end)"


def _h(p: str, g: str, k: int = K) -> str:
    return _HITS.format(p=p, g=g, k=k)


def _set_f1(p: str, g: str) -> str:
    return f"case when len({p}) = 0 and len({g}) = 0 then 1 when len(list_intersect({p}, {g})) = 0 then 0 else 2.0 * len(list_intersect({p}, {g})) / (len({p}) + len({g})) end"


_KEYS = "list_distinct(list_transform(coalesce({c}, []), lambda c: coalesce(c.doc_id, '') || '#' || coalesce(c.article_ref, '')))"
_PK, _GK = _KEYS.format(c="predicted_citations"), _KEYS.format(c="gold_citations")
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[\\s\\x{{a0}}\\x{{202f}}\\x{{2007}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{205f}}\\x{{3000}}\\x{{1c}}-\\x{{1f}}\\x{{b}}]+'), lambda x: x <> ''))"
_KIND = "coalesce(nullif(lower(trim(query_type)), ''), 'unknown')"

_GRAMS = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"

ORACLES = {
    "met9_kendall_tau": f"""with e as (select prediction_id, list_filter(list_transform(coalesce(pred_article_ids, []), lambda x: list_position(coalesce(gold_article_ids, []), x)), lambda y: y > 0) as a from {PREDICTIONS} p0),
      u as (select prediction_id, unnest(a) as v, generate_subscripts(a, 1) as i from e),
      s as (select x.prediction_id, sum(sign(y.v - x.v)) as s, count(*) as n, count(*) filter (x.v = y.v) as t from u x join u y on x.prediction_id = y.prediction_id and x.i < y.i group by 1)
      select prediction_id, round(coalesce(case when n = t then 0.0 else s / sqrt(n * (n - t)::double) end, 0.0), 6) as tau from e left join s using (prediction_id)""",
    "met12_rouge": f"with t as (select prediction_id, {words('answer_text')} as a, {words('gold_answer_text')} as b from {PREDICTIONS} p0) select prediction_id, round({rouge('a', 'b')}, 6) as rouge_l from t",
    "met15_reasoning": f"""with g as (select prediction_id, unnest(gold_reasoning_chain) as g, generate_subscripts(gold_reasoning_chain, 1) as i, reasoning_chain as p from {PREDICTIONS} p0),
      t as (select prediction_id, {words('p[i]')} as a, {words('g')} as b from g), s as (select prediction_id, avg({rouge('a', 'b')}) as s from t group by 1)
      select prediction_id, round(coalesce(s, 0), 6) as chain_score from {PREDICTIONS} p left join s using (prediction_id)""",
    "met19_groundedness": f"""with c as (select prediction_id, unnest(predicted_citations) as c, answer_text from {PREDICTIONS} p0), t as (select prediction_id, {words('lower(c.text)')} as x, {words('lower(answer_text)')} as y from c),
      s as (select prediction_id, avg(case when len(list_intersect({_GRAMS.format(w='x')}, {_GRAMS.format(w='y')})) > 0 then 1.0 else 0.0 end) as s from t group by 1)
      select prediction_id, round(coalesce(s, 0), 6) as grounded from {PREDICTIONS} p left join s using (prediction_id)""",
    "met1_ranking": f"""with h as (select prediction_id, {_h('pred_article_ids', 'gold_article_ids')} as h, {_h('pred_doc_ids', 'gold_doc_ids')} as hd, len(coalesce(gold_article_ids, [])) as g from {PREDICTIONS} p0),
      s as (select *, list_sum(list_transform(h, lambda x, i: x / log2(i + 1.0))) as dcg, list_sum(list_transform(list_reverse_sort(h), lambda x, i: x / log2(i + 1.0))) as ideal,
        list_sum(list_transform(h, lambda x, i: case when x = 1 then list_sum(list_slice(h, 1, i)) / (i * 1.0) else 0 end)) as ap from h)
      select prediction_id, round(coalesce(1.0 / nullif(list_position(h, 1), 0), 0), 6) as mrr, round(case when g > 0 then coalesce(list_sum(h), 0) / (g * 1.0) else 0 end, 6) as recall,
        round(coalesce(list_sum(h), 0) / {K}.0, 6) as precision_k, round(case when ideal > 0 then dcg / ideal else 0 end, 6) as ndcg, round(case when g > 0 then coalesce(ap, 0) / g else 0 end, 6) as map,
        round(coalesce(1.0 / nullif(list_position(hd, 1), 0), 0), 6) as mrr_doc from s""",
    "met6_citations": f"""with k as (select prediction_id, {_PK} as p, {_GK} as g, list_distinct(coalesce(pred_doc_ids, [])) as pd, list_distinct(coalesce(gold_doc_ids, [])) as gd from {PREDICTIONS} p0)
      select prediction_id, round(case when len(p) > 0 then len(list_intersect(p, g)) / (len(p) * 1.0) else 0 end, 6) as precision, round(case when len(g) > 0 then len(list_intersect(p, g)) / (len(g) * 1.0) else 0 end, 6) as recall,
        round({_set_f1('p', 'g')}, 6) as f1, round({_set_f1('pd', 'gd')}, 6) as doc_f1 from k""",
    "met10_text": f"""with t as (select prediction_id, answer_text as a, gold_answer_text as b, {_TOK.format(c='answer_text')} as p, {_TOK.format(c='gold_answer_text')} as g from {PREDICTIONS} p0)
      select prediction_id, case when regexp_replace(coalesce(a, ''), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') = regexp_replace(coalesce(b, ''), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g') then 1.0 else 0.0 end as exact, round({_set_f1('p', 'g')}, 6) as token_f1 from t""",
    "met20_abstention": f"""with c as (select run_id, coalesce(predicted_abstain, false) as p, coalesce(gold_abstain, false) as g from {PREDICTIONS} p0),
      n as (select run_id, count(*) as n, count(*) filter (p and g) as hit, count(*) filter (p) as said, count(*) filter (g) as due, count(*) filter (p = g) as same from c group by 1)
      select run_id, round(case when said > 0 then hit / said else 0 end, 6) as abstention_precision, round(case when due > 0 then hit / due else 0 end, 6) as abstention_recall,
        round(case when hit > 0 then 2.0 * hit / (said + due) else 0 end, 6) as abstention_f1, round(same / n, 6) as abstention_accuracy from n""",
    "met21_telemetry": f"""select run_id, count(*) as n, round(avg(coalesce(latency_s, 0)), 6) as latency_s, round(avg(coalesce(tokens_used, 0)), 6) as tokens_used, round(avg(coalesce(retry_count, 0)), 6) as retry_count,
      round(avg(coalesce(sub_call_count, 0)), 6) as sub_call_count from {PREDICTIONS} p0 group by 1""",
    "agg12_strata": f"""with r as (select coalesce(nullif(lower(trim(query_type)), ''), 'unknown') as query_type, coalesce(nullif(lower(trim(legal_category)), ''), 'unknown') as legal_category,
        coalesce(nullif(lower(trim(difficulty)), ''), 'unknown') as difficulty, coalesce(nullif(lower(trim(language)), ''), 'ar') as language, coalesce(nullif(lower(trim(split)), ''), 'test') as split,
        coalesce(has_temporal_note, false) as temporal, {_PK} as p, {_GK} as g, hcr, jir, latency_s from {PREDICTIONS} p0),
      m as (select *, {_set_f1('p', 'g')} as citation_f1 from r),
      u as (select 'overall' as dim, 'all' as value, * from m union all select 'query_type', query_type, * from m union all select 'legal_category', legal_category, * from m union all select 'difficulty', difficulty, * from m
        union all select 'language', language, * from m union all select 'split', split, * from m union all select 'temporal', 'true', * from m where temporal)
      select dim, value, count(*) as n, round(avg(citation_f1), 6) as citation_f1, round(avg(coalesce(hcr, 0)), 6) as hcr, round(avg(coalesce(jir, 0)), 6) as jir, round(avg(coalesce(latency_s, 0)), 6) as latency_s from u group by 1, 2""",
    "agg13_first_per_type": f"with r as (select prediction_id, {_KIND} as kind from {PREDICTIONS} p0) select * from r qualify row_number() over (partition by kind order by prediction_id) <= 5",
    "agg15_route_recall": f"""select count(*) as n, count(*) filter (len(list_intersect(list_slice(coalesce(pred_doc_ids, []), 1, 3), gold_doc_ids)) > 0) as hits,
      round(count(*) filter (len(list_intersect(list_slice(coalesce(pred_doc_ids, []), 1, 3), gold_doc_ids)) > 0) / count(*), 6) as recall from {PREDICTIONS} p0 where len(gold_doc_ids) > 0""",
    "agg16_freshest_runs": f"select question_id, prediction_id from {PREDICTIONS} p0 qualify row_number() over (partition by question_id order by run_at desc, prediction_id) = 1",
    "agg20_model_calls": f"with c as (select run_id, unnest(map_entries(calls_by_model)) as e from {PREDICTIONS} p0) select run_id, e.key as model, cast(sum(e.value) as bigint) as calls from c group by all",
    "snk5_comparison": f"with k as (select {_KIND} as kind, run_id, {_PK} as p, {_GK} as g from {PREDICTIONS} p0) select kind, run_id, round(avg({_set_f1('p', 'g')}), 6) as citation_f1, count(*) as n from k group by all",
    "met22_responses": f"""with k as (select prediction_id, coalesce(pred_article_ids, []) as pl, list_distinct(coalesce(pred_article_ids, [])) as p, list_distinct(coalesce(gold_article_ids, [])) as g from {PREDICTIONS} p0),
      n as (select *, len(list_intersect(p, g)) as n, list_position(list_transform(pl, lambda x: list_contains(g, x)), true) as hit_at from k)
      select prediction_id, round(case when len(g) = 0 then case when len(p) = 0 then 1 else 0 end when len(p) = 0 then 0 else n / len(p) end, 4) as precision, round(case when len(g) = 0 then 1 else n / len(g) end, 4) as recall,
        round(case when len(g) = 0 then case when len(p) = 0 then 1 else 0 end when n = 0 then 0 else 2.0 * n / (len(p) + len(g)) end, 4) as f1,
        case when len(g) = 0 then case when len(p) = 0 then 1.0 else 0.0 end when hit_at = 1 then 1.0 else 0.0 end as p1, round(case when len(g) = 0 then 1 when coalesce(hit_at, 0) > 0 then 1.0 / hit_at else 0 end, 6) as mrr,
        case when len(g) > 0 and exists (select 1 from (select unnest(p) as x) where not list_contains(g, x)) then 1 else 0 end as hallucinates from n""",
}
