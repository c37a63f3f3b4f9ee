"""STR, DAT, FLT: text, date and filter operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import dates as D
from mizan.functions import text as T
from mizan.plans.common_sql import WS_SQL, concept_words, in_order, norm_ar, sub, tokens, topic_words
from mizan.plans.orphan_queries import canonical_sql
from mizan.session import table


def str1_normalize_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article").select("ordinal", T.normalize_arabic(F.col("text_ar")).alias("norm"))


def str2_normalize_french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_french(F.col("text")).alias("norm"))


def str3_article_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article").select("ordinal", T.canonical_article_ref(F.col("article_ref")).alias("token"), T.ref_to_eid(F.col("article_ref")).alias("eid"))


def str5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("detected"))


def str6_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize_query(F.col("query"))
    return table(spark, sf_dir, "predictions").select(F.col("query")).distinct().select(F.md5("query").alias("query_md5"), n["norm"].alias("norm"), n["lang"].alias("detected"))


def str7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "chunk").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return one.select("chunk_id", F.array_join(T.bm25_tokens(F.col("text")), " ").alias("tokens"))


def str13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.content_token_count(F.col("text")).alias("n_tokens"), F.size(T.clauses(F.col("text"))).alias("n_clauses"), F.size(T.claims(F.col("text"))).alias("n_claims"))


def str9_graph_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic words of every held-out question, and its phrases."""
    q = table(spark, sf_dir, "bench_item")
    return q.select("item_id", F.array_join(T.graph_query_tokens(F.col("question")), " ").alias("topic_words"), F.size(T.concept_phrases(F.col("question"))).alias("n_phrases"))


def str16_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "article").select("ordinal", F.md5(T.support_span(F.col("text_ar"))).alias("span_md5"))


def str21_cited_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.cited_articles(F.col("text"))).alias("article"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cited"))


def agg7_law_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law numbers that texts and titles name, with the registered acts of that number."""
    texts = table(spark, sf_dir, "documents").select(F.lit("text").alias("place"), F.col("doc_id").cast("string").alias("owner"), "text")
    titles = table(spark, sf_dir, "article").select(F.lit("title").alias("place"), F.col("doc_id").alias("owner"), F.col("doc_title").alias("text")).distinct()
    named = texts.unionByName(titles).select("place", "owner", F.explode(T.law_ids(F.col("text"))).alias("law"))
    acts = table(spark, sf_dir, "doc_entry").select(F.substring_index("canonical_id", "_", 1).alias("law"), "canonical_id").distinct()
    return named.join(acts, "law").select("place", "owner", "law", "canonical_id").distinct()


def dat1_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", D.normalize_date(F.col("pub_date")).alias("pub_day"), D.target_date(D.dates_in(F.coalesce("text", F.lit("")))).alias("latest"))


def flt1_article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "article").filter(T.strip_ws(F.coalesce("text_ar", F.lit(""))) != "")
    return a.select("ordinal", F.concat_ws("#", "doc_id", "eid").alias("chunk_id"), T.canonical_article_ref(F.col("article_ref")).alias("ref"), F.lit(-1).alias("para_idx"))


def flt2_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that are not blank, under their original number; articles without any come whole."""
    a = table(spark, sf_dir, "article").select("ordinal", "doc_id", "eid", "text_ar", F.coalesce("paragraphs", F.array().cast("array<string>")).alias("p"))
    kept = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("t"))), lambda s: T.strip_ws(F.coalesce(s["t"], F.lit(""))) != "")
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.col("text_ar").alias("t")))
    rows = a.select("ordinal", "doc_id", "eid", F.explode(F.when(F.size(kept) > 0, kept).otherwise(whole)).alias("c"))
    return rows.select("ordinal", F.concat(F.concat_ws("#", "doc_id", "eid"), F.when(F.col("c.i") >= 0, F.concat(F.lit("#p"), F.col("c.i"))).otherwise("")).alias("chunk_id"), F.col("c.i").alias("para_idx"), F.length("c.t").alias("n_chars"))


def flt3_frbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the FRBR path: kind, date, number."""
    p = F.split("frbr_uri", "/")
    return table(spark, sf_dir, "article").select("ordinal", F.get(p, 3).alias("kind"), F.get(p, 5).alias("frbr_date"), F.get(p, 6).alias("number"))


_COUNT_CHARS = "length(regexp_replace(coalesce(text, ''), '[^\\x{600}-\\x{6ff}]', '', 'g'))"
_LANG = f"case when length(coalesce(text, '')) = 0 or {_COUNT_CHARS} / greatest(length(coalesce(text, '')), 1) > 0.15 then 'ar' else 'fr' end"
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]"


def _norm_fr(x: str) -> str:
    return f"trim({sub(f'lower({sub(f"strip_accents(coalesce({x}, {chr(39)}{chr(39)}))", r"[^\x00-\x7F]")})', f'{_WS}+', ' ')})"


def _re2(pattern: str) -> str:
    """A pattern for Unicode text in the form that the SQL engine's expressions take."""
    return pattern.replace("(?U)", "").replace(r"\s", WS_SQL).replace(r"\d", r"\p{Nd}").replace(r"\b", "")


def _without_laws(x: str) -> str:
    """Law numbers go; the bare form, which must stand alone, is met in text with doubled separators."""
    t = f"coalesce({x}, '')"
    for p in T.LAW_NUMBER_FORMS[:-1]:
        t = sub(t, _re2(p))
    once = sub(sub(t, r"([^\pL\pN\p{M}_])", r"\1\1"), r"(^|[^\pL\pN\p{M}_])\p{Nd}{2}--\p{Nd}{2,4}([^\pL\pN\p{M}_]|$)", r"\1\2")
    return once


def _cited(x: str) -> str:
    """Doubled separators are halved by the white space and the dots that the forms allow."""
    single = sub(x, r"([^\pL\pN\p{M}_])([^\pL\pN\p{M}_])", r"\1")
    return "list_concat(" + ", ".join(f"regexp_extract_all({single}, '{_re2(p)}', 1)" for p in T.ARTICLE_CITATION_FORMS) + ")"


QUERIES = {
    f.__name__: f
    for f in (str1_normalize_arabic, str2_normalize_french, str3_article_ref, str5_language, str6_normalize_query, str7_tokens, str9_graph_tokens, str13_token_counts, str16_spans, str21_cited_articles, agg7_law_ids, dat1_dates, flt1_article_chunks, flt2_paragraph_chunks, flt3_frbr)
}

ORACLES = {
    "str1_normalize_arabic": f"select ordinal, {norm_ar('text_ar')} as norm from article",
    "str2_normalize_french": f"select doc_id, {_norm_fr('text')} as norm from documents",
    "str3_article_ref": f"with t as (select ordinal, {canonical_sql('article_ref')} as token from article) select ordinal, token, case when token = '' then '' else 'art_' || token end as eid from t",
    "str5_language": f"select doc_id, {_LANG} as detected from documents",
    "str6_normalize_query": f"""with q as (select distinct query as text from predictions)
      select md5(text) as query_md5, case when {_LANG} = 'ar' then {norm_ar('text')} else {_norm_fr('text')} end as norm, {_LANG} as detected from q""",
    "str7_tokens": f"select chunk_id, array_to_string({tokens('t')}, ' ') as tokens from (select chunk_id, min(text) as t from chunk group by 1)",
    "str13_token_counts": f"""select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: length(x) >= 2)) as n_tokens,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[،؛؟.,;:!?\\n]+'), lambda x: trim(x) <> '')) as n_clauses,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?؟。\\n]+\\s*'), lambda x: length(trim(x)) >= 15)) as n_claims from documents""",
    "str16_spans": "select ordinal, md5(substr(coalesce(text_ar, ''), 1, 280)) as span_md5 from article",
    "agg7_law_ids": r"""with t as (select 'text' as place, cast(doc_id as varchar) as owner, text from documents union all select distinct 'title', doc_id, doc_title from article),
      runs as (select place, owner, unnest(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\d-]+'), lambda x: regexp_full_match(x, '\d{2}-\d{2,3}')))) as law from t)
      select distinct place, owner, law, canonical_id from runs join doc_entry on split_part(canonical_id, '_', 1) = law""",
    "str9_graph_tokens": f"""with t as (select item_id, {topic_words('question')} as t, {concept_words('question')} as c from bench_item),
      g as (select *, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) as two, list_transform(range(1, len(c) - 1), lambda i: c[i] || ' ' || c[i + 1] || ' ' || c[i + 2]) as three from t)
      select item_id, array_to_string(list_slice({in_order('t')}, 1, 8), ' ') as topic_words,
        cast(least(8, least(4, len(list_distinct(two))) + least(3, len(list_distinct(three))) + len(list_distinct(list_filter(c, lambda y: length(y) >= 4)))) as int) as n_phrases from g""",
    "str21_cited_articles": f"""with c as (select doc_id, {_without_laws('text')} as t from documents),
      f as (select doc_id, unnest(list_distinct(list_transform({_cited('t')}, lambda x: trim(regexp_replace(x, '{WS_SQL}+', ' ', 'g'))))) as article from c)
      select doc_id, count(*) as n_cited from f group by 1""",
    "dat1_dates": rf"""with d as (select doc_id, trim(pub_date) as p, regexp_replace(coalesce(text, ''), '(\D)', '\1\1', 'g') as t from documents),
      e as (select doc_id, p, list_concat(regexp_extract_all(t, '(?:^|\D)(\d{{4}}--\d{{2}}--\d{{2}})(?:\D|$)', 1), list_transform(regexp_extract_all(t, '(?:^|\D)(\d{{1,2}}//\d{{1,2}}//\d{{4}})(?:\D|$)', 1),
          lambda x: split_part(x, '//', 3) || '-' || lpad(split_part(x, '//', 2), 2, '0') || '-' || lpad(split_part(x, '//', 1), 2, '0'))) as found,
        regexp_replace(regexp_replace(t, '(^|\D)\d{{4}}--\d{{2}}--\d{{2}}(\D|$)', '\1 \2', 'g'), '(^|\D)\d{{1,2}}//\d{{1,2}}//\d{{4}}(\D|$)', '\1 \2', 'g') as rest from d),
      y as (select doc_id, p, list_concat(list_transform(found, lambda x: replace(x, '--', '-')), list_transform(regexp_extract_all(rest, '(?:^|\D)((?:1[89]|2[01])\d{{2}})(?:\D|$)', 1), lambda x: x || '-12-31')) as found from e)
      select doc_id, coalesce(strftime(try_strptime(p, ['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%Y/%m/%d', '%d %B %Y', '%d %b %Y']), '%Y-%m-%d'), case when regexp_full_match(p, '\d{{4}}') then p || '-01-01' end,
        strftime(try_strptime('1 ' || p, ['%d %B %Y', '%d %b %Y']), '%Y-%m-%d')) as pub_day, coalesce(list_max(found), '9999-12-31') as latest from y""",
    "flt1_article_chunks": f"select ordinal, concat_ws('#', doc_id, eid) as chunk_id, {canonical_sql('article_ref')} as ref, -1 as para_idx from article where {sub(chr(34) + 'text_ar' + chr(34), _WS)} <> ''",
    "flt2_paragraph_chunks": f"""with k as (select ordinal, doc_id, eid, text_ar, list_filter(list_zip(range(len(coalesce(paragraphs, []))), coalesce(paragraphs, [])), lambda z: {sub("coalesce(z[2], '')", _WS)} <> '') as p from article),
      r as (select ordinal, doc_id, eid, unnest(case when len(p) > 0 then p else [(-1, text_ar)] end) as z from k)
      select ordinal, concat_ws('#', doc_id, eid) || case when z[1] >= 0 then '#p' || z[1] else '' end as chunk_id, cast(z[1] as int) as para_idx, length(z[2]) as n_chars from r""",
    "flt3_frbr": "select ordinal, split_part(frbr_uri, '/', 4) as kind, split_part(frbr_uri, '/', 6) as frbr_date, split_part(frbr_uri, '/', 7) as number from article",
}
