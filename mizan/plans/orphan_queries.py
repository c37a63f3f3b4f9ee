"""p3: orphan references of the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.operators import orphans
from mizan.session import table


def _run(spark: SparkSession, sf_dir: str):
    refs = orphans.citation_refs(table(spark, sf_dir, "predictions")).unionByName(orphans.map_refs(table(spark, sf_dir, "doc_entry")))
    return orphans.run(refs, table(spark, sf_dir, "article"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.found(_run(spark, sf_dir)[0])


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("src", "ref_state", "ref_month").agg(F.count(F.lit(1)).alias("n"))


def p3_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per source and state after each step, open ones apart."""
    return _run(spark, sf_dir)[1]


def canonical_sql(ref: str) -> str:
    """Canonical token of an article reference in DuckDB's SQL."""
    ws = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]"
    sub = lambda x, p, to="": f"regexp_replace({x}, '{p}', '{to}', 'g')"
    strip = lambda x: sub(x, f"^{ws}+|{ws}+$")
    s = sub(strip(f"coalesce({ref}, '')"), "(?i)^art_")
    s = f"translate(nfc_normalize({s}), 'أإآٱى٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'ااااي01234567890123456789')"
    s = strip(sub(sub(s, r"[\x{64b}-\x{670}\x{65f}\x{640}]"), f"{ws}+", " "))
    s = strip(sub(s, r"(?i)^(المادة|مادة|Art\.|article|art)"))
    s = strip(sub(s, rf"(?i)\({ws}*(معدلة|معدله|modified|amended){ws}*\){ws}*$"))
    ordinals = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in {
        "الاول": 1, "الاولي": 1, "اولي": 1, "الثانية": 2, "الثاني": 2, "الثالثة": 3, "الثالث": 3, "الرابعة": 4, "الرابع": 4, "الخامسة": 5, "الخامس": 5,
        "السادسة": 6, "السادس": 6, "السابعة": 7, "السابع": 7, "الثامنة": 8, "الثامن": 8, "التاسعة": 9, "التاسع": 9, "العاشرة": 10, "العاشر": 10,
    }.items()) + " end"
    b = sub(s, rf"{ws}*مكررة?{ws}*[(\s]*(\pN+){ws}*\)?", r"_bis_\1")
    b = sub(b, rf"{ws}*مكررة?([^\pL\pN_]|$)", r"_bis\1")
    b = sub(b, r"(?i)[\s_]*bis[\s_]*(\pN+)", r"_bis_\1")
    b = sub(b, r"(?i)[\s_]*bis([^\pL\pN_]|$)", r"_bis\1")
    b = f"lower({sub(sub(b, f'({ws}|_)+', '_'), '^_+|_+$')})"
    return f"coalesce({ordinals.format(s)}, {b})"


_FOUND_SQL = f"""with refs as (
  select 'predicted_citations' as src, cast(prediction_id as varchar) as owner_key, unnest(predicted_citations) as c, run_at as t from predictions
  union all
  select 'gold_citations', cast(prediction_id as varchar), unnest(gold_citations), run_at from predictions),
cited as (select distinct src, owner_key, c.doc_id as doc_id, c.article_ref as article_ref, t from refs where c.doc_id <> '' and c.article_ref <> ''),
forms as (select article_ref, 'art_' || {canonical_sql("article_ref")} as eid from (select distinct article_ref from cited)),
entries as (select distinct canonical_id, registered_at as t, unnest(map_entries(article_refs)) as e from doc_entry where canonical_id <> ''),
everything as (
  select c.src, c.owner_key, c.doc_id, c.article_ref, f.eid, c.t from cited c join forms f using (article_ref)
  union all select 'article_refs', canonical_id, canonical_id, e.key, coalesce(e.value, ''), t from entries),
judged as (
  select r.src, r.owner_key, r.doc_id, r.article_ref, r.t, count(a.doc_id) as n,
    count(*) filter (where a.doc_id is not null and (a.loaded_at is null or a.loaded_at <= r.t)) as there,
    count(*) filter (where a.doc_id is not null and (a.loaded_at is null or a.loaded_at <= r.t) and (a.deleted_at is null or a.deleted_at > r.t)) as alive
  from everything r left join article a on a.doc_id = r.doc_id and a.eid = r.eid group by all),
states as (select *, case when n = 0 then 'missing' when t is null then null when there = 0 then 'late' when alive = 0 then 'deleted' end as ref_state from judged)
select distinct src, owner_key, doc_id, article_ref, ref_state, strftime(t, '%Y-%m') as ref_month from states where ref_state is not null"""

QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p3_snapshots)}
ORACLES = {
    "p3_found": _FOUND_SQL,
    "p3_counts": f"select src, ref_state, ref_month, count(*) as n from ({_FOUND_SQL}) group by all",
}
