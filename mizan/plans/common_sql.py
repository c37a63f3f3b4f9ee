"""Pieces of DuckDB SQL that several reference queries share."""

from __future__ import annotations

from mizan.functions import text as T

WS_SQL = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def norm_ar(x: str) -> str:
    """Normal form of Arabic text."""
    t = f"translate(nfc_normalize(coalesce({x}, '')), 'أإآٱى٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', 'ااااي01234567890123456789')"
    return f"trim({sub(sub(t, r'[\x{64b}-\x{670}\x{65f}\x{640}]'), f'{WS_SQL}+', ' ')})"


def tokens(x: str) -> str:
    """List of stemmed retrieval tokens."""
    t = norm_ar(x)
    edge, end = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"
    for _ in range(2):
        t = sub(t, rf"{edge}(\d{{2,4}})[-_](\d{{2,4}})[-_](\d{{2,4}}){end}", r"\1\2X\3X\4\5").replace("X", "")
        t = sub(t, rf"{edge}(\d{{2,4}})[-_](\d{{2,4}}){end}", r"\1\2X\3\4").replace("X", "")
    punct = r"[\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}،؛؟]"
    parts = f"list_filter(regexp_split_to_array({sub(t, punct, ' ')}, '{WS_SQL}+'), lambda y: y <> '')"
    stem = "case " + " ".join(f"when starts_with(y, '{p}') and length(y) - {len(p)} >= 3 then substr(y, {len(p) + 1})" for p in T.STEM_PREFIXES) + " else y end"
    return f"list_transform({parts}, lambda y: {stem})"


def words(x: str) -> str:
    """White-space tokens."""
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS_SQL}+'), lambda y: y <> '')"


def rouge(a: str, b: str) -> str:
    """F1 of the longest common subsequence of two token lists: one row of the table per token of `a`, as the
    running maximum of the row above and its diagonal."""
    matches = f"list_prepend(list_transform({b}, lambda t: 0), list_transform({a}, lambda x: list_transform({b}, lambda t: case when t = x then 1 else 0 end)))"
    row = f"list_transform(range(1, len({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(acc[i], coalesce(case when i > 1 then acc[i - 1] end, 0) + m[i]))))"
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else 2.0 * coalesce(list_max(list_reduce({matches}, lambda acc, m: {row})), 0) / (len({a}) + len({b})) end"


def in_order(x: str) -> str:
    """Distinct elements in first-seen order."""
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_BARE = "case when starts_with({0}, 'ال') and length({0}) > 4 then substr({0}, 3) else {0} end"


def long_words(x: str) -> str:
    split = r"[^\pL\pN_\x{600}-\x{6ff}]+"
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{split}'), lambda y: length(y) >= 3)"


def topic_words(x: str) -> str:
    """Words without their article that are no stop words; repeats stay."""
    bare = f"list_transform({long_words(x)}, lambda y: {_BARE.format('y')})"
    return f"list_filter({bare}, lambda y: not list_contains({_STOPS}, y) and not list_contains({_STOPS}, {norm_ar('y')}))"


def concept_words(x: str) -> str:
    return f"list_filter({long_words(x)}, lambda y: not list_contains({_STOPS}, y) and not list_contains({_STOPS}, {_BARE.format('y')}))"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n - 2}), lambda i: " + " || ' ' || ".join(f"{x}[i + {j}]" for j in range(n)) + ")"


def coverage_cte(texts: str, k: int, phrases: bool = False) -> str:
    """CTE cov(query_id, rank, key, score): the k texts(key, text) that hold most topic words (or concept
    phrases) of a question."""
    asked, wanted = topic_words("question"), f"list_slice({in_order('t')}, 1, 8)"
    if phrases:
        two, three = f"list_slice({in_order(grams('t', 2))}, 1, 4)", f"list_slice({in_order(grams('t', 3))}, 1, 3)"
        long = "list_filter(t, lambda y: length(y) >= 4)"
        asked, wanted = concept_words("question"), f"list_slice(list_concat({two}, {three}, {in_order(long)}), 1, 8)"
    return f"""qw as (select item_id as query_id, {asked} as t from bench_item),
tw as (select distinct query_id, {norm_ar('w.w')} as token from (select query_id, unnest({wanted}) as w from qw) w),
tx as (select key, {norm_ar('text')} as text from ({texts}) t0),
th as (select token, key from (select distinct token from tw where token <> '') d join tx on contains(tx.text, d.token)),
cs as (select query_id, key, count(*) as score from tw join th using (token) group by all),
cov as (select query_id, cast(row_number() over (partition by query_id order by score desc, key) as int) as rank, key, score from cs
  qualify row_number() over (partition by query_id order by score desc, key) <= {k})"""


def answered(top: str) -> str:
    """Pipeline answers from `top`(query_id, rank, doc_id, article_ref, text), for every held-out question."""
    return f"""w as (select query_id, count(*) as n, md5(string_agg(doc_id || ' — ' || article_ref || ': ' || substr(coalesce(text, ''), 1, 280), chr(10) || chr(10) order by rank)) as md from {top} group by 1)
select q.item_id as query_id, w.n is null as abstention, case when trim(coalesce(q.question, '')) = '' then 'empty_query' when w.n is null then 'no_hits' end as abstention_reason,
  coalesce(w.n, 0) as n_citations, coalesce(md, md5('')) as answer_md5 from bench_item q left join w on q.item_id = w.query_id"""


CHUNKS = "(select chunk_id, any_value(text) as text from chunk group by chunk_id)"
PREDICTIONS = "(select * from predictions qualify row_number() over (partition by prediction_id order by logged_at) = 1)"


def bm25_cte(k: int, questions: str = "select item_id as query_id, question as query from bench_item") -> str:
    """CTEs that end in bm(query_id, rank, chunk_id, score)."""
    return f"""q0 as ({questions}),
toks as (select chunk_id, {tokens("text")} as t from {CHUNKS}),
lens as (select chunk_id, len(t) as dl from toks),
post as (select chunk_id, u.term as term, count(*) as tf from toks, unnest(t) as u(term) group by all),
tot as (select count(*) as n, avg(dl) as avgdl from lens),
raw as (select term, ln((select n from tot) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post group by term),
idf as (select term, case when raw < 0 then (select avg(raw) from raw) * 0.25 else raw end as idf from raw),
qt as (select query_id, u.term as term, count(*) as qtf from (select query_id, {tokens("query")} as t from q0), unnest(t) as u(term) group by all),
sc as (select query_id, p.chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avgdl from tot)))), 6) as score
  from qt join idf using (term) join post p using (term) join lens l on p.chunk_id = l.chunk_id group by all),
top as (select query_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank, chunk_id, score from sc
  qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {k}),
few as (select query_id, count(t.chunk_id) as have from (select distinct query_id from qt) left join top t using (query_id) group by 1 having count(t.chunk_id) < {k}),
pad as (select query_id, have, chunk_id, row_number() over (partition by query_id order by chunk_id) as i from few, lens where (query_id, chunk_id) not in (select (query_id, chunk_id) from top)),
bm as (select * from top union all select query_id, cast(have + i as int), chunk_id, 0.0 from pad where have + i <= {k})"""


def sparse_cte(k: int) -> str:
    """CTE sp(query_id, rank, chunk_id, score), after bm25_cte: raw counts as weights."""
    return f"""spx as (select query_id, chunk_id, round(sum(qtf * tf), 6) as score from qt join post using (term) group by all),
sp as (select query_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank, chunk_id, score from spx
  qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {k})"""
