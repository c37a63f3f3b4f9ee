"""Per-question metrics over array columns, without a shuffle; sequence metrics in Arrow UDFs.

Arrays that are null count as empty. Where the common definition differs, the docstring says so and
`standard=True` gives the common one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mizan.functions.text import WS

_NONE = "array<string>"


def _a(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def _hits(pred: Column, gold: Column, k: int) -> Column:
    """array<int>: 1 where the item at that rank is gold."""
    g = _a(gold)
    return F.transform(F.slice(_a(pred), 1, k), lambda x: F.array_contains(g, x).cast("int"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def mrr_at_k(pred: Column, gold: Column, k: int) -> Column:
    at = F.array_position(_hits(pred, gold, k), 1)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def recall_at_k(pred: Column, gold: Column, k: int) -> Column:
    """List items count without removal of repeats; empty gold gives 0."""
    n = F.size(_a(gold))
    return F.when(n > 0, F.size(F.filter(_hits(pred, gold, k), lambda x: x == 1)) / n).otherwise(0.0)


def precision_at_k(pred: Column, gold: Column, k: int) -> Column:
    """Divides by k, however short the list; k = 0 gives 0."""
    if k == 0:
        return F.lit(0.0)
    return F.size(F.filter(_hits(pred, gold, k), lambda x: x == 1)) / F.lit(k)


def ndcg_at_k(pred: Column, gold: Column, k: int, standard: bool = False) -> Column:
    """The ideal is the retrieved gains in order; standard: min(k, size of gold) gains."""
    gains = _hits(pred, gold, k)
    dcg = lambda g: _sum(F.transform(g, lambda x, i: x / F.log2(i + F.lit(2.0))))
    best = F.array_repeat(F.lit(1), F.least(F.lit(k), F.size(_a(gold)))) if standard else F.sort_array(gains, asc=False)
    ideal = dcg(best)
    return F.when(ideal > 0, dcg(gains) / ideal).otherwise(0.0)


def map_at_k(pred: Column, gold: Column, k: int) -> Column:
    """Divides by the size of gold."""
    gains = _hits(pred, gold, k)
    upto = lambda i: _sum(F.transform(F.slice(gains, 1, i + 1), lambda x: x.cast("double")))
    total = _sum(F.transform(gains, lambda x, i: F.when(x == 1, upto(i) / (i + 1)).otherwise(0.0)))
    n = F.size(_a(gold))
    return F.when(n > 0, total / n).otherwise(0.0)


def citation_keys(citations: Column) -> Column:
    """Distinct doc/reference keys of a citation array."""
    return F.array_distinct(
        F.transform(F.coalesce(citations, F.array().cast("array<struct<doc_id:string,article_ref:string,text:string,supporting_span:string,confidence:double>>")), lambda c: F.concat_ws("#", F.coalesce(c["doc_id"], F.lit("")), F.coalesce(c["article_ref"], F.lit(""))))
    )


def set_precision(pred: Column, gold: Column) -> Column:
    p, g = F.array_distinct(_a(pred)), F.array_distinct(_a(gold))
    return F.when(F.size(p) > 0, F.size(F.array_intersect(p, g)) / F.size(p)).otherwise(0.0)


def set_recall(pred: Column, gold: Column) -> Column:
    return set_precision(gold, pred)


def set_f1(pred: Column, gold: Column) -> Column:
    """Both empty: 1, while precision and recall are 0 there."""
    p, r = set_precision(pred, gold), set_recall(pred, gold)
    return F.when((F.size(_a(pred)) == 0) & (F.size(_a(gold)) == 0), 1.0).when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _tau(pred: pd.Series, gold: pd.Series) -> pd.Series:
    def one(p, g):
        g = [] if g is None else list(g)
        at = {x: i for i, x in reversed(list(enumerate(g)))}
        place = np.array([at[x] for x in ([] if p is None else p) if x in at])
        n = len(place)
        if n < 2:
            return 0.0
        order = np.sign(place[None, :] - place[:, None])[np.triu_indices(n, 1)]
        pairs, ties = n * (n - 1) / 2, int((order == 0).sum())
        return 0.0 if ties == pairs else float(order.sum() / np.sqrt(pairs * (pairs - ties)))

    return pd.Series([one(p, g) for p, g in zip(pred, gold)], dtype="float64")


def kendall_tau(pred: Column, gold: Column) -> Column:
    """Tau-b of the places that common items take in both lists; fewer than two: 0.

    Repeats in the prediction enter with the place of their first gold occurrence, hence ties.
    """
    return _tau(pred, gold)


def exact_match(a: Column, b: Column) -> Column:
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{WS}+|{WS}+$", "")
    return (strip(a) == strip(b)).cast("double")


def tokens(c: Column, lower: bool = True) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.filter(F.split(F.lower(t) if lower else t, rf"{WS}+"), lambda x: x != "")


def token_f1(a: Column, b: Column) -> Column:
    """On sets of lower-case tokens; both empty give 1, one empty 0."""
    return set_f1(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def lcs_length(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence: one row of the table as the bits of an integer."""
    at: dict[str, int] = {}
    for i, t in enumerate(y):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(y)) - 1
    row = full
    for t in x:
        m = at.get(t, 0) & row
        row = (row + m | row - m) & full
    return len(y) - row.bit_count()


def _rouge(p: str | None, g: str | None) -> float:
    a, b = (p or "").split(), (g or "").split()
    n = lcs_length(a, b) if a and b else 0
    return 2.0 * n / (len(a) + len(b)) if n else 0.0


@F.pandas_udf(DoubleType())
def _rouge_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([_rouge(p, g) for p, g in zip(pred, gold)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chain_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    def one(p, g):
        p, g = [] if p is None else list(p), [] if g is None else list(g)
        return sum(_rouge(p[i] if i < len(p) else "", x) for i, x in enumerate(g)) / len(g) if g else 0.0

    return pd.Series([one(p, g) for p, g in zip(pred, gold)], dtype="float64")


def rouge_l(pred: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence over white-space tokens, case kept; an empty side gives 0."""
    return _rouge_udf(pred, gold)


def reasoning_chain_score(pred: Column, gold: Column) -> Column:
    """Mean ROUGE-L per gold step; a missing predicted step counts as empty; no gold gives 0."""
    return _chain_udf(pred, gold)


@F.pandas_udf(DoubleType())
def _grounded_udf(texts: pd.Series, answer: pd.Series) -> pd.Series:
    def grams(t: str | None) -> set:
        w = (t or "").lower().split()
        return set(zip(w, w[1:]))

    def one(ts, a):
        ts = [] if ts is None else list(ts)
        own = grams(a)
        return sum(not own.isdisjoint(grams(t)) for t in ts) / len(ts) if ts else 0.0

    return pd.Series([one(t, a) for t, a in zip(texts, answer)], dtype="float64")


def groundedness(citations: Column, answer: Column) -> Column:
    """Share of cited texts that share a lower-case token bigram with the answer; none cited: 0."""
    return _grounded_udf(F.transform(citations, lambda c: c["text"]), answer)


def rejected_share(rejected: Column, valid: Column) -> Column:
    """Share of citations that a gate rejects; no citation gives 0 (pipeline form of HCR)."""
    return F.when(rejected + valid > 0, rejected / (rejected + valid)).otherwise(0.0)


# --- the form that scores stored responses of other models: references only, documents ignored ------


def response_f1(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1), rounded to 4; empty gold: P = F1 = 1 if nothing is predicted, R = 1."""
    p, g = F.array_distinct(_a(pred)), F.array_distinct(_a(gold))
    n = F.size(F.array_intersect(p, g))
    none = (F.size(p) == 0).cast("double")
    pr = F.when(F.size(g) == 0, none).when(F.size(p) == 0, 0.0).otherwise(n / F.size(p))
    rc = F.when(F.size(g) == 0, 1.0).otherwise(n / F.size(g))
    f1 = F.when(F.size(g) == 0, none).when(n == 0, 0.0).otherwise(2 * pr * rc / (pr + rc))
    return F.struct(F.round(pr, 4).alias("precision"), F.round(rc, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def response_first(pred: Column, gold: Column) -> Column:
    """struct(p1, mrr); without gold P@1 is 1 if nothing is predicted and MRR 1."""
    p, g = _a(pred), _a(gold)
    at = F.array_position(F.transform(p, lambda x: F.array_contains(g, x).cast("int")), 1)
    p1 = F.when(F.size(g) == 0, (F.size(p) == 0).cast("double")).otherwise((at == 1).cast("double"))
    return F.struct(p1.alias("p1"), F.when(F.size(g) == 0, 1.0).when(at > 0, 1.0 / at).otherwise(0.0).alias("mrr"))


def response_hallucinates(pred: Column, gold: Column) -> Column:
    """Whether any predicted reference is not gold; only where gold is not empty."""
    return (F.size(_a(gold)) > 0) & (F.size(F.array_except(_a(pred), _a(gold))) > 0)
