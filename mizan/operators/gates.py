"""Gates on citations and texts: existence, quoted spans, pattern signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.functions.text import clauses, normalize_arabic
from mizan.operators.registry import has_article

#: Span gate: shortest span and clause that can be judged, and the share of clauses that must be found.
MIN_SPAN, MIN_CLAUSE, CLAUSE_SHARE = 12, 12, 0.5


def cited(results: DataFrame, citations: str = "predicted_citations", key: str = "prediction_id") -> DataFrame:
    """One row per citation, numbered in order."""
    return results.select(key, F.posexplode(citations).alias("pos", "c")).select(key, "pos", "c.doc_id", "c.article_ref", "c.text", "c.supporting_span")


def existence_gate(results: DataFrame, article_keys: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Per result: valid and rejected citations, and the share rejected (0 without citations)."""
    judged = has_article(cited(results, key=key), article_keys)
    n = judged.groupBy(key).agg(F.count_if(F.col("found")).alias("valid"), F.count_if(~F.col("found")).alias("rejected"))
    every = results.select(key).join(n, key, "left").select(key, F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return every.withColumn("rejected_share", F.round(F.when(F.col("valid") + F.col("rejected") > 0, F.col("rejected") / (F.col("valid") + F.col("rejected"))).otherwise(0.0), 6))


def span_supported(text: Column, span: Column) -> Column:
    """pass / reject with the reason, as struct(passed, reason): no span passes; no article, or a span that is
    too short, is rejected; else the span, or half of its longer clauses, must stand in the text."""
    t, s = F.lower(normalize_arabic(text)), F.lower(normalize_arabic(span))
    parts = F.filter(clauses(s), lambda x: F.length(x) >= MIN_CLAUSE)
    share = F.size(F.filter(parts, lambda x: F.contains(t, x))) / F.greatest(F.size(parts), F.lit(1))
    reason = (
        F.when(F.length(s) == 0, "no_span").when(text.isNull(), "no_article").when(F.length(s) < MIN_SPAN, "too_short").when(F.contains(t, s), "exact").when((F.size(parts) > 0) & (share >= CLAUSE_SHARE), "clauses").otherwise("absent")
    )
    return F.struct(reason.isin("no_span", "exact", "clauses").alias("passed"), reason.alias("reason"))


def signals(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Distinct ids of the rules (pattern, id) that match, in rule order; one scan, no join."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(i)) for p, i in rules])))


def signal_counts(rows: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Texts per signal family: what stands before the colon of a signal id."""
    s = rows.select(F.explode(F.array_distinct(F.transform(signals(F.col(text), rules), lambda x: F.split_part(x, F.lit(":"), F.lit(1))))).alias("family"))
    return s.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Value of the first rule (pattern, value) that matches."""
    t, out = F.coalesce(text, F.lit("")), None
    for p, v in rules:
        out = F.when(t.rlike(p), v) if out is None else out.when(t.rlike(p), v)
    return F.lit(other) if out is None else out.otherwise(other)


def faithfulness(claim_rows: DataFrame, cited_rows: DataFrame, scorer: Column, threshold: float = 0.5, coverage: float = 0.55) -> DataFrame:
    """Share of claims(key, claim_no, claim) that their best citation(key, text) supports, and whether the
    coverage suffices. `scorer` is a column over claim and text; a claim without citations is unsupported."""
    best = claim_rows.join(cited_rows, "key", "left").groupBy("key", "claim_no").agg(F.max(F.coalesce(scorer, F.lit(0.0))).alias("best"))
    g = best.groupBy("key").agg(F.round(F.avg((F.col("best") >= threshold).cast("double")), 6).alias("covered"))
    return g.withColumn("passed", F.col("covered") >= coverage)


def should_supervise(citations: Column, at_least: int = 3, low: float | None = None, high: float | None = None) -> Column:
    """Enough citations, and the confidence of the first within the band where one is given."""
    enough = F.coalesce(F.size(citations), F.lit(0)) >= at_least
    if low is None and high is None:
        return enough
    first = F.coalesce(F.get(citations, 0)["confidence"], F.lit(0.0))
    return enough & first.between(0.0 if low is None else low, 1.0 if high is None else high)
