"""Roll-ups of per-question metrics over strata, samples and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Stratum columns and what a missing value counts as.
DIMENSIONS = {"query_type": "unknown", "legal_category": "unknown", "difficulty": "unknown", "language": "ar", "split": "test"}


def aggregate(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of metric columns, a missing value counting as 0, with n."""
    g = rows.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), 6).alias(m) for m in metrics])


def abstention(predicted: Column, gold: Column) -> list[Column]:
    """Precision, recall, F1 and accuracy of abstaining; empty denominators give 0."""
    p, g = F.coalesce(predicted, F.lit(False)), F.coalesce(gold, F.lit(False))
    hit, said, due = F.count_if(p & g), F.count_if(p), F.count_if(g)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, rc = ratio(hit, said), ratio(hit, due)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return [F.round(c, 6).alias(f"abstention_{n}") for n, c in (("precision", pr), ("recall", rc), ("f1", f1), ("accuracy", ratio(F.count_if(p == g), F.count(F.lit(1)))))]


def stratify(rows: DataFrame, metrics: list[str], dimensions: dict[str, str] | None = None, temporal: str = "has_temporal_note") -> DataFrame:
    """Long table (dim, value, n, metrics...): overall, every dimension, and the temporal subset.

    One pass of GROUPING SETS, each row counted once per dimension.
    """
    dims = dimensions or DIMENSIONS
    v = rows.select(*[F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit(other)).alias(d) for d, other in dims.items()], F.when(F.coalesce(F.col(temporal), F.lit(False)), "true").otherwise("false").alias("temporal"), *metrics)
    keys = [*dims, "temporal"]
    sets = ", ".join(f"({k})" for k in keys) + ", ()"
    means = ", ".join(f"round(avg(coalesce(cast({m} as double), 0D)), 6) as {m}" for m in metrics)
    picked = "case " + " ".join(f"when grouping({k}) = 0 then '{k}'" for k in keys) + " else 'overall' end"
    value = "case " + " ".join(f"when grouping({k}) = 0 then {k}" for k in keys) + " else 'all' end"
    out = rows.sparkSession.sql(f"select {picked} as dim, {value} as value, count(*) as n, {means} from {{v}} group by {', '.join(keys)} grouping sets ({sets})", v=v)
    return out.filter("dim <> 'temporal' or value = 'true'")


def first_per_stratum(rows: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of every stratum."""
    w = W.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def route_recall(rows: DataFrame, pred: str, gold: str, n: int) -> DataFrame:
    """Share of rows with gold whose first n documents hold one; rows without gold are left out."""
    kept = rows.filter(F.size(F.coalesce(gold, F.array().cast("array<string>"))) > 0)
    hit = F.arrays_overlap(F.slice(F.coalesce(pred, F.array().cast("array<string>")), 1, n), F.col(gold))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("recall"))


def freshest(runs: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """The newest row per key."""
    w = W.partitionBy(key).orderBy(F.desc(at), *order)
    return runs.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
