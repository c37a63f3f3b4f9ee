"""Versions in force at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def as_of(targets: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, tie: str, first_wins: bool = False) -> DataFrame:
    """Each target with `version`: the latest version of its key with since <= at, null where none was in
    force. Versions with equal time: the last by `tie` wins, or the first. Targets are told apart by all
    their columns; versions are joined by key, never by time alone.
    """
    t = targets.withColumn("_row", F.monotonically_increasing_id())
    v = versions.select(*keys, F.struct(*[c for c in versions.columns if c not in keys]).alias("version"))
    order = F.struct(F.col(f"version.{since}"), -F.col(f"version.{tie}") if first_wins else F.col(f"version.{tie}"))
    fit = t.select("_row", *keys, at).join(v, keys).filter(F.col(f"version.{since}") <= F.col(at))
    best = fit.groupBy("_row").agg(F.max_by("version", order).alias("version"))
    return t.join(best, "_row", "left").drop("_row")


def with_fallback(found: DataFrame, chained: DataFrame, keys: list[str], fallback: str) -> DataFrame:
    """Text and source of each target: its version's; the fallback column where the key has no versions at
    all; targets whose versions all begin later are dropped."""
    known = chained.select(*keys).distinct().withColumn("_chain", F.lit(True))
    j = found.join(known, keys, "left")
    return j.filter("version is not null or _chain is null").withColumn("source", F.when(F.col("version").isNotNull(), "version").otherwise("fallback")).withColumn("text", F.coalesce(F.col("version.text"), F.col(fallback))).drop("_chain")


def version_chain(versions: DataFrame, keys: list[str], since: str, tie: str) -> DataFrame:
    """Versions of each key in order of time, numbered from 1, each with `until`: when the next one begins, null
    for the last. Rows without a key or a time are no versions; a chain is sorted, never collected."""
    w = W.partitionBy(*keys).orderBy(since, tie)
    kept = versions.filter(" and ".join(f"`{c}` is not null" for c in [*keys, since]))
    return kept.withColumns({"version_no": F.row_number().over(w), "until": F.lead(since).over(w)})


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `base` whose key `new` lacks; a null key is replaced by none."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
