"""References to records that do not exist, as keyed state that advances with the feed.

State holds the deliveries of every parent and all references so far, with their states. A step takes
what arrived since the last one: new references probe the parents by key, arriving parents resolve the
orphans that wait for them (`missing` becomes `late`), deletions open them again, sound ones too. However
the feed is cut into steps, the state after the last is the same. Parents are reduced to one
row per key before any join, so a key that is delivered or cited very often costs one row on the
parent side; on the reference side AQE splits it.

States, as of the reference's own time: `missing` no delivery of the key is known; `late` all
arrived after it; `deleted` some had arrived, all of those were deleted by then. Otherwise the
reference is sound: its state is null.

Defined results: a reference with null or empty doc_id or article_ref is none (map entries need a
doc_id only); repeated rows count once; a null loaded_at counts as there from the start; a reference
without a time is only ever `missing` or sound; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.functions.text import ref_to_eid
from mizan.session import materialise

KEY = ["doc_id", "eid"]
REF = ["src", "owner_key", "doc_id", "article_ref", "eid", "ref_time"]
DELIVERY = ["doc_id", "eid", "loaded_at", "deleted_at"]
#: Steps that a batch run over whole tables takes; the result does not depend on it.
STEPS = 3


def citation_refs(predictions: DataFrame) -> DataFrame:
    """Distinct references of both citation lists; the target's eid comes from the written form."""
    one = lambda src: F.transform(
        F.coalesce(F.col(src), F.array().cast(predictions.schema[src].dataType)),
        lambda x: F.struct(F.lit(src).alias("src"), x["doc_id"].alias("doc_id"), x["article_ref"].alias("article_ref")),
    )
    rows = predictions.select(
        F.col("prediction_id").cast("string").alias("owner_key"), F.col("run_at").alias("ref_time"), F.explode(F.concat(one("predicted_citations"), one("gold_citations"))).alias("c")
    )
    written = rows.select("c.src", "owner_key", "c.doc_id", "c.article_ref", "ref_time").filter("doc_id <> '' and article_ref <> ''").distinct()
    # each written form is resolved once
    forms = written.select("article_ref").distinct().select("article_ref", F.coalesce(F.nullif(ref_to_eid(F.col("article_ref")), F.lit("")), F.lit("art_")).alias("eid"))
    return written.join(forms, "article_ref").select(*REF)


def map_refs(entries: DataFrame) -> DataFrame:
    """Distinct references of the article_refs maps."""
    rows = entries.filter("canonical_id <> ''").select(F.col("canonical_id").alias("doc_id"), F.col("registered_at").alias("ref_time"), F.explode("article_refs").alias("article_ref", "eid"))
    return rows.select(F.lit("article_refs").alias("src"), F.col("doc_id").alias("owner_key"), "doc_id", "article_ref", F.coalesce("eid", F.lit("")).alias("eid"), "ref_time").distinct()


def deliveries(articles: DataFrame) -> DataFrame:
    """One row per key and arrival; of several rows the one that lives longest counts."""
    start = F.coalesce("loaded_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("loaded_at")
    rows = articles.filter("doc_id is not null and eid is not null").select("doc_id", "eid", start, "deleted_at")
    for_ever = F.max(F.col("deleted_at").isNull())
    return rows.groupBy("doc_id", "eid", "loaded_at").agg(F.when(~for_ever, F.max("deleted_at")).alias("deleted_at"))


def probe(refs: DataFrame, known: DataFrame) -> DataFrame:
    """`refs` with ref_state: missing, late, deleted or null (sound)."""
    index = known.groupBy(*KEY).agg(F.min("loaded_at").alias("_first"), F.min(F.when(F.col("deleted_at").isNull(), F.col("loaded_at"))).alias("_open"))
    closed = known.filter("deleted_at is not null").select(*KEY, F.col("loaded_at").alias("_from"), F.col("deleted_at").alias("_to"))
    state = (
        F.when(F.col("_first").isNull(), "missing")
        .when(F.col("ref_time") < F.col("_first"), "late")
        .when(F.col("ref_time").isNull() | (F.col("ref_time") >= F.col("_open")), F.lit(None))
        .otherwise("deleted")
    )
    seen = refs.join(index, KEY, "left").withColumn("ref_state", state).drop("_first", "_open")
    # those that look deleted may still fall into a closed span that held at their time
    doubtful = seen.filter("ref_state = 'deleted'")
    held = F.lit(True)
    for c in [*(doubtful[k] == closed[k] for k in KEY), closed["_from"] <= doubtful["ref_time"], closed["_to"] > doubtful["ref_time"]]:
        held = held & c
    saved = doubtful.join(closed, held, "left_semi").select(*REF, F.lit(None).cast("string").alias("ref_state"))
    gone = doubtful.join(closed, held, "left_anti").select(*REF, "ref_state")
    return seen.filter("ref_state is null or ref_state <> 'deleted'").select(*REF, "ref_state").unionByName(saved).unionByName(gone)


@dataclass
class OrphanState:
    """known: deliveries so far; refs: all references so far, REF + ref_state (null: sound), is_open."""

    known: DataFrame
    refs: DataFrame

    @property
    def orphans(self) -> DataFrame:
        return self.refs.filter("ref_state is not null")

    @staticmethod
    def empty(like_refs: DataFrame, like_deliveries: DataFrame) -> OrphanState:
        none = F.lit(False)
        refs = like_refs.filter(none).select(*REF, F.lit("").alias("ref_state"), none.alias("is_open"))
        return OrphanState(like_deliveries.filter(none), refs)


def advance(state: OrphanState, new_refs: DataFrame, arrived: DataFrame) -> OrphanState:
    """The state after a step. `arrived` holds new deliveries, and known ones again once deleted; a
    deletion holds whichever of the two comes first.

    New references are probed against all that is known, and with them every reference, sound or
    not, whose key arrived: news that comes late changes what was judged before. The others stay.
    """
    known = state.known.unionByName(arrived).groupBy("doc_id", "eid", "loaded_at").agg(F.max("deleted_at").alias("deleted_at"))
    touched = arrived.select(*KEY).distinct()
    again = state.refs.select(*REF).join(touched, KEY, "left_semi")
    untouched = state.refs.join(touched, KEY, "left_anti")
    judged = probe(new_refs.select(*REF).unionByName(again.select(*REF)), known)
    alive = known.groupBy(*KEY).agg(F.max(F.col("deleted_at").isNull()).alias("_alive"))
    opened = F.col("ref_state").isNotNull() & ~F.coalesce("_alive", F.lit(False))
    judged = judged.join(alive, KEY, "left").select(*REF, "ref_state", opened.alias("is_open"))
    return OrphanState(known, judged.unionByName(untouched.select(*REF, "ref_state", "is_open")))


def run(refs: DataFrame, articles: DataFrame, steps: int = STEPS) -> tuple[OrphanState, DataFrame | None]:
    """Feeds whole tables through `advance` in time order; (last state, snapshot counts per step).

    The feed is cut at equal distances between its first and last time; deliveries come once when
    they load and once more when they are deleted.
    """
    refs, all_known = materialise(refs), materialise(deliveries(articles))
    bounds = refs.select(F.col("ref_time").alias("t")).union(all_known.select("loaded_at")).union(all_known.select("deleted_at")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if bounds["a"] is None or bounds["a"] == bounds["b"]:
        edges = []
    else:
        edges = [bounds["a"] + (bounds["b"] - bounds["a"]) * k / steps for k in range(1, steps)]
    state, counts = OrphanState.empty(refs, all_known), None
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):

        def inside(c: str):
            since = F.lit(True) if lo is None else F.col(c) > F.lit(lo)  # noqa: B023
            return since if hi is None else since & (F.col(c) <= F.lit(hi))  # noqa: B023

        known_then = F.lit(True) if hi is None else F.col("deleted_at") <= F.lit(hi)
        came = all_known.filter(inside("loaded_at") | F.coalesce(inside("deleted_at") & F.col("deleted_at").isNotNull(), F.lit(False)))
        arrived = came.select("doc_id", "eid", "loaded_at", F.when(known_then, F.col("deleted_at")).alias("deleted_at"))
        new_refs = refs.filter(inside("ref_time") | (F.col("ref_time").isNull() if lo is None else F.lit(False)))
        state = advance(state, new_refs, arrived)
        state = OrphanState(materialise(state.known), materialise(state.refs))
        snap = state.orphans.groupBy("src", "ref_state", "is_open").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(k + 1))
        counts = snap if counts is None else counts.unionByName(snap)
    return state, counts


def found(state: OrphanState) -> DataFrame:
    """Each distinct orphan reference: src, owner_key, doc_id, article_ref, ref_state, ref_month."""
    return state.orphans.select("src", "owner_key", "doc_id", "article_ref", "ref_state", F.date_format("ref_time", "yyyy-MM").alias("ref_month")).distinct()
