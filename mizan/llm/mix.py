"""Samples that meet target shares of categories.

Counts per combination of categories come first (one small table); every later decision is taken on
them. A request's listed cells get whole-number quotas; each quota is spread over the combinations
inside the cell in proportion to what is there, which gives a fractional two-way table (cells by the
categories that the cell leaves open). Max-flow rounds that table so that every entry, every cell
total and every column total is one of its two neighbouring integers, cell totals exactly. The rows
are then those with the smallest random keys of each entry, found through a histogram of the keys,
so that no task ever sorts a whole cell.

Defined results: a result counts once per id; category values compare trimmed and in lower case,
null and empty as `unknown`; `*` matches everything. A result in several cells of one request is
drawn for one of them: the cell with the fewest `*`, then the first by name, unless a max-flow between
overlapping cells must move it so that more targets are met. A cell that holds too few gives all it
has and is reported; its lack is not made up elsewhere. Empty tables give reports with nothing
available and an empty sample.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction
from itertools import product
from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FIELDS = ("query_type", "difficulty", "language")
#: Bits of the random key that name its histogram bucket.
BUCKET_BITS = 16


def category(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(F.coalesce(t, F.lit("")) == "", "unknown").otherwise(t)


def counted(predictions: DataFrame, id_col: str = "prediction_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per id with its categories; of rows that disagree, the smallest values count."""
    cats = predictions.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.struct(*[category(F.col(f)).alias(f) for f in fields]).alias("c"))
    return cats.groupBy("_id").agg(F.min("c").alias("c")).select("_id", *[F.col(f"c.{f}").alias(f) for f in fields])


def controlled_rounding(quota: list[int], have: list[dict[int, int]]) -> list[dict[int, int]]:
    """Integer tables with the rows' totals `quota`, each entry and each column total next to the
    proportional value quota[i] * have[i][j] / sum(have[i]).

    Columns first fill up to the floors of their totals, then to the ceilings; a path that augments
    never takes back from the sink, so both margins hold in the end.
    """
    exact = [{j: Fraction(q * a, sum(row.values())) for j, a in row.items()} if q and row else dict.fromkeys(row, Fraction(0)) for q, row in zip(quota, have)]
    x = [{j: floor(v) for j, v in row.items()} for row in exact]
    columns = {j for row in exact for j in row}
    total = {j: sum((row.get(j, Fraction(0)) for row in exact), Fraction(0)) for j in columns}
    used = {j: sum(row.get(j, 0) for row in x) for j in columns}
    open_ = [{j for j, v in row.items() if v != floor(v)} for row in exact]
    up: list[set[int]] = [set() for _ in quota]  # entries rounded up so far
    left = [q - sum(row.values()) for q, row in zip(quota, x)]
    holders: dict[int, set[int]] = {j: set() for j in columns}
    for bound in (floor, ceil):
        room = {j: bound(total[j]) - used[j] for j in columns}
        for i in range(len(quota)):
            while left[i] > 0:
                # breadth-first path row -> column -> (row that holds it) -> other column ...
                came: dict[tuple[str, int], tuple[str, int] | None] = {("r", i): None}
                todo, end = deque([("r", i)]), None
                while todo and end is None:
                    kind, k = at = todo.popleft()
                    if kind == "r":
                        step = [("c", j) for j in sorted(open_[k] - up[k])]
                    elif room[k] > 0:
                        end = at
                        break
                    else:
                        step = [("r", r) for r in sorted(holders[k])]
                    for n in step:
                        if n not in came:
                            came[n] = at
                            todo.append(n)
                if end is None:
                    break
                room[end[1]] -= 1
                used[end[1]] += 1
                left[i] -= 1
                at = end
                while came[at] is not None:
                    before = came[at]
                    if at[0] == "c":
                        up[before[1]].add(at[1])
                        holders[at[1]].add(before[1])
                    else:
                        up[at[1]].discard(before[1])
                        holders[before[1]].discard(at[1])
                    at = before
    return [{j: v + (j in up[i]) for j, v in row.items()} for i, row in enumerate(x)]


def fill_overlaps(x: list[dict[str, int]], matches: list[dict[str, int]], wanted: list[int]) -> None:
    """Adds to `x` (cells by combinations) until every cell has `wanted`, or no flow can bring it
    there: a cell takes what is left of its combinations, or what another cell holds of them and can
    replace from its own others. No cell that was served loses by it; `matches` holds the supplies."""
    spare = {c: n for row in matches for c, n in row.items()}
    for row in x:
        for c, n in row.items():
            spare[c] -= n
    for i, goal in enumerate(wanted):
        lack = goal - sum(x[i].values())
        while lack > 0:
            came: dict[tuple[str, int | str], tuple[str, int | str] | None] = {("cell", i): None}
            todo, end = deque([("cell", i)]), None
            while todo:
                kind, k = at = todo.popleft()
                if kind == "combo" and spare[k] > 0:
                    end = at
                    break
                step = [("combo", c) for c in sorted(matches[k])] if kind == "cell" else [("cell", r) for r, row in enumerate(x) if row.get(k, 0) > 0]
                for n in step:
                    if n not in came:
                        came[n] = at
                        todo.append(n)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()  # cell, combination, cell that holds it, combination, ...
            amount = min([lack, spare[end[1]], *(x[r][c] for (_, c), (_, r) in zip(path[1::2], path[2::2]))])
            for (_, r), (_, c) in zip(path[::2], path[1::2]):
                x[r][c] = x[r].get(c, 0) + amount
            for (_, c), (_, r) in zip(path[1::2], path[2::2]):
                x[r][c] -= amount
            spare[end[1]] -= amount
            lack -= amount


def _round_request(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one request: its cells by combinations, a table of categories."""
    pdf = pdf[pdf["combo"].notna()].sort_values(["cell", "combo"], kind="stable")
    cells = list(dict.fromkeys(pdf["cell"]))
    opens = {o: k for k, o in enumerate(dict.fromkeys(pdf["open_part"]))}
    have: list[dict[int, int]] = [{} for _ in cells]
    matches: list[dict[str, int]] = [{} for _ in cells]
    name: list[dict[int, str]] = [{} for _ in cells]  # within a cell its open part names a combination
    at = {c: k for k, c in enumerate(cells)}
    for c, combo, o, own, n in zip(pdf["cell"], pdf["combo"], pdf["open_part"], pdf["own"], pdf["n"]):
        matches[at[c]][combo] = int(n)
        name[at[c]][opens[o]] = combo
        if own and n > 0:
            have[at[c]][opens[o]] = int(n)
    needed = pdf.groupby("cell", sort=False)["needed"].first()
    wanted = [min(int(needed[c]), sum(m.values())) for c, m in zip(cells, matches)]
    got = controlled_rounding([min(w, sum(h.values())) for w, h in zip(wanted, have)], have)
    x = [{name[i][j]: q for j, q in row.items()} for i, row in enumerate(got)]
    fill_overlaps(x, matches, wanted)
    rows = [(c, combo, q) for c, row in zip(cells, x) for combo, q in sorted(row.items()) if q > 0]
    out = pd.DataFrame(rows, columns=["cell", "combo", "quota"])
    out.insert(0, "request_id", pdf["request_id"].iloc[0] if len(pdf) else None)
    return out


def quotas(people: DataFrame, targets: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(report per listed cell, quota per request and combination).

    Report: request_id, the fields as listed, sample_size, needed, available, drawn.
    """
    combos = people.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))
    total = combos.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    combo = F.to_json(F.array(*[F.col(f) for f in fields]))
    # every pattern that a combination matches, so that cells are found by equality
    patterns = F.array(*[
        F.struct(*[(F.lit("*") if star else F.col(f)).alias(f"k_{f}") for f, star in zip(fields, stars)]) for stars in product((False, True), repeat=len(fields))
    ])
    listed = targets.select(
        "request_id", *fields, F.col("share_bp"), F.col("min_rows"), F.col("sample_bp"),
        *[F.when(F.trim(F.col(f)) == "*", F.lit("*")).otherwise(category(F.col(f))).alias(f"k_{f}") for f in fields],
    )
    keys = [f"k_{f}" for f in fields]
    stars = sum((F.when(F.col(k) == "*", 1).otherwise(0) for k in keys), F.lit(0))
    cell = F.to_json(F.array(*[F.col(k) for k in keys]))
    sized = (
        listed.join(F.broadcast(total), F.lit(True), "inner")  # one row: the total
        .withColumn("sample_size", F.floor(F.col("total") * F.col("sample_bp") / F.lit(10000)).cast("bigint"))
        .withColumn("sample_size", F.expr("(total * sample_bp - (total * sample_bp) % 10000) div 10000"))
        .withColumn("needed", F.greatest(F.col("min_rows").cast("bigint"), F.expr("(sample_size * share_bp + 9999) div 10000")))
        .withColumn("cell", cell)
        .withColumn("stars", stars)
    )
    inside = combos.withColumn("combo", combo).withColumn("p", F.explode(patterns)).select("combo", "n", *fields, *[F.col(f"p.{k}").alias(k) for k in keys])
    matched = sized.drop(*fields).join(inside, keys, "left")
    first = F.row_number().over(W.partitionBy("request_id", "combo").orderBy("stars", "cell"))
    open_part = F.to_json(F.array(*[F.when(F.col(k) == "*", F.col(f)).otherwise(F.lit("")) for k, f in zip(keys, fields)]))
    rounded = (
        matched.filter("combo is not null")
        .select("request_id", "cell", "combo", open_part.alias("open_part"), (first == 1).alias("own"), "n", "needed")
        .groupBy("request_id", "cell", "combo")
        .agg(F.first("open_part").alias("open_part"), F.max("own").alias("own"), F.first("n").alias("n"), F.max("needed").alias("needed"))
        .groupBy("request_id")
        .applyInPandas(_round_request, "request_id bigint, cell string, combo string, quota bigint")
    )
    here = rounded.groupBy("request_id", "cell").agg(F.sum("quota").alias("drawn"))
    available = matched.select("request_id", "cell", "combo", "n").distinct().groupBy("request_id", "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("available"))
    report = sized.join(available, ["request_id", "cell"]).join(here, ["request_id", "cell"], "left")
    return report.select("request_id", *fields, "sample_size", "needed", "available", F.coalesce("drawn", F.lit(0)).alias("drawn")), rounded


def draw(people: DataFrame, rounded: DataFrame, fields: tuple[str, ...] = FIELDS, seed: int = 20_240_601) -> DataFrame:
    """request_id, _id, cell of the sampled rows: per entry, exactly its quotas of smallest keys, of
    several cells one after the other."""
    combo = F.to_json(F.array(*[F.col(f) for f in fields]))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("request_id"), F.col("_id")), 1)
    entry = ["request_id", "combo"]
    keyed = (
        people.select("_id", combo.alias("combo"))
        .join(rounded.select(*entry).distinct(), "combo")
        .withColumn("key", key)
        .withColumn("bucket", F.shiftright("key", 63 - BUCKET_BITS).cast("int"))
    )
    histogram = keyed.groupBy(*entry, "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*entry).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    last = F.sum("quota").over(W.partitionBy(*entry).orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    spans = rounded.withColumn("last", last).select(*entry, "cell", "last", (F.col("last") - F.col("quota")).alias("before"))
    # per bucket the ranks within it that go to a cell
    shares = (
        histogram.withColumn("upto", upto)
        .join(spans, entry)
        .filter("upto > before and upto - n < last")
        .select(*entry, "bucket", "cell", (F.col("before") - F.col("upto") + F.col("n")).alias("lo"), (F.col("last") - F.col("upto") + F.col("n")).alias("hi"), "n")
    )
    near = keyed.join(shares, [*entry, "bucket"])
    whole = (F.col("lo") <= 0) & (F.col("hi") >= F.col("n"))
    rank = F.row_number().over(W.partitionBy(*entry, "bucket", "cell").orderBy("key", "_id"))
    at_edge = near.filter(~whole).withColumn("rank", rank).filter("rank > lo and rank <= hi")
    return near.filter(whole).select("request_id", "_id", "cell").unionByName(at_edge.select("request_id", "_id", "cell"))


def sample(predictions: DataFrame, targets: DataFrame, id_col: str = "prediction_id", fields: tuple[str, ...] = FIELDS, seed: int = 20_240_601) -> tuple[DataFrame, DataFrame]:
    """(sample: request_id, id, cell; report: one row per listed cell)."""
    people = counted(predictions, id_col, fields)
    report, rounded = quotas(people, targets, fields)
    return draw(people, rounded, fields, seed).withColumnRenamed("_id", id_col), report


def shortfalls(report: DataFrame) -> DataFrame:
    """The listed cells that drew less than needed, with the cause: `scarce` if too few results are in
    the cell, `contended` if there are enough but overlapping cells need them too."""
    return report.filter(F.col("drawn") < F.col("needed")).withColumn("cause", F.when(F.col("available") < F.col("needed"), "scarce").otherwise("contended"))


def unmet(report: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The listed cells that drew less than needed as they hold too few results, as listed."""
    return shortfalls(report).filter("cause = 'scarce'").select("request_id", *fields)
