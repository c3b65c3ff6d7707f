"""Mixing sources to target weights along a time-varying curriculum (operator 3).

Every source has a weight schedule over training time 0 to 1. Its integral is the source's cumulative
demand for words; the word that a source delivers at a given amount therefore belongs at the time where
the demand reaches that amount. Documents are repeated whole, placed by inverting the demand, and
range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm.common import cut, group_rank, hash_order
from quarry.session import explode_once

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedule by weight, as (time, relative weight) with straight lines between: heavy sources fade in, light ones fade out.
SCHEDULES = {5.0: ((0.0, 0.8), (0.5, 1.0), (1.0, 1.2)), 2.0: ((0.0, 1.0), (1.0, 1.0)), 1.0: ((0.0, 1.4), (0.6, 1.0), (1.0, 0.4))}
MOST = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Sources are ordered by code point, null last, and weigh ``weights``, repeating. They share all words
    by weight; a target stops at ``most`` times its source's size and the excess is shared again by
    weight among the rest until none is above. The table has a row per source and each round of
    sharing is one sum over it.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("double")), "sources")
    cap = F.col("source_size") * float(most)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # a source is capped from the level on that gives it more than its cap; the level only rises
    level, before = 0.0, -1
    while True:
        full = F.lit(before >= 0) & (F.lit(level) * F.col("weight") >= cap)
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if row[2] == before or not row[1]:
            break
        level, before = max(0.0, total - row[0]) / row[1], row[2]
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap) if before >= 0 else cap)


def _pick(hist: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size of one source to take in its last, partial pass.

    From the largest size to the smallest, what is taken follows the same share of what there is, and the error
    of one size is made good by the next, so the source ends within about its smallest documents of its target.
    """
    hist = hist.sort_values("size", ascending=False, kind="stable")
    total, goal = int(hist["source_size"].iloc[0]), round(float(hist["target"].iloc[0]))
    base = min(goal // total, MOST) if total else 0
    rest, seen, taken, picks = goal - base * total, 0, 0, []
    for size, n in zip(hist["size"].tolist(), hist["n"].tolist(), strict=True):
        m = 0
        if size and rest > 0:
            seen += size * n
            m = max(0, min(n, math.floor((rest * seen / total - taken) / size + 0.5)))
            taken += m * size
        picks.append(m)
    return hist[["skey", "size"]].assign(base=base if total else 0, pick=picks)


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """A stored row per row of ``docs`` (doc_id, source, size): row_id, source_size, weight, target and ``copies``.

    A row is taken whole, ``copies`` times, 0 to 3. Null sources are one source, the last; null or zero
    sizes are taken 0 times; rows that agree in everything are picked one by one. ``carry`` names
    further columns to keep. Empty tables give no rows.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *carry), "mix-rows")
    targets = source_targets(rows.select("source", "size"), weights)
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    keyed = rows.withColumn("skey", skey)
    hist = keyed.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = targets.withColumn("skey", skey).drop("source")
    picks = hist.join(totals, "skey").groupBy("skey").applyInPandas(_pick, "skey string, size long, base int, pick long")
    light = keyed.select("row_id", "doc_id", "skey", "size").withColumn("h", hash_order(seed, "doc_id", "size"))
    ranked = group_rank(light, ["skey", "size"], "h", ["row_id"], "place").join(picks, ["skey", "size"])
    copies = ranked.select("row_id", (F.col("base") + F.when(F.col("place") < F.col("pick"), 1).otherwise(0)).alias("copies"))
    zero = F.when(F.col("size") == 0, 0).otherwise(F.col("copies"))
    return keyed.join(copies, "row_id").join(totals, "skey").withColumn("copies", zero.cast("int")).drop("skey")


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(time, length, weight at its start, slope, demand before) of a schedule whose whole demand is one."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1 - t0, w0 / area, (w1 - w0) / area / (t1 - t0), done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def time_of_demand(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's cumulative demand reaches ``demand`` (0 to 1)."""
    out = None
    for t0, length, w0, slope, done in reversed(segments(knots)):
        more = demand - done
        at = F.lit(t0) + F.least(F.lit(length), 2 * more / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * more, F.lit(0.0)))))
        out = at if out is None else F.when(demand < _end(knots, done, t0), at).otherwise(out)
    return out


def _end(knots, done: float, t0: float) -> float:
    later = [s[4] for s in segments(knots) if s[0] > t0]
    return later[0] if later else 1.0


def occurrences(planned: DataFrame, schedules=SCHEDULES, seed: int = 42) -> DataFrame:
    """A row per copy of each planned row: row_id, doc_id, size, epoch and position, range-sorted by position.

    A source delivers whole passes over its rows, each in an order of its own, and the picked rows last.
    The position is the time at which the source's demand reaches the middle of the copy.
    """
    one = F.sequence(F.lit(0), F.col("copies") - 1)
    rows = explode_once(planned.where("copies > 0").withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
                        .select("row_id", "doc_id", "skey", "size", "source_size", "weight", "target", "copies"), one, "epoch")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("row_id")))
    ordered = group_rank(rows, ["skey", "epoch"], "h", ["row_id"], "before", weight="size")
    middle = (F.col("epoch") * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target")
    demand = F.least(F.greatest(middle, F.lit(0.0)), F.lit(1.0))
    position = F.lit(None).cast("double")
    for weight, knots in schedules.items():
        position = F.when(F.col("weight") == weight, time_of_demand(demand, knots)).otherwise(position)
    placed = ordered.select("row_id", "doc_id", "size", "epoch", F.coalesce(position, demand).alias("position"))
    return placed.repartitionByRange("position", "row_id").sortWithinPartitions("position", "row_id")


def taken(planned: DataFrame, **how) -> DataFrame:
    """(row_id, taken, first_position): words the mix takes of each row that it takes."""
    return occurrences(planned, **how).groupBy("row_id").agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
