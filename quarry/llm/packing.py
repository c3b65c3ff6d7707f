"""Packing token sequences into windows by non-negative least squares (operator 1).

Documents are cut into pieces of at most a window. A histogram of piece lengths, in units of GRAIN
tokens, is matched by repeat counts of shallow length combinations that fill a window exactly: the
counts solve a non-negative least squares problem, are rounded, and what they leave over is packed
greedily. Pieces under BUNDLE / 2 tokens are joined the same way, by exact length, into bundles of at
most BUNDLE tokens before. Only the histogram, at most BUNDLE / 2 + WINDOW / GRAIN numbers, is on the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.llm.common import cut, documents, group_rank, hash_order, slices
from quarry.llm.tokens import word_ids

WINDOW, GRAIN, DEPTH, BUNDLE = 4096, 8, 3, 256
END = 2


def cut_pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and its end id, cut into windows and a rest.

    Null text is an empty one: its only id is the end id. Repeated rows are cut each. A long text is worked on
    whole but leaves the worker in pieces of a window.
    """
    rows = documents(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def cut_batches(batches):
        encoder, last = word_ids(vocabulary), np.array([end], dtype="<u4").tobytes()
        for batch in slices(batches):
            at, start, length, crc, total, parts = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = encoder.ids(t) + last
                n = len(data) // 4
                for s in range(0, n, window):
                    part = data[4 * s:4 * (s + window)]
                    at.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        parts.append(part)
            out = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                ids = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)), ids))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(cut_batches, schema)


def combinations(window: int, lengths: list[int], depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` (3) of the lengths that sum to the window, longest first."""
    have, out = set(lengths), []
    if window in have:
        out.append((window,))
    for a in sorted(have, reverse=True):
        if depth >= 2 and window - a in have and a >= window - a:
            out.append((a, window - a))
        if depth >= 3:
            out += [(a, b, window - a - b) for b in have if b <= a and 0 < window - a - b <= b and window - a - b in have]
    return sorted(set(out), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by the active-set method: min |a x - b| over x >= 0.

    The solution has at most as many positive entries as ``a`` has rows.
    """
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    least = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds or 4 * a.shape[0] + 10):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        if not len(gain) or gain.max() <= least:
            break
        inside[int(gain.argmax())] = True
        while True:
            at = np.flatnonzero(inside)
            part = a[:, at]
            best = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ b)
            if best.min(initial=1.0) > 0:
                x[:] = 0
                x[at] = best
                break
            low = best <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300))
            x[at] += step * (best - x[at])
            gone = at[low & (x[at] <= 1e-9)]
            gone = gone if len(gone) else at[low][:1]
            x[gone], inside[gone] = 0, False
    return x


def plan_windows(histogram: dict[int, int], window: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all windows; together they hold each length exactly as often as the histogram says."""
    left = {k: v for k, v in histogram.items() if v}
    plan: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(window, list(left), depth)
    if combos:
        bins = sorted(left)
        row = {k: i for i, k in enumerate(bins)}
        a = np.zeros((len(bins), len(combos)))
        for j, c in enumerate(combos):
            for k in c:
                a[row[k], j] += 1
        x = nnls(a, np.array([left[k] for k in bins], dtype=float))
        for j in np.argsort(-x, kind="stable"):
            parts = {k: combos[j].count(k) for k in combos[j]}
            n = min(int(np.floor(x[j] + 0.5)), *(left[k] // m for k, m in parts.items()))
            if n > 0:
                plan.append((combos[j], n))
                for k, m in parts.items():
                    left[k] -= n * m
    while left := {k: v for k, v in left.items() if v}:      # greedily: the longest, then what fits best
        room, parts = window, []
        for k in sorted(left, reverse=True):
            m = min(room // k, left[k])
            parts += [k] * m
            room -= k * m
        n = min(left[k] // parts.count(k) for k in set(parts))
        plan.append((tuple(parts), n))
        for k in set(parts):
            left[k] -= n * parts.count(k)
    return plan


class Seats:
    """The seats of a plan, handed out by rank: the r-th piece of a length has its own window and slot.

    Seats that are alike, the same slot of windows with equal contents, are one run, so the tables are as long as the plan.
    """

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        runs, window = [], 0
        for lengths, n in plan:
            runs += [(k, window, slot, n) for slot, k in enumerate(lengths)]
            window += n
        runs.sort(key=lambda r: r[0])
        length, self.window, self.slot, count = np.array(runs, np.int64).reshape(-1, 4).T
        self.first = np.cumsum(count) - count
        self.begin = np.zeros(int(length.max(initial=0)) + 1, np.int64)
        self.begin[length[::-1]] = self.first[::-1]         # the first run of a length is written last

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, slot) of each piece, given its length and its rank from 0 among pieces of that length."""
        at = self.begin[lengths] + ranks
        run = np.searchsorted(self.first, at, side="right") - 1
        return self.window[run] + at - self.first[run], self.slot[run]


def plan_seats(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, bundle: int = BUNDLE):
    """A function of (bins, ranks) that gives (window, slot), for the pieces counted in ``histogram``, see ``bin_of``.

    Short pieces are first joined, by exact length, into bundles; a bundle then counts as one piece of its units, behind
    the pieces that have as many. So rounding up to units costs a bundle less than one unit, however short its pieces.
    """
    bundles = plan_windows({-k: n for k, n in histogram.items() if k < 0}, bundle, depth)
    units = {k: n for k, n in histogram.items() if k > 0}
    size, behind = [], []
    for lengths, n in bundles:
        size.append(-(-sum(lengths) // grain))
        behind.append(units.get(size[-1], 0))
        units[size[-1]] = behind[-1] + n
    inner, outer = Seats(bundles), Seats(plan_windows(units, window // grain, depth))
    count = np.array([n for _, n in bundles], np.int64)
    start, size, behind = np.cumsum(count) - count, np.array(size, np.int64), np.array(behind, np.int64)

    def seat(bins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, ranks, place, short = bins.copy(), ranks.copy(), np.zeros(len(bins), np.int64), bins < 0
        number, place[short] = inner.find(-bins[short], ranks[short])
        kind = np.searchsorted(start, number, side="right") - 1
        bins[short], ranks[short] = size[kind], behind[kind] + number - start[kind]
        found, slot = outer.find(bins, ranks)
        return found, slot * bundle + place

    return seat


def bin_of(length: Column, grain: int = GRAIN, bundle: int = BUNDLE) -> Column:
    """What a piece is counted under: below half a bundle its exact length, negative, else its length in units, rounded up."""
    return F.when(length < bundle // 2, -length).otherwise(F.ceil(length / grain)).cast("int")


def pack(pieces: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, seed: int = 42) -> DataFrame:
    """The pieces (doc_id, start, length and any other columns) with ``sequence_id`` and ``offset``.

    Lengths must be 1 to ``window``. Offsets are gapless from 0 in a sequence. Nulls in doc_id count as a value;
    pieces that agree in id, start and length are interchangeable. No pieces give no sequences. Places are
    found on a few numbers per piece; ids and other columns move once, when the places are joined to them.
    """
    pieces = cut(pieces.drop("sequence_id", "offset").withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    bundle = min(BUNDLE, window // grain * grain)
    light = pieces.select("__piece", "length", bin_of(F.col("length"), grain, bundle).alias("bin"), hash_order(seed, "doc_id", "start", "length").alias("h"))
    histogram = {r["bin"]: r["n"] for r in light.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = plan_seats(histogram, window, grain, depth, bundle)

    def seat(bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "slot"), place(bins.to_numpy(np.int64), ranks.to_numpy(np.int64)), strict=True)))

    ranked = group_rank(light, ["bin"], "h", ["__piece"])
    seated = ranked.select("__piece", "length", F.pandas_udf(seat, "sequence_id bigint, slot bigint")("bin", "rank").alias("seat")).select("__piece", "length", "seat.*")
    before = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    placed = seated.select("__piece", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return pieces.join(placed, "__piece").drop("__piece")
