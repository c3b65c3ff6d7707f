"""SimHash near-duplicates through a Gray-order hierarchical index (operator 2).

Fingerprints that differ in few bits agree in at least one of a few blocks of bits, so the different
fingerprints are dealt out by block. In each group an index is built: fingerprints sorted by Gray rank,
runs of neighbours under a node that holds the bits they share, as a masked pattern, and so on upwards,
each node keeping only bits that no node above it holds. A search adds up differences from the top and
drops a node, with all below it, when they exceed the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import cut, documents, slices
from quarry.llm.components import connected

DIFFERENCES = 2
#: Groups of more fingerprints are dealt out once more, by blocks of the bits that they do not yet share.
GROUP_ROWS = 20_000
FAN_OUT = 8
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text, unsigned; 0 without words (null text too)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    columns = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, h): the fingerprint of each row as a signed long; ``row`` is a hash of its id and text."""
    rows = documents(docs, doc_id, text).withColumn("row", row_hash("doc_id", "text"))

    def run(batches):
        for batch in slices(batches):
            h = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(h)], names=["doc_id", "row", "h"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row bigint, h bigint")


def row_hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit("")))


def blocks(free: list[int], parts: int) -> list[int]:
    """Masks of the free bit positions cut into so many blocks."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free, dtype=np.int64), parts) if len(part)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over Gray-sorted codes, the root level first.

    A node has a pattern, the mask of the bits that it adds to those held above, and its children's range.
    """

    def __init__(self, codes: np.ndarray, fan_out: int = FAN_OUT) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, zeros = self.codes, ~self.codes
        stack = [(ones, ones | zeros, None)]
        while len(stack[-1][0]) > fan_out:
            at = np.arange(0, len(ones), fan_out)
            ends = np.append(at[1:], len(ones))
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            stack.append((ones, ones | zeros, (at, ends)))
        self.levels = []
        for depth, (pattern, mask, children) in enumerate(reversed(stack)):
            own = mask if depth == 0 else mask & ~np.repeat(above, widths)
            self.levels.append((pattern, own, children))
            if children is not None:
                above, widths = mask, children[1] - children[0]

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions, codes as sorted here, of all that differ in at most ``limit`` bits."""
        width = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries))
        apart = np.zeros(len(q), dtype=np.int64)
        for pattern, own, children in self.levels:
            apart = apart + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            keep = apart <= limit
            q, node, apart = q[keep], node[keep], apart[keep]
            if children is not None:
                n = children[1][node] - children[0][node]
                skip = np.repeat(np.cumsum(n) - n, n)
                node = np.repeat(children[0][node], n) + np.arange(len(skip)) - skip
                q, apart = np.repeat(q, n), np.repeat(apart, n)
        return q, node


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least position of its part) after joining the parts of a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def link_group(codes: np.ndarray, limit: int = DIFFERENCES, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Enough links (code, code) to join all codes of a group that are within the limit of each other, at most one per code."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for at in range(0, len(codes), block):
        q, c = index.search(index.codes[at:at + block], limit)
        label = _merge(label, q + at, c)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return index.codes[linked], index.codes[label[linked]]


def links(codes: DataFrame, limit: int = DIFFERENCES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v) links between different fingerprints (column h, distinct) that join all that are within ``limit`` bits.

    Codes meet in every block of bits that they agree in. Codes within the limit agree in one of limit + 1
    blocks, and again in one of limit + 1 blocks of the bits left, so a group that is too large for one
    task is dealt out again by those, and no link is lost.
    """
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for group in batch.column(0):
                u, v = link_group(np.array(group.values.to_numpy(zero_copy_only=False)).view(np.uint64), limit)
                us.append(u)
                vs.append(v)
            both = [pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)) for x in (us, vs)]
            yield pa.RecordBatch.from_arrays(both, names=["u", "v"])

    masks = [F.lit(signed(m)) for m in blocks(list(range(64)), limit + 1)]
    rows = codes.select("h", F.explode(F.array(*masks)).alias("mask"))
    found = None
    while True:
        keyed = rows.withColumn("key", F.col("h").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        large = cut(sizes.where(F.col("n") > group_rows).select("mask", "key"), "large-groups")
        fine = keyed.join(large, ["mask", "key"], "left_anti").groupBy("mask", "key").agg(F.collect_list("h").alias("hs")).where(F.size("hs") > 1)
        part = fine.select("hs").mapInArrow(run, "u bigint, v bigint")
        found = part if found is None else found.union(part)
        hot = [r["mask"] for r in large.select("mask").distinct().collect()]     # at most as many as there are masks
        finer = {}
        for mask in hot:
            held = mask % (1 << 64)
            if parts := blocks([b for b in range(64) if not held >> b & 1], limit + 1):
                finer[mask] = [signed(held | part) for part in parts]
        if not finer:
            return found
        pick = F.create_map(*[x for m, parts in finer.items() for x in (F.lit(m), F.array(*map(F.lit, parts)))])
        rows = cut(keyed.join(large, ["mask", "key"], "left_semi").select("h", F.explode(F.element_at(pick, F.col("mask"))).alias("mask")).distinct(), "large-members")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = DIFFERENCES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, row, h, component_id): fingerprint and the smallest id reachable over links, for every row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Null ids stay; a
    component of null ids only has a null component_id. Repeated rows are answered each. Equal fingerprints
    are one row before anything is compared, however many documents have them. Other columns are not read.
    """
    prints, parts = _components(docs, doc_id, text, limit, group_rows)
    return prints.join(parts, "h").select("doc_id", "row", "h", "component_id")


def _components(docs: DataFrame, doc_id: str, text: str, limit: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints of all rows, and of each different one its component: h, root, component_id."""
    prints = cut(fingerprints(docs, doc_id, text), "fingerprints")
    codes = prints.groupBy("h").agg(F.min("doc_id").alias("first"))
    roots = connected(links(codes.select("h"), limit, group_rows))
    named = codes.join(roots, codes["h"] == roots["node"], "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, named.join(least, "root").select("h", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = DIFFERENCES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row of each component, that with the smallest id (null last), with all its columns."""
    prints, parts = _components(docs, doc_id, text, limit, group_rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # the least row of each fingerprint first: a fingerprint that many documents have is summed up before it is joined
    per_code = prints.groupBy("h").agg(F.min(order).alias("least"))
    winners = per_code.join(parts, "h").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row"))
    return docs.withColumn("__row", row_hash(doc_id, text)).join(winners, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
