"""Removal of byte strings that an earlier document holds (operator 7).

A string of ``length`` bytes is removed where it also starts in a document with a smaller id. Every such
string chooses a seed (quarry.llm.seeds), so equal strings meet at their seed's hash with a region that
covers all strings of that seed. Batches of whole documents are scanned in four steps:

1. each batch sends its different seed hashes; a hash met in two documents is shared;
2. each batch sends a digest of the region around each shared seed, with its least document: of equal
   regions all but the globally least document's are removed whole;
3. where a hash has different regions, the least document of each sends the region's bytes; on their
   concatenation the interval search on the Burrows-Wheeler transform finds equal strings of ``length``;
4. each batch gathers its removed spans.

Nothing is gathered per document group: a batch sends one entry for equal regions, however many of its
documents hold them, and a hash that everyone shares is one entry for each batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from quarry.llm import batches as B
from quarry.llm.batches import BATCH_BYTES, NO_ID
from quarry.llm.common import cut, documents
from quarry.llm.intervals import least_owner
from quarry.llm.seeds import window_seeds

LENGTH, GRAM = 50, 24
ENTRY = np.dtype([("hash", "<u8"), ("mark", "<u8"), ("id", "<i8"), ("doc", "<i4"), ("start", "<i8"), ("size", "<i4")])
WANT = np.dtype([("hash", "<u8"), ("id", "<i8"), ("doc", "<i4"), ("start", "<i8"), ("size", "<i4")])
SPAN = np.dtype([("doc", "<i4"), ("start", "<i8"), ("end", "<i8")])
RESULT = "id bigint, size bigint, starts array<bigint>, ends array<bigint>, kept binary"


class Seeded(B.Batch):
    """A batch with the seeds of its strings."""

    def __init__(self, frame: pd.DataFrame, length: int) -> None:
        super().__init__(frame)
        at, h = window_seeds(np.frombuffer(self.raw, np.uint8), self.ends, length, GRAM)
        # seeds in order of their hash; ``hashes`` are the different ones, ``which`` each seed's
        order = np.argsort(h)
        self.at, h = at[order], h[order]
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        new = B.runs(h)
        self.hashes, self.which = h[new], np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.twice = np.minimum.reduceat(self.doc, first) != np.maximum.reduceat(self.doc, first) if len(first) else np.zeros(0, bool)
        self.low = np.maximum(self.starts[self.doc], self.at - (length - GRAM))
        self.high = np.minimum(self.ends[self.doc], self.at + length)

    def regions(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the regions of the chosen seeds, and for each whether its document is the least of this batch with that region."""
        raw, digest = self.raw, xxhash.xxh64_intdigest
        marks = np.array([digest(raw[a:b]) for a, b in zip(self.low[chosen].tolist(), self.high[chosen].tolist(), strict=True)], dtype=np.uint64)
        docs = self.doc[chosen]
        if not len(chosen):
            return marks, np.zeros(0, bool)
        order = np.argsort(marks)
        new = B.runs(marks[order])
        least = np.empty(len(order), dtype=np.int64)
        least[order] = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        return marks, self.ids[least] == self.ids[docs]


def _first_step(buckets: int, length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = Seeded(frame, length)
        return B.send_hashes(b.hashes, b.twice, frame["batch"].iloc[0], buckets)
    return run


def _second_step(buckets: int, length: int):
    def run(frame: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "batch", "entries"]
        if not len(frame) or not len(flags):
            return pd.DataFrame([], columns=names)
        b = Seeded(frame, length)
        chosen = np.flatnonzero(B.read_flags(b.hashes, flags, buckets)[b.which])
        marks, least = b.regions(chosen)
        # of equal regions within the batch all but the least id's are removed whole: settled here, under a bucket of the batch's own
        gone = chosen[~least & (b.ids[b.doc[chosen]] != NO_ID)]
        spans = np.empty(len(gone), SPAN)
        spans["doc"], base = b.doc[gone], b.starts[b.doc[gone]]
        spans["start"], spans["end"] = b.low[gone] - base, b.high[gone] - base
        own = int(frame["batch"].iloc[0])
        chosen, marks = chosen[least], marks[least]
        rows = np.empty(len(chosen), ENTRY)
        rows["hash"], rows["mark"], rows["id"], rows["doc"] = b.hashes[b.which[chosen]], marks, b.ids[b.doc[chosen]], b.doc[chosen]
        rows["start"], rows["size"] = b.low[chosen] - b.starts[b.doc[chosen]], b.high[chosen] - b.low[chosen]
        order, met, begin = B.by_bucket(rows["hash"], buckets)
        out = [(k, own, B.press(rows[order[x:y]])) for k, x, y in zip(met, begin, begin[1:], strict=False)]
        return pd.DataFrame([*out, (-1 - own, own, B.press(joined(spans)))], columns=names)
    return run


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans of one batch, those that touch or overlap as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    wide = int(spans["end"].max()) + 2
    low, high = spans["doc"].astype(np.int64) * wide + spans["start"], np.maximum.accumulate(spans["doc"].astype(np.int64) * wide + spans["end"])
    new = np.append(True, low[1:] > high[:-1])
    out = spans[new]
    out["end"] = high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)] - out["doc"].astype(np.int64) * wide
    return out


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: spans of regions that a smaller id holds. Kind 1: regions to send, where a hash has several."""
    if frame["bucket"].iloc[0] < 0:         # what a batch has settled itself
        return pd.DataFrame({"batch": frame["batch"], "kind": 0, "data": frame["entries"]})
    rows, batch = B.gathered(frame["entries"], frame["batch"], ENTRY)
    order = np.lexsort((rows["id"], rows["mark"], rows["hash"]))
    rows, batch = rows[order], batch[order]
    new_hash = B.runs(rows["hash"])
    new = new_hash | B.runs(rows["mark"])
    least = rows["id"][new][np.cumsum(new) - 1]
    group = np.cumsum(new_hash) - 1
    several = np.bincount(group, weights=new)[group] > 1
    later = (rows["id"] > least) & (rows["id"] != NO_ID)
    spans = np.empty(int(later.sum()), SPAN)
    spans["doc"], spans["start"], spans["end"] = rows["doc"][later], rows["start"][later], rows["start"][later] + rows["size"][later]
    ask = (rows["id"] == least) & several
    want = np.empty(int(ask.sum()), WANT)
    for n in WANT.names:
        want[n] = rows[n][ask]
    return B.by_batch([(0, batch[later], spans), (1, batch[ask], want)])


def _third_step(buckets: int):
    def run(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "batch", "wants", "regions"]
        if not len(frame) or not len(asked):
            return pd.DataFrame([], columns=names)
        b, zip_ = B.Batch(frame), zstandard.ZstdCompressor(level=1)
        want = np.concatenate([B.unpress(x, WANT) for x in asked["data"]])
        order, met, begin = B.by_bucket(want["hash"], buckets)
        want = want[order]
        low = b.starts[want["doc"]] + want["start"]
        high, out = low + want["size"], []
        for k, x, y in zip(met, begin, begin[1:], strict=False):
            part = b"".join([b.raw[i:j] for i, j in zip(low[x:y].tolist(), high[x:y].tolist(), strict=True)])
            out.append((k, frame["batch"].iloc[0], B.press(want[x:y]), zip_.compress(part)))
        return pd.DataFrame(out, columns=names)
    return run


def _search(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Spans of the regions' strings that a region of a smaller id holds too."""
        want, batch = B.gathered(frame["wants"], frame["batch"], WANT)
        raw = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in frame["regions"])
        high = np.cumsum(want["size"].astype(np.int64))
        low = high - want["size"]
        known: dict[bytes, int] = {}        # equal regions (of one id, or of one digest) are one
        which = np.array([known.setdefault(raw[a:z], len(known)) for a, z in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
        ids = np.full(len(known), NO_ID)
        np.minimum.at(ids, which, want["id"])
        sizes = np.array([len(r) for r in known], np.int64)
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(known), np.uint8)
        inside = np.arange(len(data)) - np.repeat(begin, sizes)
        whole = inside + length <= np.repeat(sizes, sizes)
        least = least_owner(data, np.where(whole, np.repeat(ids, sizes), NO_ID), length)
        spans, of = [], []
        per = np.split(least, begin[1:]) if len(begin) else []
        for i, (r, own) in enumerate(zip(which.tolist(), want["id"].tolist(), strict=True)):
            if own == NO_ID or sizes[r] < length:
                continue
            gone = np.flatnonzero(per[r][:sizes[r] - length + 1] < own)
            if len(gone):
                cutoff = np.flatnonzero(np.diff(gone) > 1)
                for a, z in zip(gone[np.append(0, cutoff + 1)], gone[np.append(cutoff, len(gone) - 1)], strict=True):
                    spans.append((want["doc"][i], want["start"][i] + a, want["start"][i] + z + length))
                    of.append(batch[i])
        return B.by_batch([(0, np.array(of, np.int64), np.array(spans, SPAN))])
    return run


def _fourth_step(keep_text: bool):
    def run(frame: pd.DataFrame, removed: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "size", "starts", "ends", "kept"]
        if not len(frame):
            return pd.DataFrame([], columns=names)
        b = B.Batch(frame)
        edge = np.zeros(len(b.raw) + 1, np.int32)
        for x in removed["data"]:
            s = B.unpress(x, SPAN)
            np.add.at(edge, b.starts[s["doc"]] + s["start"], 1)
            np.add.at(edge, b.starts[s["doc"]] + s["end"], -1)
        cover = np.cumsum(edge)[:-1] > 0
        data, out = np.frombuffer(b.raw, np.uint8), []
        for d, x, y in zip(b.ids.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True):
            own = cover[x:y]
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            rest = data[x:y][~own].tobytes()
            out.append((d, y - x, turns[::2], turns[1::2], rest if keep_text else hashlib.sha256(rest).digest()))
        return pd.DataFrame(out, columns=names)
    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batch_bytes: int = BATCH_BYTES, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): each document's removed spans, in bytes, and the bytes left.

    ``doc_id`` is an integer. With ``keep_text=False`` ``kept`` is the SHA-256 of the bytes left. Null texts are empty.
    A null id is smaller than none and none is smaller than it, so such rows neither lose nor take anything.
    Rows that repeat an id do not take from each other. Other columns are not read.
    """
    rows = documents(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = B.batch_count(rows, batch_bytes)
    packed = B.pack(rows, n)
    sent = packed.groupBy("batch").applyInPandas(_first_step(n, length), B.SENT)
    flags = sent.groupBy("bucket").applyInPandas(B.shared_flags, B.FLAGS)
    entries = packed.groupBy("batch").cogroup(flags.groupBy("batch")).applyInPandas(_second_step(n, length), "bucket bigint, batch bigint, entries binary")
    compared = cut(entries.groupBy("bucket").applyInPandas(_compare, B.STEP), "compared")
    again = B.pack(rows, n)
    asked = again.groupBy("batch").cogroup(compared.where("kind = 1").groupBy("batch")).applyInPandas(
        _third_step(n), "bucket bigint, batch bigint, wants binary, regions binary")
    found = asked.groupBy("bucket").applyInPandas(_search(length), B.STEP)
    spans = compared.where("kind = 0").union(found)
    done = again.groupBy("batch").cogroup(spans.groupBy("batch")).applyInPandas(_fourth_step(keep_text), RESULT)
    return done.select(F.when(F.col("id") != int(NO_ID), F.col("id")).alias("doc_id"), F.col("size").alias("n_bytes"), "starts", "ends", "kept")
