"""Batches of whole documents that exchange what they hold by hash.

Documents are dealt out to batches of a few megabytes, texts pressed. A batch sends one entry for each
different hash it holds, not one for each document, to the bucket of the hash; buckets answer to batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Stands for a null id: it is smaller than none, and none is smaller than it.
NO_ID = np.iinfo(np.int64).max
BATCH_BYTES = 4 << 20
PACKED = "batch bigint, ids binary, sizes binary, texts binary"


def batch_count(rows: DataFrame, batch_bytes: int) -> int:
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // batch_bytes))


def pack(rows: DataFrame, batches: int) -> DataFrame:
    """Rows (batch, ids, sizes, texts) of many documents each, their texts compressed, to be dealt out by batch."""
    keyed = rows.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)))

    def run(frames):
        press = zstandard.ZstdCompressor(level=1)
        for frame in frames:
            out = []
            for batch, part in frame.groupby("batch", sort=False):
                texts = [t.encode() for t in part["text"]]
                out.append((batch, part["id"].to_numpy(np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), press.compress(b"".join(texts))))
            yield pd.DataFrame(out, columns=["batch", "ids", "sizes", "texts"])
    return keyed.mapInPandas(run, PACKED)


class Batch:
    """The documents of a batch in one fixed order."""

    def __init__(self, frame: pd.DataFrame) -> None:
        texts, ids = [], []
        for i, s, t in zip(frame["ids"], frame["sizes"], frame["texts"], strict=True):
            raw, at = zstandard.ZstdDecompressor().decompress(t), 0
            for d, n in zip(np.frombuffer(i, np.int64).tolist(), np.frombuffer(s, np.int64).tolist(), strict=True):
                ids.append(d)
                texts.append(raw[at:at + n])
                at += n
        order = sorted(range(len(ids)), key=lambda j: (ids[j], texts[j]))
        self.ids = np.array([ids[j] for j in order], np.int64)
        texts = [texts[j] for j in order]
        self.raw = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)


def by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Order by bucket of the hash (stable), the buckets met, and where each begins."""
    bucket = (values >> np.uint64(13)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    met, begin = np.unique(bucket[order], return_index=True)
    return order, met.tolist(), np.append(begin, len(values))


def press(rows: np.ndarray) -> bytes:
    """The fields one after the other, which presses better than rows."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in rows.dtype.names))


def unpress(data: bytes, kind: np.dtype) -> np.ndarray:
    raw, at = zstandard.ZstdDecompressor().decompress(data), 0
    out = np.empty(len(raw) // kind.itemsize, kind)
    for name in kind.names:
        out[name] = np.frombuffer(raw, kind[name], len(out), at)
        at += len(out) * kind[name].itemsize
    return out


def gathered(cells, batches, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all cells, and the batch that each came from."""
    parts = [unpress(x, kind) for x in cells]
    return np.concatenate(parts), np.repeat(np.asarray(batches, np.int64), [len(p) for p in parts])


def by_batch(kinds) -> pd.DataFrame:
    """(batch, kind, data) from (kind, batch of each row, rows)."""
    out = []
    for kind, batch, rows in kinds:
        order = np.argsort(batch, kind="stable")
        met, begin = np.unique(batch[order], return_index=True)
        for k, x, y in zip(met.tolist(), begin, np.append(begin[1:], len(order)), strict=False):
            out.append((k, kind, press(rows[order[x:y]])))
    return pd.DataFrame(out, columns=["batch", "kind", "data"])


SENT = "bucket bigint, batch bigint, hashes binary, twice binary"
FLAGS = "batch bigint, bucket bigint, flags binary"
STEP = "batch bigint, kind int, data binary"


def send_hashes(hashes: np.ndarray, twice: np.ndarray, batch: int, buckets: int) -> pd.DataFrame:
    """A row per bucket: the batch's different hashes in it, and whether two documents of the batch hold them."""
    order, met, begin = by_bucket(hashes, buckets)
    out = [(k, batch, hashes[order[x:y]].tobytes(), np.packbits(twice[order[x:y]]).tobytes()) for k, x, y in zip(met, begin, begin[1:], strict=False)]
    return pd.DataFrame(out, columns=["bucket", "batch", "hashes", "twice"])


def shared_flags(frame: pd.DataFrame) -> pd.DataFrame:
    """For each batch, flags of its 64-bit hashes in this bucket: met in another batch, or in two documents of one."""
    return flags_of(frame, [np.frombuffer(x, np.uint64) for x in frame["hashes"]])


def flags_of(frame: pd.DataFrame, hashes: list[np.ndarray]) -> pd.DataFrame:
    """``shared_flags`` for the hashes of each row."""
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)) for t, h in zip(frame["twice"], hashes, strict=True)])
    _, which, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    flag = np.bincount(which, weights=twice) + (n > 1) > 0
    parts = np.split(flag[which], np.cumsum([len(h) for h in hashes])[:-1])
    return pd.DataFrame({"batch": frame["batch"], "bucket": frame["bucket"], "flags": [np.packbits(p).tobytes() for p in parts]})


def read_flags(hashes: np.ndarray, flags: pd.DataFrame, buckets: int) -> np.ndarray:
    """The answer to ``send_hashes``, in the order of ``hashes``."""
    order, met, begin = by_bucket(hashes, buckets)
    answers = dict(zip(flags["bucket"], flags["flags"], strict=True))
    shared = np.zeros(len(order), bool)
    for k, x, y in zip(met, begin, begin[1:], strict=False):
        shared[order[x:y]] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=y - x).astype(bool)
    return shared


def runs(values: np.ndarray) -> np.ndarray:
    """Flags over sorted values: the first of its kind."""
    return np.append(True, values[1:] != values[:-1])[:len(values)]
