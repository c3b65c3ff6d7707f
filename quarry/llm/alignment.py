"""Cross-tokenizer alignment by interval coalescing (operator 11).

Both tokenizers cut a text into byte intervals. All intervals, sorted by start, are swept with a running maximum of
their ends; where a start reaches that maximum, both sides have ended and a group closes. Overlaps are expanded within
groups, and those that end together are links. How many links hold a pair of ids is counted over the corpus.

Both tokenizers end a token before a run of white space (a kind that no piece holds but in front) and none looks back across it, so a
text is a sequence of units, each of which is tokenized and coalesced once by a worker and then known. Tokens that end together, one the end of the other, are
pairs that the vocabularies alone determine, so the table of counts has a fixed size and is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import cut, slices

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: White space that the byte-level tokenizer never joins to what is before it.
BREAKS = " \t\n\r\x0b\x0c"
_CHUNK = re.compile(r"\s*\S+|\s+")
#: Units of a generation of known units (a worker keeps the current one and the one before), and the longest that is kept.
KNOWN_UNITS, LONG_UNIT = 250_000, 48
JOINED_CHARS = 4096


def public_tokenizers_paths() -> tuple[str, str]:
    """The two vocabulary files that the query uses: byte-level ranks (the same ids as byte_bpe_50k.json) and pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: groups break where a start, in sorted order, reaches the running maximum of ends."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(np.append(0, starts[order][1:] >= reach[:-1])[:len(starts)])
    return group


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of intervals that overlap; each side is sorted and free of overlaps in itself, so theirs lie in one group."""
    low = np.searchsorted(b[1], a[0], "right")
    n = np.maximum(np.searchsorted(b[0], a[1], "left") - low, 0)
    left = np.repeat(np.arange(len(n)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + low[left]


class Aligner:
    """Groups and links of texts under a byte-level vocabulary (A) and a piece vocabulary (B)."""

    def __init__(self, ranks: str, pieces: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(named)]
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for data, i in table.items():
            self.a_bytes[i] = data
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        inner = "".join(p.replace(SPACE, " ").lstrip(" ")[1:] for p in named)
        self.breaks = "".join(c for c in BREAKS if c not in inner)      # no piece has them but in front
        self.odd = re.compile(f"[^\\S{self.breaks}]")
        self.pairs = self._possible_pairs()
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.names = [b"%d%s" % (i, mark) for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (b",", b"|", b";")]

    def _possible_pairs(self) -> np.ndarray:
        """Sorted numbers a * |B| + b of all pairs in which one token's bytes end the other's."""
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for side, tokens in zip(by_bytes, (self.a_bytes, self.b_bytes), strict=True):
            for i, data in enumerate(tokens):
                if data:
                    side.setdefault(data, []).append(i)
        n, out = len(self.b_bytes), []
        for i, data in enumerate(self.a_bytes):
            out.extend(i * n + j for at in range(len(data)) for j in by_bytes[1].get(data[at:], ()))
        for j, data in enumerate(self.b_bytes):
            out.extend(i * n + j for at in range(1, len(data)) for i in by_bytes[0].get(data[at:], ()))
        return np.unique(np.array(out, np.int64))

    def units(self, text: str) -> list[str]:
        full = " " + text
        chunks = _CHUNK.findall(full)
        if not self.odd.search(full):
            return chunks
        out: list[str] = []
        for c in chunks:        # a run of other white space stays with what is before it
            if out and c[0] not in self.breaks:
                out[-1] += c
            else:
                out.append(c)
        return out

    def _encode(self, fulls: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of strings that begin with a space, or None where a side does not give the string's bytes."""
        out = []
        for full, b in zip(fulls, self.b.encode([x[1:] for x in fulls], num_threads=1), strict=True):
            a, data = self.a.encode_ordinary(full), full.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out

    def _learn(self, units: list[str]) -> dict[str, tuple | None]:
        """Tokens of new units. They are encoded together, behind a unit that is cut off again; where that fails, one by one."""
        runs, size = [[]], 0
        for u in units:
            if size > JOINED_CHARS:
                runs.append([])
                size = 0
            runs[-1].append(u)
            size += len(u)
        out: dict[str, tuple | None] = {}
        for run, coded in zip(runs, self._encode([" a" + "".join(run) for run in runs]), strict=True):
            found = self._entries(run, coded) if coded else None
            if found is not None:
                out.update(zip(run, found, strict=True))
            elif len(run) == 1:
                out[run[0]] = None
            else:
                for u in run:
                    out.update(self._learn([u]))
        return out

    def _entries(self, run: list[str], coded: tuple[np.ndarray, np.ndarray]) -> list[tuple] | None:
        """(groups as text, link slots, tokens of A) of each unit of a run; None if a side's tokens cross a unit's end."""
        a, b = coded
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        edges = 2 + np.append(0, np.cumsum([len(u.encode()) for u in run]))
        if not (np.isin(edges, a_ends).all() and np.isin(edges, b_ends).all()):
            return None
        a_starts, b_starts = a_ends - self.a_len[a], b_ends - self.b_len[b]
        group = coalesce(np.append(a_starts, b_starts), np.append(a_ends, b_ends))
        ga, gb = group[:len(a)], group[len(a):]
        left, right = overlaps((a_starts, a_ends), (b_starts, b_ends))
        together = a_ends[left] == b_ends[right]
        left, right = left[together], right[together]
        slots = np.searchsorted(self.pairs, a[left] * len(self.b_bytes) + b[right]).astype("<i4")
        # the groups as text: a token's id with what follows it, a comma inside a side, a bar after A, a semicolon after B
        side = np.append(2 * ga, 2 * gb + 1)
        order = np.argsort(side, kind="stable")
        after = np.append(side[order][1:] != side[order][:-1], True) * (1 + side[order] % 2)
        texts = list(map(self.names.__getitem__, (3 * np.append(a, b)[order] + after).tolist()))
        data = slots.tobytes()
        at_a, at_b = np.searchsorted(a_ends, edges, "right"), np.searchsorted(b_ends, edges, "right")
        at_link, at_text, at_a = (4 * np.searchsorted(a_ends[left], edges, "right")).tolist(), (at_a + at_b).tolist(), at_a.tolist()
        return [(b"".join(texts[at_text[i]:at_text[i + 1]])[:-1], data[at_link[i]:at_link[i + 1]], at_a[i + 1] - at_a[i]) for i in range(len(run))]

    def align(self, texts: list[str | None]) -> list[tuple[bytes, np.ndarray, int] | None]:
        """(groups as text, slots of the links, tokens of A) of each text; None for those without tokens."""
        cut_up = [self.units(t) if t else None for t in texts]
        if len(self.known) > KNOWN_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set().union(*filter(None, cut_up)) - known.keys()
        known.update({u: older[u] for u in missing & older.keys()})
        found = self._learn([u for u in missing if u not in known])
        known.update({u: x for u, x in found.items() if x is None or len(u) <= LONG_UNIT})
        out: list[tuple[bytes, np.ndarray, int] | None] = []
        for units in cut_up:
            parts = list(map(known.get, units)) if units else [None]
            if None in parts and units:
                parts = [known.get(u) or found.get(u) for u in units]
            out.append(None if None in parts else (
                b";".join(map(itemgetter(0), parts)), np.frombuffer(b"".join(map(itemgetter(1), parts)), "<i4"), sum(map(itemgetter(2), parts))))
        return out


_OPEN: dict[tuple[str, str], Aligner] = {}


def aligner(ranks: str, pieces: str) -> Aligner:
    """The worker's own instance for two vocabulary files."""
    if (ranks, pieces) not in _OPEN:
        _OPEN[ranks, pieces] = Aligner(ranks, pieces)
    return _OPEN[ranks, pieces]


def _delta(values: np.ndarray) -> bytes:
    """Ascending numbers in one to five bytes each: seven bits of the step per byte, low bits first."""
    step = np.diff(values, prepend=0).astype(np.uint64)
    size = 1 + sum((step >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = size > k
        out[at[some] + k] = ((step[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def _undelta(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    begin = np.append(0, np.flatnonzero(raw < 128)[:-1] + 1)
    within = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * within), begin))


def _counted(slots: np.ndarray) -> bytes:
    """Different slots, how many, and each one's number of links."""
    met, n = np.unique(slots, return_counts=True)
    return _delta(met.astype(np.int64)) + _delta(np.cumsum(n))


def _read_counted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    middle = int(ends[len(ends) // 2 - 1]) if len(ends) else 0
    return _undelta(data[:middle]), np.diff(_undelta(data[middle:]), prepend=0)


FOUND = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("slots", pa.binary()), ("groups", pa.string())]


def align(docs: DataFrame, ranks: str, pieces: str, doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, slots and, if asked for, groups (``a1,a2|b1;a3|b2``): a row per input row.

    ``slots`` packs the document's links by pair. Texts that are null, empty or not given back byte by byte by both sides
    have no tokens: zeros and empty strings. Rows that repeat are aligned each by itself; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = FOUND if keep_groups else FOUND[:-1]

    def run(batches):
        tool = aligner(ranks, pieces)
        for batch in slices(batches, 128):
            out = []
            for found in tool.align(batch.column("text").to_pylist()):
                if found is None:
                    row = (0, 0, 0, 0, "", b"", "")
                else:
                    groups, slots, n_a = found
                    n_groups = groups.count(b";") + 1
                    row = (n_a, groups.count(b",") + 2 * n_groups - n_a, n_groups, len(slots), hashlib.sha256(groups).hexdigest(), _counted(slots), groups.decode() if keep_groups else "")
                out.append(row[:len(fields)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]],
                                             names=["doc_id", *[n for n, _ in fields]])
    sql = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} {sql[t]}" for n, t in fields]]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(slot, n): links that hold each pair, over all rows; a task adds up its own first."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("slots").to_pylist():
                slots, n = _read_counted(data)
                if len(slots):
                    if slots[-1] >= len(total):
                        total = np.append(total, np.zeros(slots[-1] + 1 - len(total), np.int64))
                    total[slots] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["slot", "n"])
    return aligned.select("slots").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, ranks: str, pieces: str, doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """``align`` with n_best and count_sum in place of ``slots``.

    n_best: links whose pair is met as often as any pair of its B id in the corpus; count_sum: the pairs' counts, summed over the links.
    The counts (a number for each possible pair of the two vocabularies, whatever the corpus) are broadcast.
    """
    aligned = cut(align(docs, ranks, pieces, doc_id, text, keep_groups), "aligned")
    tool = aligner(ranks, pieces)
    met = pair_counts(aligned).toPandas()        # at most one row per possible pair
    counts = np.zeros(len(tool.pairs), np.int64)
    counts[met["slot"].to_numpy(np.int64)] = met["n"].to_numpy(np.int64)
    of_b, highest = tool.pairs % len(tool.b_bytes), np.zeros(len(tool.b_bytes), np.int64)
    np.maximum.at(highest, of_b, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[of_b]))
    kept = [c for c in aligned.columns if c != "slots"]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept], "n_best bigint", "count_sum bigint"])

    def run(batches):
        n, best = shared.value
        for batch in batches:
            out = []
            for data in batch.column("slots").to_pylist():
                slots, times = _read_counted(data)
                out.append((int(times[best[slots]].sum()), int((times * n[slots]).sum())))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, "n_best", "count_sum"])
    return aligned.mapInArrow(run, schema)
