"""Fuzzy shared passages by collinear chaining (operator 5).

Seeds are hashes of short runs of words. A seed that several documents hold refers to the least document
with it. Matches of a document with one earlier document are chained in order through a Fenwick tree, the
chains are aligned word by word, and stretches of which at least the wanted share of words is matched
are passages. Documents meet only at the least holder of a seed, so there are as many matches as seeds,
however many documents share a passage.

Where the seeds of a passage have their least holders in other documents, longer runs, each its own seed,
lead to those that hold more of it. The longest run is as long as the shortest passage, so the words of an
equal stretch of that length are matched whatever holders its shorter runs have. A longer run whose runs of RUN
words all refer to one document, at places one after the other, needs no seed: its least holder is that document.
For one that holds the longer run holds all the shorter ones, so none is smaller, and the places say that it holds it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.llm import batches as B, bitpack as P
from quarry.llm.batches import BATCH_BYTES, NO_ID
from quarry.llm.common import documents
from quarry.llm.words import longer_runs, run_seeds, word_hashes

#: Every run of RUN words is a seed: with a fifth of its words changed, a stretch still has equal runs of 4.
RUN, WIDTH = 4, 1
SIMILARITY, LEAST_WORDS = 0.8, 40
#: Words of the longer seeds; they are sent where all runs of RUN words in them are shared, but not with one document at places in a row.
LONGER = (8, 16, 40)
#: Batches whose hashes would fill a bucket; each batch has a cell in each bucket, so fewer buckets make fewer cells.
BUCKET_BATCHES = 4
#: Cost of a word between two matches of a chain, in matches; words of a gap that ends a chain.
GAP_COST, GAP_WORDS = 0.02, 30
#: Words at which a chain is looked on beyond its ends; words in runs of the shortest chain that counts. In 40 words with
#: 8 changed the 32 others lie in at most 9 runs; if all but one have 3 words or fewer, that one has 8.
BEYOND, CHAIN_WORDS = 40, 8
ENTRY = np.dtype([("hash", "<u8"), ("id", "<i8"), ("doc", "<i4"), ("word", "<i8"), ("alone", "u1")])
MATCH = np.dtype([("hash", "<u8"), ("id", "<i8"), ("batch", "<i8"), ("doc", "<i4"), ("word", "<i8")])
ANCHOR = np.dtype([("doc", "<i4"), ("to_batch", "<i8"), ("to_doc", "<i4"), ("to_id", "<i8"), ("chain", "<i4"), ("x", "<i8"), ("y", "<i8")])
ASK = np.dtype([("batch", "<i8"), ("doc", "<i4"), ("low", "<i8"), ("high", "<i8")])
TOLD = np.dtype([("batch", "<i8"), ("doc", "<i4"), ("low", "<i8"), ("n", "<i8")])
RESULT = "doc_id bigint, start_word bigint, end_word bigint, matched_words bigint, similarity double, earlier array<bigint>"


def by_hash(h: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes. Plain numbers sort many times faster than an order of them is found, so the place stands in the last bits."""
    bits = np.uint64(len(h).bit_length())
    last = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort(h & ~last | np.arange(len(h), dtype=np.uint64)) & last).astype(np.int64)
    got = h[order]
    return np.argsort(h, kind="stable") if (got[1:] < got[:-1]).any() else order      # two may differ in the bits that gave way only


def by_columns(*columns: np.ndarray) -> np.ndarray:
    """The stable order by integer columns, the first one first: as many as fit are one number with the place in its last bits."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    least = [int(c.min()) for c in columns]
    width = [(int(c.max()) - a).bit_length() for c, a in zip(columns, least, strict=True)]
    bits, i, order = n.bit_length(), len(columns), np.arange(n)
    if max(width) + bits > 63:
        return np.lexsort(columns[::-1])
    while i:
        key, used = np.zeros(n, np.int64), 0
        while i and used + width[i - 1] + bits <= 63:
            i -= 1
            key |= (columns[i].astype(np.int64) - least[i]) << used
            used += width[i]
        order = order[np.sort(key[order] << bits | np.arange(n)) & ((1 << bits) - 1)]
    return order


class Seeds:
    """Seeds of a batch in order of (hash, place), and their different hashes. ``doc_of``: the document of each word."""

    def __init__(self, at: np.ndarray, h: np.ndarray, doc_of: np.ndarray) -> None:
        order = by_hash(h)        # places come ascending
        self.at, h = at[order], h[order]
        self.doc = doc_of[self.at]
        new = B.runs(h)
        self.hashes, self.which = h[new], np.cumsum(new) - 1
        self.lead = np.flatnonzero(new)         # ids rise with place, so a hash's first seed is its least document's
        last = np.append(self.lead[1:], len(h)) - 1
        self.twice = self.doc[self.lead] != self.doc[last] if len(h) else np.zeros(0, bool)


class Worded(B.Batch):
    """A batch with its words and their seeds."""

    def __init__(self, frame: pd.DataFrame, seeds: bool = True) -> None:
        super().__init__(frame)
        self.words, self.first = word_hashes(self.raw, self.starts, self.ends)
        self.n_words = np.diff(np.append(self.first, len(self.words)))
        if seeds:
            at, h = run_seeds(self.words, self.first, RUN, WIDTH)
            self.full = np.zeros(len(self.words), np.uint64)
            self.full[at] = h
            self.doc_of = np.repeat(np.arange(len(self.first)), self.n_words)
            self.seeds = Seeds(at, h, self.doc_of)

    def longer(self, held: np.ndarray, next_too: np.ndarray):
        """(length, seeds) of the longer runs in which the runs of RUN words at all places are held, save those in which
        each is also followed (``next_too``) by the next word of the same document."""
        total = np.concatenate([[0], np.cumsum(~next_too)])
        for k, at, h in longer_runs(self.full, held, RUN, LONGER):
            open_ = total[at + k - RUN] > total[at]
            yield k, Seeds(at[open_], h[open_], self.doc_of)

    def text(self, doc: int, low: int = 0, high: int | None = None) -> np.ndarray:
        a = int(self.first[doc])
        return self.words[a + low:a + (int(self.n_words[doc]) if high is None else high)]


def straight_chains(x: np.ndarray, y: np.ndarray, new: np.ndarray, gap_cost: float = GAP_COST, gap_words: int = GAP_WORDS) -> np.ndarray:
    """Of the groups of matches that begin at ``new``, those that are one chain as they stand: an equal stretch, where each match goes on
    from the one before and the score rises."""
    step, shift = np.diff(x, prepend=0), np.diff(y - x, prepend=0)
    bent = ~new & ((shift != 0) | (step <= 0) | (2 * gap_cost * step >= 1) | (step > gap_words))
    return np.bincount(np.cumsum(new) - 1, bent, int(new.sum())) == 0


def chain(x: np.ndarray, y: np.ndarray, gap_cost: float = GAP_COST, gap_words: int = GAP_WORDS) -> list[list[int]]:
    """Chains of matches (x, y), each a list of positions in both of which x and y rise; every match is in one chain at most.

    The score of a chain is its matches less ``gap_cost`` for each word between them on either side. As the cost
    of a gap is a sum of what its two ends contribute, the best match to go on from is a maximum over all with
    smaller y so far, which a Fenwick tree gives.
    """
    if len(x) and straight_chains(x, y, np.arange(len(x)) == 0, gap_cost, gap_words)[0]:
        return [list(range(len(x)))]
    return bent_chains(x, y, gap_cost, gap_words)


def bent_chains(x: np.ndarray, y: np.ndarray, gap_cost: float = GAP_COST, gap_words: int = GAP_WORDS, least: int = 1) -> list[list[int]]:
    """``chain`` for matches that are not one straight chain; of its chains those of at least so many matches."""
    n = len(x)
    order = by_columns(x, -y)
    x, y = x[order], y[order]
    _, rank, held = np.unique(y, return_inverse=True, return_counts=True)
    # a match next to the one before in both orders, each alone in its row: whatever leads to the one before leads to it over that one, and
    # what goes on from that one goes on from it, so it is not looked for and the one before is not kept
    alone = held[rank] == 1
    next_ = np.append(False, (np.diff(x) > 0) & (np.diff(rank) == 1) & alone[1:] & alone[:-1])[:n]
    size, kept = len(held), np.append(~next_[1:], True)[:n].tolist()
    rank, next_, sums = (rank + 1).tolist(), next_.tolist(), (gap_cost * (x + y)).tolist()
    tree, holder = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, back, value = [0.0] * n, [-1] * n, 0.0
    for i, here in enumerate(sums):
        best, of = 0.0, -1
        if next_[i]:
            if value - here > 0:
                best, of = value - here, i - 1
        else:
            r = rank[i] - 1
            while r:
                got = tree[r] - here
                if got > best:
                    best, of = got, holder[r]
                r &= r - 1
        score[i], back[i] = 1.0 + best, of
        value = 1.0 + best + here
        if kept[i]:
            r = rank[i]
            while r <= size:
                if value > tree[r]:
                    tree[r], holder[r] = value, i
                r += r & -r
    lead = np.array(back, np.int64)
    ends = ((lead < 0) | (x - x[lead] > gap_words) | (y - y[lead] > gap_words)).tolist()
    order, out, used = order.tolist(), [], [False] * n
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(order[i])
            if ends[i]:
                if len(path) >= least:
                    out.append(path[::-1])
                path = []
            i = back[i]
        if path and len(path) >= least:
            out.append(path[::-1])
    return out


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many rows: (group of each row, its number in the group)."""
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)


class Windows:
    """Pairs of stretches of words: ``n`` from place ``a`` of ``mine``, ``m`` from place ``b`` of ``other``, onward (``step`` 1) or backward (-1)."""

    def __init__(self, mine: np.ndarray, other: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, step: np.ndarray) -> None:
        self.mine, self.other, self.a, self.n, self.b, self.m, self.step = mine, other, a, n, b, m, step

    def __getitem__(self, rows) -> Windows:
        return Windows(self.mine, self.other, self.a[rows], self.n[rows], self.b[rows], self.m[rows], self.step[rows])

    def words(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretches as rows of ``width`` words; what lies behind their ends is equal to nothing."""
        out, at = [], np.arange(width)
        for text, lead, size, none in ((self.mine, self.a, self.n, -1), (self.other, self.b, self.m, -2)):
            rows = np.full((len(lead), width), none, np.int64)
            inside = at < size[:, None]
            rows[inside] = text[(lead[:, None] + at * self.step[:, None])[inside]]
            out.append(rows)
        return out[0], out[1]


#: Cells of tables of common subsequences that are filled at a time.
TABLE_CELLS = 1 << 22


def common(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(pair, word of its first stretch) for the words that a longest common subsequence of the two matches."""
    longest = np.maximum(w.n, w.m)
    size = np.where(np.minimum(w.n, w.m) > 0, np.int64(1) << np.ceil(np.log2(np.maximum(longest, 1))).astype(np.int64), 0)
    pairs, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for wide in np.unique(size[size > 0]).tolist():
        of = np.flatnonzero(size == wide)
        wide = int(longest[of].max())
        step = max(1, TABLE_CELLS // (wide + 1) ** 2)
        for at in range(0, len(of), step):
            part = of[at:at + step]
            pair, word = _common(*w[part].words(wide))
            pairs.append(part[pair])
            words.append(word)
    return np.concatenate(pairs), np.concatenate(words)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, wide = a.shape
    best = np.zeros((wide + 1, n, wide + 1), np.uint8 if wide < 255 else np.int32)
    same = a.T[:, :, None] == b[None]
    for i in range(wide - 1, -1, -1):
        row = np.maximum(best[i + 1, :, :wide], (best[i + 1, :, 1:] + 1) * same[i])
        best[i, :, :wide] = np.maximum.accumulate(row[:, ::-1], axis=1)[:, ::-1]
    live, i, j = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs, words = [], []
    while True:
        here = best[i, live, j]
        on = here > 0       # else nothing is left to match
        live, i, j, here = live[on], i[on], j[on], here[on]
        if not len(live):
            break
        hit = same[i, live, j] & (here == best[i + 1, live, j + 1] + 1)
        pairs.append(live[hit])
        words.append(i[hit])
        down = hit | (best[i + 1, live, j] >= best[i, live, j + 1])
        i, j = i + down, j + (hit | ~down)
    return np.concatenate([np.zeros(0, np.int64), *pairs]), np.concatenate([np.zeros(0, np.int64), *words])


def onward(w: Windows, beyond: int = BEYOND) -> tuple[np.ndarray, np.ndarray]:
    """(pair, word of its first stretch) for stretches that go on as one another do: place by place, or as a common subsequence
    where most words are shared but not so placed."""
    pairs, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, TABLE_CELLS // (beyond + 1) ** 2)
    for at in range(0, len(w.n), step):
        part = w[at:at + step]
        a, b = part.words(beyond)
        straight, near = a == b, np.minimum(np.minimum(part.n, part.m), 16)
        first = np.arange(min(beyond, 16)) < near[:, None]
        placed = (straight[:, :first.shape[1]] & first).sum(axis=1)
        moved = np.flatnonzero(placed < near)
        shared = ((a[moved, :first.shape[1], None] == b[moved, None, :]).any(axis=2) & first[moved]).sum(axis=1)
        moved = moved[shared > np.maximum(0.6 * near[moved], placed[moved])]
        straight[moved] = False
        pair, word = np.nonzero(straight)
        more, word_of = common(part[moved])
        pairs += [pair + at, moved[more] + at]
        words += [word, word_of]
    return np.concatenate(pairs), np.concatenate(words)


def align(mine: np.ndarray, other: np.ndarray, new: np.ndarray, x: np.ndarray, y: np.ndarray, edges: np.ndarray, run: int = RUN,
          beyond: int = BEYOND) -> tuple[np.ndarray, np.ndarray]:
    """(chain, place of ``mine``), ascending, for the places matched along each of many chains; chains begin at ``new``, and each lies in one text of
    ``mine`` and one of ``other``, which begin and end at ``edges`` (rows: begin in ``mine``, its end, begin in ``other``, its end).

    Runs of a chain match as they are, gaps are aligned word by word, and both ends are looked on beyond.
    """
    lead, chain_of = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.append(lead[1:], len(x)) - 1
    turn = new | (np.diff(y - x, prepend=0) != 0)       # where a word more stands on one side
    at = np.flatnonzero(turn)
    group, word = _spread(x[np.append(at[1:], len(x)) - 1] - x[at] + run)
    hit = mine[x[at][group] + word] == other[y[at][group] + word]
    found = [(chain_of[at][group[hit]], (x[at][group] + word)[hit])]
    at = np.flatnonzero(turn & ~new)
    a, b = np.minimum(x[at - 1] + run, x[at]), np.minimum(y[at - 1] + run, y[at])
    pair, word = common(Windows(mine, other, a, x[at] - a, b, y[at] - b, np.ones(len(at), np.int64)))
    found.append((chain_of[at][pair], a[pair] + word))
    group, word = _spread(np.full(len(at), run))
    found.append((chain_of[at][group], x[at][group] + word))
    begin, end, to_begin, to_end = edges
    one = np.ones(len(lead), np.int64)
    ahead, after = x[lead] - 1, x[last] + run
    pair, word = onward(Windows(mine, other, ahead, np.minimum(beyond, x[lead] - begin), y[lead] - 1, np.minimum(beyond, y[lead] - to_begin), -one), beyond)
    found.append((pair, ahead[pair] - word))
    pair, word = onward(Windows(mine, other, after, np.minimum(beyond, end - after), y[last] + run, np.minimum(beyond, to_end - y[last] - run), one), beyond)
    found.append((pair, after[pair] + word))
    chains, places = (np.concatenate(c) for c in zip(*found, strict=True))
    order = by_columns(chains, places)
    chains, places = chains[order], places[order]
    once = B.runs(chains) | B.runs(places)
    return chains[once], places[once]


def passages(matched: np.ndarray, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, matched) of the best stretches of flags, one after the other, in which the share of set ones is at least ``similarity``.

    A set flag earns 1 and another costs what brings a stretch of just that share to zero, so each maximal
    stretch of positive sum has the share or more. Such stretches that are too short by themselves are one
    passage with those after them, as far as they have the share together.
    """
    cost = round(similarity / (1 - similarity), 9)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], matched.view(np.int8), [0]])))
    stretches: list[list[float]] = []       # maximal ones: start, end, sum before, sum after, matched
    total, at = 0.0, 0
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        total -= cost * (a - at)
        now = [a, z, total, total + (z - a), z - a]
        total, at = now[3], z
        while True:
            j = len(stretches) - 1
            while j >= 0 and stretches[j][2] > now[2]:
                j -= 1
            if j < 0 or stretches[j][3] > now[3]:
                break
            now = [stretches[j][0], now[1], stretches[j][2], now[3], sum(s[4] for s in stretches[j:]) + now[4]]
            del stretches[j:]
        stretches.append(now)
    highest, out = [0.0] * len(stretches), []       # the greatest sum after a short stretch from here to the next long one
    for j in range(len(stretches) - 1, -1, -1):
        if stretches[j][1] - stretches[j][0] < least_words:
            on = j + 1 < len(stretches) and stretches[j + 1][1] - stretches[j + 1][0] < least_words
            highest[j] = max(stretches[j][3], highest[j + 1]) if on else stretches[j][3]
    j = 0
    while j < len(stretches):
        s, end = stretches[j], j
        if s[1] - s[0] < least_words:
            z = j + 1
            while z < len(stretches) and stretches[z][1] - stretches[z][0] < least_words and highest[z] >= s[2]:
                if stretches[z][3] >= s[2]:
                    end = z
                z += 1
        if stretches[end][1] - s[0] >= least_words:
            out.append((int(s[0]), int(stretches[end][1]), int(sum(x[4] for x in stretches[j:end + 1]))))
            j = end
        j += 1
    return out


def _cells(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of ascending hashes; a bucket is a range of them, so few bits tell one from the next."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    begin = np.flatnonzero(B.runs(bucket))
    return list(zip(bucket[begin].tolist(), begin.tolist(), np.append(begin, len(hashes))[1:].tolist(), strict=True))


def _send(buckets: int, bits: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = Worded(frame)
        # so many bits of a hash will do: two that agree in them are both offered, and told apart there
        short = b.seeds.hashes >> np.uint64(64 - bits)
        out = [(k, frame["batch"].iloc[0], P.rising(short[x:y]), P.flags(b.seeds.twice[x:y])) for k, x, y in _cells(b.seeds.hashes, buckets)]
        return pd.DataFrame(out, columns=["bucket", "batch", "hashes", "twice"])
    return run


def _flags(frame: pd.DataFrame) -> pd.DataFrame:
    """``batches.flags_of`` for hashes of few bits, which are sorted as numbers."""
    hashes = [P.read_rising(x)[0] for x in frame["hashes"]]
    size = [len(h) for h in hashes]
    twice = np.concatenate([P.read_flags(t, n) for t, n in zip(frame["twice"], size, strict=True)])
    h = np.concatenate(hashes)
    order = by_columns(h.view(np.int64))
    new = B.runs(h[order])
    lead = np.flatnonzero(new)
    several = np.logical_or.reduceat(twice[order], lead) | (np.diff(np.append(lead, len(h))) > 1)
    shared = np.empty(len(h), bool)
    shared[order] = several[np.cumsum(new) - 1]
    parts = np.split(shared, np.cumsum(size)[:-1])
    return pd.DataFrame({"batch": frame["batch"], "bucket": frame["bucket"], "flags": [P.flags(p) for p in parts]})


def _entries(b: Worded, seeds: Seeds, shared: np.ndarray) -> np.ndarray:
    """What the batch offers of its hashes numbered ``shared``."""
    lead = seeds.lead[shared]
    rows = np.empty(len(lead), ENTRY)
    rows["hash"], rows["id"], rows["doc"] = seeds.hashes[shared], b.ids[seeds.doc[lead]], seeds.doc[lead]
    rows["word"], rows["alone"] = seeds.at[lead] - b.first[seeds.doc[lead]], ~seeds.twice[shared]
    return rows


def _squeezed(rows: np.ndarray) -> bytes:
    return b"".join([P.rising(rows["hash"]), *(P.narrow(rows[n]) for n in ("id", "doc", "word")), P.flags(rows["alone"])])


def _unsqueezed(data: bytes) -> np.ndarray:
    h, data = P.read_rising(data)
    rows = np.empty(len(h), ENTRY)
    rows["hash"] = h
    for n in ("id", "doc", "word"):
        rows[n], data = P.read_narrow(data, len(h))
    rows["alone"] = P.read_flags(data, len(h))
    return rows


OFFER = "bucket bigint, batch bigint, entries binary, flags binary"
#: ``flags``: which of the hashes that the batch sent to the bucket it offered; ``need``: which of the offered ones are answered, in ``data``.
ANSWER = "batch bigint, bucket bigint, step int, flags binary, need binary, data binary"


def _offer(buckets: int):
    def run(frame: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "batch", "entries", "flags"]
        if not len(frame) or not len(flags):
            return pd.DataFrame([], columns=names)
        b, answers, out = Worded(frame), dict(zip(flags["bucket"], flags["flags"], strict=True)), []
        for k, x, y in _cells(b.seeds.hashes, buckets):
            shared = np.flatnonzero(P.read_flags(answers[k], y - x)) + x       # of this cell only, as there are many cells
            if len(shared):
                out.append((k, frame["batch"].iloc[0], _squeezed(_entries(b, b.seeds, shared)), answers[k]))
        return pd.DataFrame(out, columns=names)
    return run


def _least(step: int):
    """Tells each batch, of its hashes, where the least holder has them, unless that is the batch's only holder."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch", kind="stable")
        parts = [_unsqueezed(x) for x in frame["entries"]]
        rows, cell = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        batch = frame["batch"].to_numpy(np.int64)[cell]
        order = by_hash(rows["hash"])       # of a hash by batch
        new, ids = B.runs(rows["hash"][order]), rows["id"][order]
        which = np.cumsum(new) - 1
        least = np.flatnonzero(ids == np.minimum.reduceat(ids, np.flatnonzero(new))[which])
        of = np.empty(len(rows), np.int64)
        of[order] = order[least[B.runs(which[least])]][which]
        need = (of != np.arange(len(of))) | (rows["alone"] == 0)
        edge, out = np.searchsorted(cell, np.arange(len(parts) + 1)), []
        for i, (own, bucket, flags) in enumerate(zip(frame["batch"], frame["bucket"], frame["flags"], strict=True)):
            want = need[edge[i]:edge[i + 1]]
            at = of[edge[i]:edge[i + 1]][want]
            data = [P.narrow(batch[at]), *(P.narrow(rows[n][at]) for n in ("id", "doc", "word"))]
            out.append((own, bucket, step, flags, P.flags(want), b"".join(data)))
        return pd.DataFrame(out, columns=["batch", "bucket", "step", "flags", "need", "data"])
    return run


def _told(hashes: np.ndarray, told: pd.DataFrame, buckets: int, offered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(answers in order of hash, the numbers of their hashes, which of ``hashes`` were offered). ``offered`` where all were."""
    cells = {k: (f, n, d) for k, f, n, d in zip(told["bucket"], told["flags"], told["need"], told["data"], strict=True)}
    shared, parts, places = np.zeros(len(hashes), bool), [np.zeros(0, MATCH)], [np.zeros(0, np.int64)]
    for k, x, y in _cells(hashes, buckets):
        if k not in cells:
            continue
        flags, need, data = cells[k]
        shared[x:y] = True if offered else P.read_flags(flags, y - x)
        own = np.flatnonzero(shared[x:y]) + x
        own = own[P.read_flags(need, len(own))]
        rows = np.empty(len(own), MATCH)
        rows["hash"] = hashes[own]
        for n in ("batch", "id", "doc", "word"):
            rows[n], data = P.read_narrow(data, len(own))
        parts.append(rows)
        places.append(own)
    return np.concatenate(parts), np.concatenate(places), shared


def _in_a_row(b: Worded, to: np.ndarray, place: np.ndarray, shared: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(places at which a shared run of RUN words begins, those of them whose holder goes on with the next run at the next place)."""
    s = b.seeds
    batch, doc = np.full(len(s.hashes), own, np.int64), s.doc[s.lead].astype(np.int64)     # without an answer the batch holds the least itself
    word = s.at[s.lead] - b.first[s.doc[s.lead]]
    batch[place], doc[place], word[place] = to["batch"], to["doc"], to["word"]
    held = np.zeros(len(b.words) + 1, bool)
    held[s.at] = shared[s.which]
    which = np.zeros(len(b.words) + 1, np.int64)       # places without a seed are not held
    which[s.at] = s.which
    if not len(s.hashes):
        return held[:-1], held[:-1]
    on, after = np.flatnonzero(held[:-1] & held[1:]), np.zeros(len(b.words), bool)
    one, two = which[on], which[on + 1]
    after[on] = (word[one] + 1 == word[two]) & (doc[one] == doc[two]) & (batch[one] == batch[two])
    return held[:-1], after


def _longer_seeds(b: Worded, held: np.ndarray, on: np.ndarray) -> list[tuple[int, Seeds]]:
    return list(b.longer(held, on))


def _offer_longer(buckets: int):
    def run(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "batch", "entries", "flags"]
        if not len(frame) or not len(told):
            return pd.DataFrame([], columns=names)
        b, own = Worded(frame), int(frame["batch"].iloc[0])
        longer = _longer_seeds(b, *_in_a_row(b, *_told(b.seeds.hashes, told, buckets), own))
        rows = np.concatenate([np.zeros(0, ENTRY), *(_entries(b, x, np.arange(len(x.hashes))) for _, x in longer)])
        rows = rows[by_hash(rows["hash"])]
        return pd.DataFrame([(k, own, _squeezed(rows[x:y]), b"") for k, x, y in _cells(rows["hash"], buckets)], columns=names)
    return run


def _matches(b: Worded, seeds: Seeds, to: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Matches of ``size`` words with the documents that the batch is told of, for its hashes numbered ``place``."""
    number = np.full(len(seeds.hashes), -1, np.int64)
    number[place] = np.arange(len(place))
    number = number[seeds.which]
    seed = np.flatnonzero(number >= 0)
    number = number[seed]
    ids = b.ids[seeds.doc[seed]]
    ok = (to["id"][number] < ids) & (ids != NO_ID)
    seed, got = seed[ok], to[number[ok]]
    m = np.empty(len(seed), ANCHOR)
    m["doc"], m["x"] = seeds.doc[seed], seeds.at[seed] - b.first[seeds.doc[seed]]
    m["to_batch"], m["to_doc"], m["to_id"], m["y"], m["chain"] = got["batch"], got["doc"], got["id"], got["word"], size
    return m


def _longer_matches(b: Worded, longer: list[tuple[int, Seeds]], told: pd.DataFrame, buckets: int) -> list[np.ndarray]:
    hashes = np.concatenate([np.zeros(0, np.uint64), *(x.hashes for _, x in longer)])
    order = by_hash(hashes)
    to, place, _ = _told(hashes[order], told, buckets, True)
    place, out, begin = order[place], [], 0
    for k, x in longer:
        mine = np.flatnonzero((place >= begin) & (place < begin + len(x.hashes)))
        out.append(_matches(b, x, to[mine], place[mine] - begin, k))
        begin += len(x.hashes)
    return out


def _joined(m: np.ndarray) -> np.ndarray:
    """The same matched words as matches of RUN words, of which those that go on from one another stand side by side, not at every word.

    ``chain`` has the words of a match, and -1 in the result.
    """
    if not len(m):
        return m
    shift = m["y"] - m["x"]
    order = by_columns(m["doc"], m["to_batch"], m["to_doc"], shift, m["x"])
    m, shift = m[order], shift[order]
    new = B.runs(m["doc"]) | B.runs(m["to_batch"]) | B.runs(m["to_doc"]) | B.runs(shift)
    lift = np.cumsum(new) << 40
    end = np.maximum.accumulate(m["x"] + m["chain"] + lift)
    new[1:] |= (m["x"] + lift)[1:] > end[:-1]
    lead = np.flatnonzero(new)
    length = (end - lift)[np.append(lead[1:], len(m)) - 1] - m["x"][lead]
    parts = -(-length // RUN)
    out = np.repeat(m[lead], parts)
    step = np.minimum((np.arange(len(out)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN, np.repeat(length - RUN, parts))
    out["x"] += step
    out["y"] += step
    out["chain"] = -1
    return out


def _chains(buckets: int):
    def run(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(told):
            return pd.DataFrame([], columns=["batch", "kind", "data"])
        b, own = Worded(frame), int(frame["batch"].iloc[0])
        to, place, shared = _told(b.seeds.hashes, told[told["step"] == 0], buckets)
        longer = _longer_seeds(b, *_in_a_row(b, to, place, shared, own))
        m = [_matches(b, b.seeds, to, place, RUN), *_longer_matches(b, longer, told[told["step"] == 1], buckets)]
        return _chained(np.concatenate(m), own)
    return run


def _chained(m: np.ndarray, own: int) -> pd.DataFrame:
    """Kind 0: the anchors of this batch's chains, for itself. Kind 1: words that it asks other batches for."""
    m = _joined(m)
    m = m[by_columns(m["doc"], m["to_batch"], m["to_doc"], m["x"])]
    new = B.runs(m["doc"]) | B.runs(m["to_batch"]) | B.runs(m["to_doc"])
    size = np.diff(np.append(np.flatnonzero(new), len(m)))
    many = np.repeat(RUN * size >= CHAIN_WORDS, size)
    m, new = m[many], new[many]
    lead, of = np.flatnonzero(new), np.cumsum(new) - 1
    x, y = np.ascontiguousarray(m["x"]), np.ascontiguousarray(m["y"])
    straight = straight_chains(x, y, new)
    words = np.bincount(of, np.where(new, RUN, np.minimum(np.diff(x, prepend=0), RUN)), len(lead))
    m["chain"] = of
    path, size = [], []
    edge = np.append(lead, len(m))
    for i in np.flatnonzero(~straight).tolist():
        a, z = edge[i:i + 2].tolist()
        for rows in bent_chains(x[a:z], y[a:z], least=-(-CHAIN_WORDS // RUN)):
            path += [a + j for j in rows]
            size.append(len(rows))
    rows, (number, at) = np.array(path, np.int64), _spread(np.array(size, np.int64))
    step = np.bincount(number, np.where(at == 0, RUN, np.minimum(np.diff(x[rows], prepend=0), RUN)), len(size))
    m["chain"][rows] = len(lead) + number
    m = m[np.concatenate([np.flatnonzero((straight & (words >= CHAIN_WORDS))[of]), rows[(step >= CHAIN_WORDS)[number]]])]
    # for each other document one interval of words, from the first to the last that any chain of this batch needs
    lead, last = B.runs(m["chain"]), np.append(m["chain"][1:] != m["chain"][:-1], True)[:len(m)]
    low, high = np.maximum(m["y"][lead] - BEYOND, 0), m["y"][last] + RUN + BEYOND
    tb, td = m["to_batch"][lead], m["to_doc"][lead]
    order = by_columns(tb, td)
    starts = np.flatnonzero(B.runs(tb[order]) | B.runs(td[order]))
    ask = np.empty(len(starts), ASK)
    if len(starts):
        ask["batch"], ask["doc"] = own, td[order][starts]
        ask["low"], ask["high"] = np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)
    return B.by_batch([(0, np.full(len(m), own, np.int64), m), (1, tb[order][starts], ask)])


def _tell(frame: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """Kind 2: the words that others asked for, after a list of whose they are. The batch's own anchors go on as they are."""
    names = ["batch", "kind", "data"]
    if not len(frame) or not len(parts):
        return pd.DataFrame([], columns=names)
    kept, asked = parts[parts["kind"] == 0], parts[parts["kind"] == 1]
    if not len(asked):
        return kept[names]
    b, own = Worded(frame, seeds=False), int(frame["batch"].iloc[0])
    ask = np.concatenate([B.unpress(x, ASK) for x in asked["data"]])
    out = []
    ask = ask[np.argsort(ask["batch"], kind="stable")]
    edge = np.append(np.flatnonzero(B.runs(ask["batch"])), len(ask))
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        head, words = np.empty(z - a, TOLD), []
        for i, r in enumerate(ask[a:z]):
            w = b.text(int(r["doc"]), int(r["low"]), min(int(r["high"]), int(b.n_words[r["doc"]])))
            head[i] = (own, r["doc"], r["low"], len(w))
            words.append(w)
        flat = np.concatenate(words).astype(np.uint32).view([("w", "<u4")])
        lead = B.press(head)
        out.append((int(ask["batch"][a]), 2, len(lead).to_bytes(8, "little") + lead + B.press(flat)))
    return pd.concat([kept[names], pd.DataFrame(out, columns=names)])


def _find(similarity: float, least_words: int):
    def run(frame: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "start_word", "end_word", "matched_words", "similarity", "earlier"]
        anchors = [x for x, k in zip(parts["data"], parts["kind"], strict=True) if k == 0] if len(parts) else []
        if not len(frame) or not anchors:
            return pd.DataFrame([], columns=names)
        b = Worded(frame, seeds=False)
        place: dict[tuple[int, int], tuple[int, int, int]] = {}
        texts, at = [], 0
        for data, kind in zip(parts["data"], parts["kind"], strict=True):
            if kind == 2:
                n = int.from_bytes(data[:8], "little") + 8
                texts.append(B.unpress(data[n:], np.dtype([("w", "<u4")]))["w"])
                for batch, doc, low, size in B.unpress(data[8:n], TOLD).tolist():
                    place[batch, doc] = (low, at, size)
                    at += size
        m = np.concatenate([B.unpress(x, ANCHOR) for x in anchors])
        m = m[by_columns(m["doc"], m["chain"], m["x"])]
        new = B.runs(m["chain"])
        chains = m[new]
        low, at, size = np.array([place[k] for k in zip(chains["to_batch"].tolist(), chains["to_doc"].tolist())]).reshape(-1, 3).T
        begin = b.first[chains["doc"]]
        of = np.cumsum(new) - 1
        edges = np.stack([begin, begin + b.n_words[chains["doc"]], at, at + size])
        chain_of, hit = align(b.words.astype(np.uint32), np.concatenate(texts), new, m["x"] + begin[of], m["y"] + (at - low)[of], edges)
        good = (np.bincount(chain_of, minlength=len(chains)) >= CHAIN_WORDS)[chain_of]
        chain_of, hit = chain_of[good], hit[good]
        matched = np.zeros(len(b.words), bool)
        matched[hit] = True
        doc_of = chains["doc"][chain_of]
        edge, out = np.append(np.flatnonzero(B.runs(doc_of)), len(doc_of)), []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            doc = int(doc_of[lo])
            first = int(b.first[doc])
            stretches = passages(matched[first:first + int(b.n_words[doc])], similarity, least_words)
            # words that each chain matches in each stretch
            starts, ends = (np.array([p[i] for p in stretches], np.int64) + first for i in (0, 1))
            of = np.searchsorted(starts, hit[lo:hi], side="right") - 1
            inside = np.flatnonzero((of >= 0) & (hit[lo:hi] < np.append(ends, 0)[of]))
            pair, n = np.unique(of[inside] * len(chains) + chain_of[lo:hi][inside], return_counts=True)
            pair = pair[n >= RUN]
            held = np.split(chains["to_id"][pair % len(chains)], np.searchsorted(pair, np.arange(1, len(stretches)) * len(chains)))
            out += [(int(b.ids[doc]), start, end, n, n / (end - start), np.unique(d).tolist()) for (start, end, n), d in zip(stretches, held, strict=False)]
        return pd.DataFrame(out, columns=names)
    return run


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS,
                    batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, matched_words, similarity, earlier): passages that earlier documents hold too, exactly or nearly.

    A passage is a stretch of at least ``least_words`` words of which at least ``similarity`` are matched, in order, by
    documents with smaller ids; ``earlier`` lists those that the seeds refer to, not every copy. Words compare
    without case of A-Z. Every run of RUN equal words is a seed, and runs of LONGER words lead past documents that
    hold only the shorter ones; a stretch of the longest that is equal is always matched. ``doc_id`` is an integer; null ids,
    null and short texts give nothing; rows that repeat an id do not refer to each other. Other columns are not read.
    """
    rows = documents(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL")
    n = B.batch_count(rows, batch_bytes)
    buckets = -(-n // BUCKET_BATCHES)
    # a seed that is not shared agrees by chance with one of another text in a hundredth of cases or less, whatever the table's size
    bits = min(64, (n * batch_bytes).bit_length() + 4)
    packed = B.pack(rows, n)
    flags = packed.groupBy("batch").applyInPandas(_send(buckets, bits), B.SENT).groupBy("bucket").applyInPandas(_flags, B.FLAGS)
    offers = packed.groupBy("batch").cogroup(flags.groupBy("batch")).applyInPandas(_offer(buckets), OFFER)
    told = offers.groupBy("bucket").applyInPandas(_least(0), ANSWER)
    more = packed.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(_offer_longer(buckets), OFFER)
    told = told.union(more.groupBy("bucket").applyInPandas(_least(1), ANSWER))
    chains = packed.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(_chains(buckets), B.STEP)
    parts = packed.groupBy("batch").cogroup(chains.groupBy("batch")).applyInPandas(_tell, B.STEP)
    return packed.groupBy("batch").cogroup(parts.groupBy("batch")).applyInPandas(_find(similarity, least_words), RESULT)
