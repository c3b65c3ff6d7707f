import numpy as np
import pandas as pd
import zstandard

from quarry.llm import bitpack as P, chaining as C


def test_numbers_come_back_as_they_were():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 1000):
        for high in (1, 5, 2**20, 2**40, 2**63):
            v = np.sort(rng.integers(0, high, n, dtype=np.uint64, endpoint=True))
            got, rest = P.read_rising(P.rising(v) + b"xy")
            assert (got == v).all() and rest == b"xy"
            s = rng.integers(-high, high - 1, n, dtype=np.int64)
            got, rest = P.read_narrow(P.narrow(s) + b"z", n)
            assert (got == s).all() and rest == b"z"
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert (P.read_rising(P.rising(ends))[0] == ends).all()


def frame(batch, texts):
    raw = [t.encode() for t in texts.values()]
    return pd.DataFrame([(batch, np.array(list(texts), np.int64).tobytes(), np.array([len(t) for t in raw], np.int64).tobytes(),
                          zstandard.ZstdCompressor().compress(b"".join(raw)))], columns=["batch", "ids", "sizes", "texts"])


def test_a_copy_offers_its_runs_of_four_only():
    """It sent its runs of 8, 16 and 40 words too, and each in 29 bytes before they were pressed."""
    text = " ".join(f"w{i}" for i in range(2000))
    frames, by = [frame(0, {5: text}), frame(1, {9: text})], lambda parts, col: dict(list(pd.concat(parts).groupby(col)))
    flags = by([C._flags(g) for g in by([C._send(2, 30)(f) for f in frames], "bucket").values()], "batch")
    offers = pd.concat([C._offer(2)(f, flags[i]) for i, f in enumerate(frames)])
    told = by([C._least(0)(g) for _, g in offers.groupby("bucket")], "batch")
    assert sum(len(C._unsqueezed(x)) for x in offers["entries"]) == 2 * 1997
    assert all(not len(C._offer_longer(2)(f, told[i])) for i, f in enumerate(frames))
    chains = C._chains(2)(frames[1], told[1])
    assert sum(len(C.B.unpress(x, C.ANCHOR)) for x in chains[chains["kind"] == 0]["data"]) == 500
