"""Token ids of whole texts, with the ids of known words kept per worker process."""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of a generation; a worker keeps the current one and the one before.
KNOWN_WORDS = 300_000
#: Longer words are encoded but not kept.
LONG_WORD = 64
#: A mark after a word of letters is a token run of its own.
MARKS = b".,;:!?"
#: Letters below this code point have no combining forms, so words of them are normal as they are.
LATIN = 0x250


def public_vocabulary() -> str:
    """The public vocabulary file that the queries use; operators take any such path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a tokenizer that never joins text across ASCII white space and drops that white space.

    ``word_bpe_49k.json`` is of that kind: its pattern matches no white space, it lowers case first, and neither
    that nor normal forms reach across white space. So a text's ids are its words' ids in order, and a word
    that was met before need not be encoded again. New words of letters are encoded together and told apart by
    the tokens that end a word. A text that may hold a special token is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = dict(zip(MARKS, self._encode([chr(m) for m in MARKS]), strict=True))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(at) != len(words):
            return self._encode([w.decode() for w in words])
        data = ids.tobytes()
        return [data[a:z] for a, z in zip([0, *at], at, strict=False)]

    def _learn(self, words) -> None:
        known, letters, others, marked = self.known, set(), [], []
        for w in words:
            core = w[:-1] if w[-1] in MARKS else w
            if core.isalpha() or _latin(core):
                if core not in known:
                    letters.add(core)
                if len(core) < len(w):
                    marked.append((w, core))
            else:
                others.append(w)
        if letters:
            letters = list(letters)
            known.update(zip(letters, self._encode_letters(letters), strict=True))
        for w, core in marked:
            known[w] = known[core] + self.marks[w[-1]]
        if others:
            known.update(zip(others, self._encode([w.decode() for w in others]), strict=True))

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; null is an empty text."""
        data = (text or "").encode()
        if any(s in data for s in self.special):
            return self._encode([text])[0]
        words = data.lower().split()
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            missing = {w for w, x in zip(words, out, strict=True) if x is None}
            known.update({w: self.older[w] for w in missing & self.older.keys()})
            self._learn([w for w in missing if w not in known])
            out = list(map(known.get, words))
            for w in missing:
                if len(w) > LONG_WORD:
                    known.pop(w, None)
                    known.pop(w[:-1], None)
        return b"".join(out)


def _latin(word: bytes) -> bool:
    """Letters only, none of which has a combining form after lower case."""
    text = word.decode()
    return text.lower().isalpha() and max(text) < chr(LATIN)


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own instance for a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
