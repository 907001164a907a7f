"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces seen.

A text is cut where its tokenizer cuts it in any case, so that a piece's ids don't depend on
its neighbours; pieces not yet in memory go to the library in one batch. Texts with control
characters that libraries class differently as white space go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np

#: Pieces that are remembered at most; beyond it all but the first quarter are forgotten.
REMEMBERED = 1_500_000

_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<[|]")
_ODD_ASCII = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
# Letters whose class all libraries agree on and that stay letters in lower case, up to a sign that always ends a piece (not the apostrophe of "'s").
_LETTERS = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+(?=[!-&(-/:-@\[-`{-~\s]|\Z)"
_PIECES = {
    # Around white space as the tokenizer's own pattern cuts it: a single space goes with what follows.
    "byte": re.compile(rf"\s+(?!\S)| ?{_LETTERS}| ?\S+|\s").findall,
    # White space is dropped, all but these two signs by the library itself.
    "word": re.compile(rf"{_LETTERS}|[^ \n]+").findall,
}
#: Text between pieces of letters that are asked for together; it is one token of its own.
_BETWEEN = {"byte": "\n", "word": " 0 "}
_TOGETHER = 100


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, splits: str, remembered: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.cut, self.between = _PIECES[splits], _BETWEEN[splits]
        # ASCII texts whose tokenizer lower-cases them have fewer pieces when that is done first.
        self.lower = self.lib.encode("A", add_special_tokens=False).ids == self.lib.encode("a", add_special_tokens=False).ids
        self.mark = self.lib.encode(self.between, add_special_tokens=False).ids[0]
        self.memory: dict[str, bytes] = {}
        self.remembered = remembered or REMEMBERED

    def pieces(self, text: str | None) -> list[str] | None:
        """The pieces of a text, or None if it is empty or must go to the library whole."""
        if not text:
            return None
        if text.isascii():
            if any(sign in text for sign in _ODD_ASCII):
                return None
            return self.cut(text.lower() if self.lower else text)
        return None if _ODD.search(text) else self.cut(text)

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        letters, rest = [], []
        for p in pieces:
            (letters if p.lstrip(" ").isalpha() else rest).append(p)
        groups = [letters[i : i + _TOGETHER] for i in range(0, len(letters), _TOGETHER)]
        asked = self.lib.encode_batch_fast([self.between.join(g) + self.between for g in groups], add_special_tokens=False)
        for some, got in zip(groups, asked):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(some):
                rest += some
                continue
            raw = ids.tobytes()
            self.memory.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, [0, *(e + 1 for e in ends)], ends))
        self.memory.update(zip(rest, self._ask(rest)))

    def trim(self, most: int) -> None:
        """Forgets all but the ``most`` pieces learnt first, among which are the frequent ones."""
        if len(self.memory) > most:
            self.memory = dict(islice(self.memory.items(), most))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        memory = self.memory
        for a in range(0, len(texts), 64):
            some = [self.pieces(t) for t in texts[a : a + 64]]
            fresh = set().union(*filter(None, some)).difference(memory)
            if len(memory) + len(fresh) > self.remembered:
                self.trim(self.remembered // 4)
                memory = self.memory
                fresh = set().union(*filter(None, some)).difference(memory)
            if fresh:
                self._learn(list(fresh))
            for text, pieces in zip(texts[a : a + 64], some):
                if pieces is not None:
                    out.append(b"".join(map(memory.__getitem__, pieces)))
                else:
                    out.append(self._ask([text])[0] if text else b"")
        return out


@lru_cache(maxsize=1)
def encoder(path: str, splits: str, remembered: int | None = None) -> PieceEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path, splits, remembered)
