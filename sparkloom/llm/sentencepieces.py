"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

One pass over a text reports, at each position, every piece that ends there (the automaton's output
links, longest first), and each is tried as the last step of the best path to that position.

* Unigram models: a path's score is the sum of its pieces' scores, and the best is kept (Viterbi).
* BPE models: the score is the rank of a merge, so sums of scores don't give the model's segmentation. A path is
  kept if its last two pieces are what merging gives for their joined text; exactly one
  last piece per position passes, so the pass is the same and the ids are the library's.

Texts are cut where no piece can cross, between another character and the space sign, and cuts
seen before come from a bounded memory. Characters outside the vocabulary become their UTF-8 bytes' pieces.

Defined results: a null or empty text has no ids; every row is returned. The sign U+2581 in a text is
decoded as a space, as the library does. A model whose normalisation or pieces would need more than
this raises an error: character maps, squeezed or suffixed spaces, user-defined pieces, pieces that cross a cut.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import slices

SPACE = "▁"
#: Cuts that are remembered at most; beyond it the memory starts anew.
REMEMBERED = 500_000
_CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall


class PieceAutomaton:
    """Encoder and decoder of a vocabulary of (piece, score) with byte pieces ``<0xNN>``.

    ``scores`` of pieces that texts don't produce (controls, bytes, unknown) are None.
    """

    def __init__(self, pieces: list[str], scores: list[float | None], unknown: int, merges: bool, prefix: bool = True) -> None:
        import ahocorasick

        self.pieces, self.scores, self.unknown, self.merges, self.prefix = pieces, scores, unknown, merges, prefix
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if scores[i] is None and re.fullmatch("<0x[0-9A-F]{2}>", p)}
        self.value = {i: v for v, i in self.byte.items()}
        self.ids = {p: i for i, p in enumerate(pieces) if scores[i] is not None}
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.memory: dict[str, bytes] = {}
        self.pairs: dict[tuple, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """Merging of a text, best score first, leftmost of equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                no = self.ids.get(both)
                if no is not None:
                    heappush(waiting, (-self.scores[no], i, both))

        for i in range(len(parts)):
            offer(i)
        while waiting:
            _, i, both = heappop(waiting)
            j = after[i]
            # One side may have been merged with another in the meantime.
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _stands(self, a: int, b: int) -> bool:
        """Whether pieces a and b beside each other stay as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            x, y = self.pieces[a] if a >= 0 else "", self.pieces[b]
            got = self.pairs[a, b] = self._merged(x + y) == ([x, y] if a >= 0 else [y])
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return got

    def _known_path(self, text: str) -> list[int]:
        """The path of a text whose characters are all pieces, when merging: every position has one."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        get, stands = self.pairs.get, self._stands
        for end, (i, length) in self.automaton.iter(text):
            j = end + 1
            if not size[j]:
                before = last[j - length]
                ok = get((before, i))
                if ok or ok is None and stands(before, i):
                    last[j], size[j] = i, length
        out, j = [], n
        while j > 0:
            if not size[j]:
                return self._spelled(text)
            out.append(last[j])
            j -= size[j]
        out.reverse()
        return out

    def _path(self, text: str) -> list[int]:
        n = len(text)
        if self.merges and self.known.issuperset(text):
            return self._known_path(text)
        start = [-2] * (n + 1)  # -2: not reached; of a single unknown character: its piece is -1
        last = [-1] * (n + 1)
        score = [0.0] * (n + 1)
        start[0], done = -1, 0
        merges, scores, pairs, stands = self.merges, self.scores, self.pairs, self._stands

        def close(upto: int) -> None:
            for j in range(done + 1, upto + 1):
                if start[j] == -2 and (not merges or text[j - 1] not in self.ids):
                    start[j], last[j], score[j] = j - 1, -1, score[j - 1] - 1e6

        for end, (i, length) in self.automaton.iter(text):
            j = end + 1
            if j > done + 1:
                close(j - 1)
                done = j - 1
            k = j - length
            if merges:
                if start[j] == -2 and start[k] != -2:
                    before = last[k] if k else -1
                    ok = pairs.get((before, i))
                    if ok if ok is not None else stands(before, i):
                        start[j], last[j] = k, i
            elif start[k] != -2:
                s = score[k] + scores[i]
                if start[j] == -2 or s > score[j]:
                    start[j], last[j], score[j] = k, i, s
        close(n)
        out, j = [], n
        while j > 0:
            k = start[j]
            if k == -2:
                return self._spelled(text)
            if last[j] >= 0:
                out.append(last[j])
            else:
                out += [self.byte.get(b, self.unknown) for b in reversed(text[k:j].encode("utf-8", "replace"))] if self.byte else [self.unknown]
            j = k
        return out[::-1]

    def _spelled(self, text: str) -> list[int]:
        """By merging outright, should no path reach the end."""
        out: list[int] = []
        for p in self._merged(text):
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.byte.get(b, self.unknown) for b in p.encode("utf-8", "replace")] if self.byte else [self.unknown]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        cuts = _CUTS((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        memory = self.memory
        fresh = set(cuts).difference(memory)
        if fresh:
            if len(memory) + len(fresh) > REMEMBERED:
                memory.clear()
                fresh = set(cuts)
            for c in fresh:
                ids = self._path(c)
                memory[c] = pack(f"<{len(ids)}I", *ids)
        return b"".join(map(memory.__getitem__, cuts))

    def decode(self, ids: bytes) -> str:
        table = getattr(self, "_table", None)
        if table is None:
            table = self._table = [bytes([self.value[i]]) if i in self.value else b"" if s is None and i != self.unknown else p.replace(SPACE, " ").encode() for i, (p, s) in enumerate(zip(self.pieces, self.scores))]
        raw = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


# Numbers of the fields of a model file, of its trainer and normaliser settings, and of a piece's type.
_PIECES_FIELD, _TRAINER, _NORMALIZER = 1, 2, 3
_MODEL_TYPE, _SPACE_AS_SUFFIX = 3, 24
_CHARACTER_MAP, _DUMMY_PREFIX, _SQUEEZE, _ESCAPE = 2, 3, 4, 5
_PIECE_TYPE, _USER_DEFINED = 3, 4


def settings(model: bytes) -> tuple[bool, bool]:
    """(merges, prefix): whether a model merges (BPE) or is unigram, and whether a text begins with a space."""
    found = list(_fields(model))
    part = lambda no: dict(_fields(next((v for k, v in found if k == no), b"")))
    trainer, normalizer = part(_TRAINER), part(_NORMALIZER)
    kind = trainer.get(_MODEL_TYPE, 1)
    user_defined = any(k == _PIECES_FIELD and dict(_fields(v)).get(_PIECE_TYPE, 1) == _USER_DEFINED for k, v in found)
    for wrong, what in (
        (kind not in (1, 2), "neither unigram nor BPE"), (normalizer.get(_CHARACTER_MAP), "a character map"), (normalizer.get(_SQUEEZE, 1), "squeezed spaces"),
        (not normalizer.get(_ESCAPE, 1), "unescaped spaces"), (trainer.get(_SPACE_AS_SUFFIX, 0), "spaces as suffixes"), (user_defined, "user-defined pieces"),
    ):
        if wrong:
            raise ValueError(f"a model with {what} would get other ids than the library's")
    return kind == 2, bool(normalizer.get(_DUMMY_PREFIX, 1))


@lru_cache(maxsize=2)
def automaton(path: str) -> PieceAutomaton:
    """The automaton of a model file; one for each Python worker."""
    import sentencepiece

    with open(path, "rb") as f:
        merges, prefix = settings(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    pieces = [sp.id_to_piece(i) for i in range(n)]
    if any(p and re.search(f"[^{SPACE}]{SPACE}", x) for x, p in zip(pieces, plain)):
        raise ValueError("a model with pieces that go on after a space sign would get other ids than the library's")
    return PieceAutomaton(pieces, [sp.get_score(i) if p else None for i, p in enumerate(plain)], sp.unk_id(), merges, prefix)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of whole texts as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids = pa.array([auto.encode(t) for t in texts.slice(a, b - a).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            texts = pa.array([auto.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256): digests of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(auto.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"],
            )

    return encode(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
