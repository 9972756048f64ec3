"""Token ids of whole texts, by the `tokenizers` library.

The library takes about a microsecond a character, most of it for finding the
same words again. `Encoder` cuts the texts of a block only where the library's own
splitter cuts as well, and looks at every distinct piece of the block once, so that
repeated ones cost a look-up in Arrow's dictionary and a copy of their ids. Pieces
that no block had before go to the library, many in one call; all are remembered.
The memory is bounded by `MEMORY_PIECES` and emptied when full. A text whose cuts
are not certain goes to the library whole, so the ids always equal `encode(text,
add_special_tokens=False)` (tested).

Strings of special tokens in a text get the special id, as the library does it by
default; with `special_as_text` they are ordinary text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MEMORY_PIECES = 1_200_000

# a worker has one core
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BARE = b"\x02"
_LINE = b" " + _BARE + b"\n " + _BARE
_SPECIAL = b"<|"
_BETWEEN = "<|endoftext|>"
TOGETHER = 1000
# how byte-level vocabularies write a space
_SPACE_SIGN = "\u0120"
_CONTROLS = bytes([*range(10), *range(11, 32), 127])
# lead bytes of all white space beyond ASCII, and of some other signs
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbb")
_SPACE_RUNS = (b"  ", b" \n", b"\n ", b"\n\n")


# the apostrophe is left out, as it can belong to the letters after it
_ASCII_LETTER = np.array([x < 128 and chr(x).isalpha() for x in range(256)])
_SIGN = np.array([33 <= x < 127 and x != 39 and not chr(x).isalnum() for x in range(256)])


def _cut_signs(texts: list[bytes], mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, with a mark between an ASCII letter, which no
    folding of case or composing of characters changes, and a sign after it; and
    where each text ends."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    signs = _SIGN[raw]
    signs[ends[:-1][ends[:-1] < len(raw)]] = False
    at = np.flatnonzero(_ASCII_LETTER[raw[:-1]] & signs[1:]) + 1
    out = np.insert(raw, np.repeat(at, len(mark)), np.tile(np.frombuffer(mark, np.uint8), len(at)))
    return out, ends + len(mark) * np.searchsorted(at, ends)


class _Folded:
    """Lower-case words. The vocabulary drops white space, so words are encoded
    one by one."""

    mark = b" "

    @staticmethod
    def certain(raw: bytes) -> bytes | None:
        return raw.lower()

    @staticmethod
    def cut(texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(texts.view(pa.large_string()))

    @staticmethod
    def text(piece: bytes) -> str:
        return piece.decode()

    @staticmethod
    def is_spaced(piece: bytes) -> bool:
        return False


class _Spaced:
    """Words with the space before them, or marked as bare: the first one, line
    feeds, words after those, and signs after letters."""

    mark = b" " + _BARE

    @staticmethod
    def certain(raw: bytes) -> bytes | None:
        if (
            any(x in raw for x in _SPACE_RUNS)
            or any(x in raw for x in _WIDE_SPACE)
            or len(raw.translate(None, _CONTROLS)) < len(raw)
        ):
            return None
        return _BARE + raw.replace(b"\n", _LINE)

    @staticmethod
    def cut(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    @staticmethod
    def text(piece: bytes) -> str:
        return piece[1:].decode() if piece[:1] == _BARE else " " + piece.decode()

    @staticmethod
    def is_spaced(piece: bytes) -> bool:
        return piece[:1] > _BARE


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, `end_id` appended.
    Null counts as empty."""

    def __init__(self, name: str, end_id: int, pieces: int = MEMORY_PIECES, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        # such a vocabulary folds case and treats all white space alike
        self.way = _Folded if self.tokenizer.normalizer is not None else _Spaced
        self.special_as_text = special_as_text
        self.memory: dict[bytes, bytes] = {}
        self.between = None if special_as_text else self.tokenizer.token_to_id(_BETWEEN)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[x for word, x in vocabulary.items() if word.startswith(_SPACE_SIGN)]] = True
        self.end = end_id.to_bytes(4, "little")
        self.pieces = pieces

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _of_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of many short texts. A special token, which no piece holds, stands
        between them: the library splits there before all else, and its cost per
        call is shared."""
        if self.between is None:
            return self.library(texts)
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            ids = self._ids(_BETWEEN.join(some))
            edges = np.concatenate(([-1], np.flatnonzero(ids == self.between), [len(ids)]))
            raw, starts, ends = ids.tobytes(), 4 * (edges[:-1] + 1), 4 * edges[1:]
            out += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def _of_spaced(self, words: list[bytes]) -> list[bytes]:
        """Ids of many words, each with the space before it, which is where the
        library cuts: their first tokens are those that begin with a space."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = self._ids(b" ".join([b"", *some]).decode())
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):
                out += self._of_pieces([self.way.text(x) for x in some])
                continue
            raw, edges = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _certain(self, raw: bytes) -> bytes | None:
        """The text if its cuts are certain, as `cut` takes it."""
        if not self.special_as_text and _SPECIAL in raw:
            return None
        return self.way.certain(raw)

    def _learn(self, new: list[bytes]) -> None:
        spaced = [x for x in new if self.way.is_spaced(x)]
        others = [x for x in new if not self.way.is_spaced(x)]
        self.memory.update(zip(spaced, self._of_spaced(spaced), strict=True))
        self.memory.update(zip(others, self._of_pieces([self.way.text(x) for x in others]), strict=True))

    def _joined(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts whose cuts are certain."""
        raw, ends = _cut_signs(texts, self.way.mark)
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]
        lists = self.way.cut(pa.Array.from_buffers(pa.large_binary(), len(texts), buffers))
        pieces = lists.values.dictionary_encode()
        own = pieces.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.memory) > self.pieces:
            self.memory = {}
        known = list(map(self.memory.get, own))
        new = [x for x, ids in zip(own, known, strict=True) if ids is None]
        if new:
            self._learn(new)
            known = list(map(self.memory.__getitem__, own))
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        _, at, data = ids.buffers()
        ends = np.frombuffer(at, np.int64)[: len(ids) + 1][lists.offsets.to_numpy()].tolist()
        raw = data.to_pybytes() if data else b""
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        certain, whole = [], []
        for text in texts:
            found = self._certain(raw := text.encode()) if text else b""
            if found is None:
                whole.append(text)
            certain.append(found)
        own = iter(self.library(whole))
        cut = iter(self._joined([x for x in certain if x]))
        return [(next(own) if x is None else next(cut) if x else b"") + self.end for x in certain]


@functools.cache
def encoder(name: str, end_id: int) -> Encoder:
    """One encoder per Python worker, kept from task to task."""
    return Encoder(name, end_id)
