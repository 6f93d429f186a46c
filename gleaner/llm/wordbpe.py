"""Token ids of the public word-level BPE, through the tokenizers library, with a bounded word memory.

The tokenizer drops white space and never joins words across it, so a text's ids are the ids of its
words one after another. Each task keeps the ids of words met before and asks the library only for
new ones. Texts holding one of the separators 0x1C to 0x1F, which Python and the library see
differently, are handed to the library whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cache
from typing import NamedTuple

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Bytes of words and ids remembered in each of two generations, and what an entry takes besides.
REMEMBERED, ENTRY = 64 << 20, 150
END = 1

_ODD = re.compile("[\x1c-\x1f]")
#: Texts of these characters alone, ASCII and Latin letters, are cut into runs here; others go to the library word by word.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's own split, a fixed value, over those characters in lower case.
_RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """texts to ids; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        # byte-level models name bytes by printable characters: those that print stand for themselves, the rest follow from 256 on
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(printable)]
        self.names = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _run(self, run: str) -> bytes:
        """The model's own merges of one run's bytes."""
        return self._pack([t.id for t in self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.names))])

    def _word(self, word: str) -> bytes:
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> np.ndarray:
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        plain = "<|" not in text and _PLAIN.fullmatch(text)
        parts, new, young = (_RUN.findall(text.lower()), self._run, self.young) if plain else (text.split(), self._word, self.young)
        try:
            packed = b"".join([young[w] for w in parts])
        except KeyError:
            if self.held >= REMEMBERED:
                self.old, self.young, self.held = young, {}, 0
                young = self.young
            for w in parts:
                if w not in young:
                    young[w] = ids = self.old.get(w) or new(w)
                    self.held += len(w) + len(ids) + ENTRY
            packed = b"".join([young[w] for w in parts])
        return np.frombuffer(packed, dtype=self.dtype)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(text: str | None, path: str, end: int = END) -> np.ndarray:
    """Ids of a whole text (null: empty), then the end id."""
    enc = encoder(path)
    return np.append(enc(text or ""), enc.dtype.type(end))


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class Piece(NamedTuple):
    """Ids [start, start + length) of one document at an offset of a sequence."""

    document: int
    start: int
    length: int
    sequence: int
    offset: int
