"""Token ids of whole texts by a public tokenizer file, fast enough for large tables.

White space separates pieces in this tokenizer, so a text's ids are those of its ASCII-space-separated chunks in
order. Each worker keeps a bounded memory of chunks it has met; a new chunk of plain letters goes
straight to the tokenizer's merge model, any other one through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
REMEMBERED = 800_000

# letters A-Z, a-z and those of U+00C0 to U+00FF as UTF-8
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
# ASCII marks that belong to no contraction and no special token
_MARKS = rb"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+"
_WORD = re.compile(_LETTERS)
_MARKED = re.compile(rb"(" + _LETTERS + rb")(" + _MARKS + rb")")


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return table


class Encoder(dict):
    """Maps a chunk to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, literal_specials: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        self.model = self.tokenizer.model
        self.shown = _byte_letters()

    def __missing__(self, chunk: bytes) -> bytes:
        if _WORD.fullmatch(chunk):
            low = chunk.decode().lower().encode()
            word = low.decode() if low.isascii() else "".join(map(self.shown.__getitem__, low))
            ids = [x.id for x in self.model.tokenize(word)]
            found = np.array(ids, "<u4").tobytes()
        elif m := _MARKED.fullmatch(chunk):
            found = self[m[1]] + self[m[2]]
        else:
            found = np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) < 64:
            self[chunk] = found
        return found

    def ids(self, text: bytes) -> bytes:
        """All ids of a text as little-endian 32-bit bytes."""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str = WORD_BPE, literal_specials: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file: a name among the public ones, or a path."""
    path = name if "/" in name else public_tokenizers.path(name)
    if (path, literal_specials) not in _LOADED:
        _LOADED[path, literal_specials] = Encoder(path, literal_specials)
    return _LOADED[path, literal_specials]


def vocabulary_size(name: str = WORD_BPE) -> int:
    path = name if "/" in name else public_tokenizers.path(name)
    return Tokenizer.from_file(path).get_vocab_size()
