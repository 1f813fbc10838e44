"""Exact, cached use of the public tokenizer files.

A chunk cache sits in front of the tokenizers library.  Both supported files
cut a text into pieces that never cross a white-space boundary, so ids of a
white-space chunk do not depend on its neighbours and can be remembered.  The
cache is bounded (``max_entries``); what does not fit is encoded every time.
Texts with characters outside a checked safe set, or with unusual white space,
are given to the library as a whole, so the ids always equal the library's.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np

#: Entries the chunk cache of one Python worker may hold.
CACHE_ENTRIES = 600_000

# Printable ASCII and Latin letters whose case mapping and normal form are one
# code point each; anything else takes the uncached path.
_SAFE = "\\x20-\\x7e¡-įı-ſ"
_ODD = re.compile(f"[^\n\t\r{_SAFE}]")
_ODD_TIGHT = re.compile(f"[^\n{_SAFE}]")


def _odd_spaced(text: str) -> bool:
    """Whether cutting at single spaces and line ends would not be exact."""
    return (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text
        or " \n" in text or "\n " in text or _ODD_TIGHT.search(text) is not None
    )



#: Byte-level vocabularies write each byte as one visible character.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


def _classes() -> tuple[str, str]:
    """Character classes of the safe letters and numbers, for ``re``."""
    safe = [*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]
    return tuple("".join(f"\\u{c:04x}" for c in safe if unicodedata.category(chr(c))[0] == kind) for kind in "LN")


class ChunkEncoder:
    """ids of texts as little-endian unsigned 16-bit bytes, by a cached path.

    ``kind`` is "byte" (leading spaces belong to words, white space is kept) or
    "word" (lower-cased, white space dropped, last id of a word marked).
    """

    def __init__(self, path: str, kind: str, max_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._kind = kind
        self._max = max_entries
        self._cache: dict[str, bytes] = {}
        if self._tok.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16-bit ids")
        self._model = self._tok.model
        letters, numbers = _classes()
        contraction = r"'(?:[stmd]|re|ve|ll)"
        if kind == "word":
            self._pieces = re.compile(rf"[{letters}]+|{contraction}|[{numbers}]|[^\s{letters}{numbers}]+")
        else:
            self._pieces = re.compile(rf" ?[{letters}]+|{contraction}| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")

    def _whole(self, text: str) -> bytes:
        ids = self._tok.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u2").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """ids of a chunk of safe characters: its pieces go to the model alone."""
        if self._kind == "byte" and chunk[:1] != "\n":
            chunk = " " + chunk
        tokenize = self._model.tokenize
        if chunk.isascii():  # of these, only spaces and line ends are not visible
            raw = [p.replace(" ", _BYTE_CHARS[32]).replace("\n", _BYTE_CHARS[10]) for p in self._pieces.findall(chunk)]
        else:
            raw = [p.encode().decode("latin-1").translate(_BYTE_CHARS) for p in self._pieces.findall(chunk)]
        return array("H", [t.id for p in raw for t in tokenize(p)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._kind == "word":
            if _ODD.search(text):
                return self._whole(text)
            chunks, head = text.lower().split(), b""
        else:
            if _odd_spaced(text):
                return self._whole(text)
            chunks = text.replace("\n", " \n").split(" ")
            head = self._whole(chunks[0])
            chunks = chunks[1:]
        cache = self._cache
        found = list(map(cache.get, chunks))
        if None in found:
            missing = list(dict.fromkeys(c for c, f in zip(chunks, found) if f is None))
            new = {c: self._chunk(c) for c in missing}
            found = [new[c] if f is None else f for c, f in zip(chunks, found)]
            if len(cache) + len(new) <= self._max:
                cache.update(new)
        return head + b"".join(found)


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder for each Python worker process, so tasks share its cache."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ChunkEncoder(path, kind)
    return _ENCODERS[path, kind]


def crc32_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF
