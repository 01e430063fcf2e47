"""Encoding with a tokenizers file by pieces that are known to encode alone.

A word between spaces that recurs is encoded once per worker; the pieces of a text
are chosen so that the file's own pre-tokenizer always cuts there. Letters and the
marks after them are two such pieces, so each run of marks is encoded once.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import hashlib
import os
import string
from array import array

#: Pieces that a worker remembers, and runs of marks. At that number it keeps only the pieces of the texts at hand, so
#: memory is bounded and results don't change.
REMEMBERED, TAILS = 600_000, 10_000


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def version_of(path: str) -> str:
    """Digest of the tokenizer file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def as_bytes(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)


class _Pieces(dict):
    """Values of words, made from the values of their bases and marks when a word is first asked for.

    word(lead, base) gives that of a base of Latin letters, which the pre-tokenizer never cuts; encode(string, length of
    the lead) gives that of any other.
    """

    def __init__(self, encode, word, lead: str, most: int | None = None):
        self.encode, self.word, self.lead, self.tails, self.most = encode, word, lead, {}, most

    def __missing__(self, w: str):
        b = w.rstrip(string.punctuation)
        if not (b.isalpha() and (b.isascii() or (max(b) < "\u0250" and "\u0130" not in b))):
            value = self[w] = self.encode(self.lead + w, len(self.lead))
            return value
        if len(b) == len(w):
            value = self[w] = self.word(self.lead, w)
            return value
        value = self.get(b)
        if value is None:
            value = self[b] = self.word(self.lead, b)
        t = w[len(b) :]
        if t not in self.tails:
            self.tails[t] = self.encode(t, 0)
        value = self[w] = value + self.tails[t]
        return value

    def trim(self, parts: list[list[str]]) -> None:
        """Forget what is too much; words of parts stay."""
        if len(self) > (self.most or REMEMBERED):
            stay = {w: self[w] for w in set().union(*parts) & self.keys()}
            self.clear()
            self.update(stay)
        if len(self.tails) > TAILS:
            self.tails.clear()


@contextlib.contextmanager
def _no_collector():
    """Nothing here makes cycles, and the collector would walk what is remembered."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Counter:
    """Token counts of texts by a byte-level BPE file.

    That pre-tokenizer always cuts before a single space between two characters that aren't white space, so a text is
    its first word and then each word with its space. A text with white space at a word's edge goes through whole.
    """

    WHOLE = -(1 << 40)

    def __init__(self, path: str):
        self.tok = load(path)
        self.model = self.tok.model
        self.first, self.next = _Pieces(self._whole, self._length, ""), _Pieces(self._whole, self._length, " ")

    def _length(self, lead: str, word: str) -> int:
        return len(self.model.tokenize(("\u0120" if lead else "") + as_bytes(word)))

    def _whole(self, piece: str, lead: int) -> int:
        if len(piece) == lead or piece[lead].isspace() or piece[-1].isspace():
            return self.WHOLE
        return len(self.tok.encode(piece, add_special_tokens=False))

    def count(self, texts: list[str]) -> list[int]:
        parts = [t.split(" ") for t in texts]
        out, first, rest = [], self.first, self.next
        with _no_collector():
            for t, p in zip(texts, parts, strict=True):
                n = first[p[0]] + sum(map(rest.__getitem__, p[1:]))
                out.append(n if n >= 0 else len(self.tok.encode(t, add_special_tokens=False)) if t else 0)
            first.trim([p[:1] for p in parts])
            rest.trim([p[1:] for p in parts])
        return out


class Encoder:
    """Token ids of texts, as little-endian uint32 bytes, by a file that lower-cases and whose pre-tokenizer drops all white space."""

    def __init__(self, path: str, remembered: int | None = None):
        self.tok = load(path)
        self.model = self.tok.model
        self.pieces = _Pieces(self._ids, self._word, "", remembered)
        self.special = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]

    def _word(self, lead: str, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else as_bytes(word))]).tobytes()

    def _ids(self, piece: str, lead: int) -> bytes:
        return array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        # words with one of the two letters that str.lower and the file's lower-casing treat differently keep their case here
        odd = lambda t: "\u03a3" in t or "\u0130" in t
        low = [" ".join(w if odd(w) else w.lower() for w in t.replace("\n", " ").split(" ")) if odd(t) else t.lower() for t in texts]
        # the file finds special strings before it lower-cases, so a text that shows one in any case goes through whole
        whole = [any(x in s for x in self.special) or (odd(t) and any(x in t.lower() for x in self.special)) for t, s in zip(texts, low, strict=True)]
        parts = [[] if w else t.replace("\n", " ").split(" ") for t, w in zip(low, whole, strict=True)]
        with _no_collector():
            out = [self._ids(t, 0) if w else b"".join(map(self.pieces.__getitem__, p)) for t, p, w in zip(texts, parts, whole, strict=True)]
            self.pieces.trim(parts)
        return out


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    """The worker's own; it lives on from task to task."""
    return Counter(path)


@functools.lru_cache(2)
def encoder(path: str, remembered: int | None = None) -> Encoder:
    return Encoder(path, remembered)
