"""Fast exact ids of the lower-casing word BPE: one lookup a word, new words by byte-pair ranks.

The tokenizer drops white space and never merges across it, so a text's ids are the ids
of its white-space separated chunks in order. Chunks of Latin letters with at most one
run of ASCII marks behind are encoded from the vocabulary's own merge ranks; every other chunk, and
every text with a special token's string or an odd separator, goes to `tokenizers` itself.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Words that a worker remembers at most; forgetting costs time only.
REMEMBERED = 300_000

_SIMPLE = re.compile("([a-zß-öø-ÿ]*)([!-/:-@\\[-`{-~]*)").fullmatch
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe(dict):
    """Chunk -> its ids as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        super().__init__()
        self.slow = Tokenizer.from_file(path)
        back = _byte_chars()
        letters = {*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
        # A word's last byte is a symbol of its own in this vocabulary; bytes that no Latin word holds stand for them.
        ends = [b for b in sorted(letters) if b < 0xC0]
        spare = [b for b in range(256) if b not in letters or b >= 0xF5 or b in (0xC0, 0xC1)]
        self.last = {b: bytes([s]) for b, s in zip(ends, spare, strict=False)}
        ranks = {}
        for token, i in self.slow.get_vocab(with_added_tokens=False).items():
            end = token.endswith("</w>")
            body = token.removesuffix("</w>") if end else token
            raw = [back[c] for c in body if c in back]
            if len(raw) != len(body) or not raw or not letters.issuperset(raw) or (end and raw[-1] not in self.last):
                continue
            ranks[bytes(raw[:-1]) + self.last[raw[-1]] if end else bytes(raw)] = i
        self.fast = Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.marks = {"": b""}

    def _slow(self, text: str) -> bytes:
        return _packed(self.slow.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        return _packed(self.fast(raw[:-1] + self.last[raw[-1]]))

    def _marks(self, run: str) -> bytes:
        if run not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks = {"": b""}
            self.marks[run] = self._slow(run)
        return self.marks[run]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        low = chunk.lower()
        m = _SIMPLE(low)
        out = (self._word(m[1]) if m[1] else b"") + self._marks(m[2]) if m else self._slow(chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text without special tokens added, as packed 32-bit numbers."""
        for odd in _ODD:
            if odd in text:
                return self._slow(text)
        return b"".join(map(self.__getitem__, text.split()))


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The tokenizer of this worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
