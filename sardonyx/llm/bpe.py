"""Byte-level BPE by the ``tokenizers`` library, one distinct pre-token at a time.

A byte-level BPE tokenizer cuts a text into pre-tokens by a fixed pattern and
then merges within each pre-token only, so the ids of a text are the ids of
its pre-tokens in order.  ``PieceEncoder`` cuts texts as the library does and
asks the library for each distinct pre-token once per worker (within a bound
on remembered pieces; beyond it the library is simply asked again).

Cutting: texts whose characters are all below U+0250 go through an equal
pattern of Python's ``re`` with that range's letters, numbers and white space
spelled out; any other text is cut by the library's own pre-tokenizer, so
Unicode versions can't differ.  Strings of special tokens inside a text are
one piece with one id, which is the library's default.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

#: Pieces remembered by one worker.
REMEMBERED = 400_000
_FAST_END = 0x250


def _char_class(kind: str) -> str:
    runs, start = [], None
    for i in range(_FAST_END + 1):
        hit = i < _FAST_END and unicodedata.category(chr(i))[0] == kind
        if hit and start is None:
            start = i
        elif not hit and start is not None:
            runs.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = None
    return "".join(runs)


_L, _N, _S = _char_class("L"), _char_class("N"), r"\t-\r \x85\xa0"
#: The byte-level pattern; an apostrophe starts no letter or number run, so those may come first.
_CUT = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+"
                  rf"|[{_S}]+(?![^{_S}])|[{_S}]+")
_SLOW = re.compile(rf"[^\x00-\u{_FAST_END - 1:04x}]")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def load_json(path: str) -> str:
    """The tokenizer file's text, read on the driver; a vocabulary file is a few MB at most."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> PieceEncoder:
    """A worker's encoder, with the pieces it remembers, for all of its tasks."""
    return PieceEncoder(tokenizer_json)


class PieceEncoder:
    """Cuts texts into pre-tokens and gives the ids of each."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != (
                "ByteLevel", False, True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that strip or need word borders are not supported")
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.model = self.tok.model
        self.specials = {t["content"] for t in added}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.cache: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if _SLOW.search(text):
                    return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return _CUT.findall(text)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token's string is one of them."""
        if not any(s in text for s in self.specials):
            return self._cut(text)
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            out += [part] if k % 2 else self._cut(part)
        return out

    def _tokens(self, piece: str) -> list:
        return self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_CHARS))

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        new = {}
        for p in missing:
            ids = ([self.tok.token_to_id(p)] if p in self.specials
                   else [t.id for t in self._tokens(p)])
            new[p] = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.cache) < REMEMBERED:
            self.cache.update(new)
        return new

    def ids_of(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces, cache = self.pieces(text), self.cache
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            missing = list(set(pieces).difference(cache))
            new = self._learn(missing)
            return b"".join([cache.get(p) or new[p] for p in pieces])

    def count_of(self, piece: str) -> int:
        """The number of ids of one piece."""
        return 1 if piece in self.specials else len(self._tokens(piece))
